from pyspark.sql import functions as F

from ledgerlens.functions import text as tx


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first().r


def test_clean_unicode_whitespace(spark):
    s = "  a  b\x1c\nc\t  d  "
    assert _one(spark, tx.clean, s) == "a b c d"


def test_clean_null_is_empty(spark):
    assert _one(spark, tx.clean, None) == ""


def test_refusal_straight_vs_curly(spark):
    assert _one(spark, tx.looks_like_refusal, "Well, I don't know.") is True
    assert _one(spark, tx.looks_like_refusal, "Well, I don’t know.") is False
    assert _one(spark, tx.looks_like_refusal, "This is OUT-OF-KB") is True
    assert _one(spark, tx.looks_like_refusal, "I cannot find it") is True
    assert _one(spark, tx.looks_like_refusal, "") is False


def test_norm_label(spark):
    assert _one(spark, tx.norm_label, " Out-of-KB ") == "outofkb"


def test_chart_intent_is_substring(spark):
    assert _one(spark, tx.is_chart_question, "Write a paragraph") is True
    assert _one(spark, tx.is_chart_question, "Revenue?") is False


def test_year_flags(spark):
    df = spark.createDataFrame([("2024 only",), ("2025",), ("both 2024 2025",), ("none",)], "q string")
    s24, s25 = tx.year_flags(F.col("q"))
    got = [(r.a, r.b) for r in df.select(s24.alias("a"), s25.alias("b")).collect()]
    assert got == [(True, False), (False, True), (True, True), (True, True)]
