from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.porter import stem
from ledgerlens.functions.text import fmt2
from ledgerlens.operators import charts, evaluation, trends
from ledgerlens.operators.quantile import exact_quantiles
from ledgerlens.operators.rank import BEFORE, POSITION, ranked
from ledgerlens.operators.render import render_documents
from ledgerlens.sources import company_sheet, standins
from ledgerlens.sources import index as idx


@pytest.mark.parametrize("reuse,adaptive", [("true", "true"), ("false", "true"),
                                            ("true", "false"), ("false", "false")])
def test_quantiles_do_not_rest_on_plan_reuse(spark, reuse, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        df = spark.range(300_000).select(
            F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
            (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003.0).alias("v"))
        qs = [0.0, 0.02, 0.5, 0.98, 1.0]
        got = {(r.g, r.q): r.quantile for r in exact_quantiles(df, "g", "v", qs, ["i"]).collect()}
        values = df.toPandas()
        assert set(got) == {(g, q) for g in "ab" for q in qs}
        for (g, q), x in got.items():
            assert np.isclose(x, np.quantile(values.v[values.g == g], q), rtol=0, atol=1e-12)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_ranked_positions_and_sums(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), (F.col("id") % 5).alias("w"))
    rows = sorted(ranked(df, [F.col("k")], F.col("w")).collect(), key=lambda r: r[POSITION])
    assert [r.k for r in rows] == list(range(5000))
    total = 0
    for i, r in enumerate(rows):
        assert (r[POSITION], r[BEFORE]) == (i, total)
        total += r.w
    assert ranked(df.limit(0), [F.col("k")], F.col("w")).count() == 0


def test_two_decimals_round_the_binary_value(spark):
    rng = np.random.default_rng(1)
    values = [0.125, 0.375, 1.005, 0.715, 2.675, -0.125, -1.005, 0.5, 12345.675, 1e9 + 0.125, 0.0]
    values += [round(x, 3) for x in rng.uniform(-50, 50, 2000)] + list(rng.uniform(-9, 9, 500))
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for r in df.select("x", fmt2("x").alias("t")).collect():
        want = f"{r.x:.2f}"
        assert r.t == want or (Fraction(want) == 0 and Fraction(r.t) == 0), (r.x, r.t, want)


def test_sheet_texts_survive(spark, tmp_path):
    text = 'two\nlines, "quoted", and a \\ backslash'
    df = spark.createDataFrame([("A, B", text, 1.5), ("C", None, None)],
                               "company_name string, description string, equity double")
    company_sheet.write_company_sheet(df, f"{tmp_path}/sheet")
    rows = {r.company_name: r for r in
            company_sheet.read_company_sheet(spark, f"{tmp_path}/sheet").collect()}
    assert set(rows) == {"A, B", "C"}
    assert rows["A, B"].description == text and rows["A, B"].equity == 1.5


def test_stems_of_the_refined_rules():
    assert stem("geology") == stem("geological") == "geolog"
    assert stem("biology") == "biolog" and stem("owed") == "owe"


def test_company_names_come_from_all_suppliers(spark):
    sf = "/root/testdata/sf0.01"
    q = standins.questions(spark, sf)
    assert q.select("question_id").distinct().count() == q.count()
    named = standins.eval_sheets(spark, sf).select("expected_company").distinct().count()
    assert named > 50


def test_missing_sheets_are_all_named(spark):
    sheets = spark.createDataFrame([(f"x{i}", i) for i in range(30)], "sheet string, row_id long")
    with pytest.raises(RuntimeError, match="x29"):
        evaluation.require_sheets(sheets, evaluation.resolve_sheets(sheets))


def test_document_lines_as_written_by_hand(spark):
    df = spark.createDataFrame(
        [(7, "A Co", "A1", "Mining", 10.5, None)],
        "row_id long, company_name string, company_code string, industry string, "
        "rev_fy_2025 double, pb double")
    lines = render_documents(df).first().content.split("\n")
    assert lines[:3] == ["Company: A Co (Code: A1)", "        Industry: Mining",
                         "        Description: nan"]
    assert "        Revenue (Full Year 2025): 10.5       " in lines
    assert lines[-1] == "        Price-to-Book Ratio (P/B): nan" and len(lines) == 26


def test_second_index_build_leaves_the_first(spark, tmp_path):
    docs = spark.createDataFrame([("1", 1, "A", "x", "one two")],
                                 "doc_id string, row_id long, company_code string, "
                                 "industry string, content string")
    path = str(tmp_path / "index")
    for content in ("one two", "three"):
        idx.build_index(docs.withColumn("content", F.lit(content)), path)
    assert [r.content for r in idx.open_index(spark, path).collect()] == ["one two"]
    with pytest.raises(ValueError):
        idx.open_index(spark, path, "another")


def test_company_filter_literal_and_regex(spark):
    df = spark.createDataFrame([(0, "A.B Ltd"), (1, "AxB ltd"), (2, None)],
                               "row_id long, company_name string")
    rows = lambda *a, **k: [r.row_id for r in charts.filter_by_name(df, *a, **k).collect()]
    assert rows("a.b") == [0] and rows("a.b", regex=True) == [0, 1]
    assert rows("^ax", regex=True) == [1] and rows(None) == rows("") == [0, 1, 2]


def test_raw_labels_and_a_metric_without_values(spark):
    df = spark.createDataFrame(
        [("Infered", 1, 1, 0.5, None), ("Inferred", 2, 1, 1.0, None), ("infered", 3, 1, 0.0, None)],
        "cohort string, row_id long, k int, rougeL double, semantic_cosine double")
    assert [r.cohort for r in trends.fix_labels(df).orderBy("row_id").collect()] == [
        "Inferred", "Inferred", "infered"]
    stats = {(r.metric, r.cohort): (r["mean"], r.n)
             for r in trends.trend_stats(trends.metric_long(df)).collect()}
    assert stats == {("rougeL", "Inferred"): (0.75, 2), ("rougeL", "infered"): (0.0, 1)}
