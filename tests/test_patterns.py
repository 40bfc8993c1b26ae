import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators import patterns
from ledgerlens.operators.charts import filter_by_name
from ledgerlens.operators.patterns import pieces_of


@pytest.mark.parametrize("pattern, pieces", [
    ("BHP (Group|Ltd)", ["bhp "]),
    ("(rio|bhp) ?tinto", ["tinto"]),
    ("(rio|bhp)", ["bhp", "rio"]),
    ("rio|b.p", []),                 # the second branch holds no piece of two letters
    ("ab+c", ["ab"]),                # other letters may stand between b and c
    ("abc?", ["ab"]),
    ("abc{0,2}", ["ab"]),
    ("abc{2}d", ["abc"]),
    ("(abcd)*ef", ["ef"]),
    ("(?!abcd)ef", ["ef"]),
    ("(?<n>abcd)", ["abcd"]),
    (r"a\.b\d+", ["a.b"]),
    (r"[abc\]]xy[^z]", ["xy"]),
    ("[a[b]c]xy", ["xy"]),
    ("(?x) a b", []),                # flags are not read
    (r"\Qab\E", []),
    ("é", []),
    ("café noir", [" noir"]),
    ("", []),
])
def test_pieces_of_a_pattern(pattern, pieces):
    assert pieces_of(pattern) == pieces


part = st.recursive(
    st.sampled_from(["ab", "b", "c", "ca", ".", "[ab]", "[^c]", r"\w", r"\.", "^", "$"]),
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=3).map("".join),
        st.lists(inner, min_size=1, max_size=3).map(lambda x: "(" + "|".join(x) + ")"),
        st.tuples(inner, st.sampled_from(["?", "*", "+", "{0,1}", "{2}", "*?"])).map(
            lambda x: "(?:" + x[0] + ")" + x[1])),
    max_leaves=6)


@settings(max_examples=400, deadline=None)
@given(part, st.text("abcABC.", max_size=12))
def test_every_match_holds_a_piece(pattern, text):
    pieces = pieces_of(pattern)
    if pieces and re.search("(?i)" + pattern, text):
        assert any(p in text.lower() for p in pieces)


NAMES = ["BHP Group", "bhp", "Rio Tinto", "A.B (Ltd)", "", None, "ſupplier", "Kappa",
         "cafÉ noir", "x" * 50_000 + "rio", "Rio Tinto"]
WANTED = ["bhp", "^bhp$", "(rio|bhp)", "r.o", "", None, "supplier", "KAPPA", "café", "[0-9]",
          r"a\.b", "tinto$", "rio|b.p", "(?-i)BHP"]


def test_pattern_matches_equal_one_filter_after_another(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 2)
    names = spark.createDataFrame(list(enumerate(NAMES)), "row_id long, company_name string")
    wanted = spark.createDataFrame(list(enumerate(WANTED)), "p long, pattern string")
    got = patterns.pattern_matches(names, "row_id", "company_name", wanted, "p", "pattern")
    assert got.columns == ["p", "row_id"]
    want = []
    for i, p in enumerate(WANTED):
        if p == "":
            want += [(i, r) for r, n in enumerate(NAMES) if n is not None]
        elif p is not None:
            want += [(i, r.row_id) for r in filter_by_name(names, p, regex=True).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pattern_matches_without_rows(spark):
    names = spark.createDataFrame([(1, "BHP")], "row_id long, company_name string")
    none = spark.createDataFrame([], "p long, pattern string")
    some = spark.createDataFrame([(1, "bhp"), (2, "b.p")], "p long, pattern string")
    empty = names.limit(0)
    run = patterns.pattern_matches
    assert run(names, "row_id", "company_name", none, "p", "pattern").count() == 0
    assert run(empty, "row_id", "company_name", some, "p", "pattern").count() == 0


@pytest.mark.parametrize("pattern, sets", [
    ("^supplier[#-]0*123$", [["supplier"], ["123"]]),
    ("[0][1][2]$", [["012"]]),            # classes of one character
    ("(rio|bhp) tinto", [[" tinto"], ["bhp", "rio"]]),
    ("(rio|b.p)+ ?", []),
    ("(?!abcd)ef", [["ef"]]),
])
def test_all_sets_of_pieces_of_a_pattern(pattern, sets):
    assert patterns.piece_sets_of(pattern) == sets


def test_pairs_to_test_grow_with_the_matches(spark):
    """Neither a word that every name holds nor classes of one character make every pattern
    meet every name."""
    names = spark.range(100, 400).select(F.col("id").alias("_id"),
                                         F.format_string("Supplier#%09d", "id").alias("_name"))
    code = F.col("_id").cast("string")
    wanted = names.select(F.col("_id").alias("p"), F.when(
        F.col("_id") % 2 == 0, F.concat(F.lit("^supplier[#-]0*"), code, F.lit("$")))
        .otherwise(F.concat(F.regexp_replace(code, "(.)", "[$1]"), F.lit("$"))).alias("pattern"))
    read = wanted.select(F.col("p").alias("_pid"), F.col("pattern").alias("_pattern"),
                         patterns._piece_sets("pattern").alias("_sets"))
    assert patterns._candidates(names, read).count() < 5 * 300
    got = patterns.pattern_matches(names, "_id", "_name", wanted, "p", "pattern")
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(100, 400)]
