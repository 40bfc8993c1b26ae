from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.operators import directory, grams

ROWS = [(0, "Blue Building Pty", "BBP", None), (1, "Red", "BUIL", "a build ing"),
        (2, None, None, None), (3, "Ünïted  Steel", "US", "steel\nbuilding"), (4, "", "ab", "abab"),
        (5, "aaaa", "aaa", "AAAA")]


def test_index_search_equals_the_scan(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "row_id long, name string, code string, note string")
    path = str(tmp_path / "grams")
    grams.build_gram_index(df, path)
    read = grams.candidates(spark, path, "BUILDING")
    assert {r.row_id for r in read.collect()} == {0, 3}       # not the rows with parts of it
    assert grams.candidates(spark, path, "ab") is None

    @given(st.one_of(st.sampled_from(["", None, "building", "AAA", "aaaa", "bbpx", "ïted  s", "l\nb"]),
                     st.text("abuilding AB", max_size=5)))
    @settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
    def same(query):
        got = grams.search_index(spark, path, query).collect()
        assert sorted(map(str, got)) == sorted(map(str, directory.search(df, query).collect()))

    same()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "row_id long, name string")
    grams.build_gram_index(df, str(tmp_path / "g"))
    assert grams.search_index(spark, str(tmp_path / "g"), "abc").isEmpty()
