import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 5 and "rank" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_have_stable_schema_on_small_data(spark):
    from tests.conftest import SF_SMALL
    for name in ["company_financials", "questions", "eval_sheets", "directory_cards",
                 "route_questions"]:
        df = entry.queries()[name](spark, SF_SMALL)
        assert df.count() >= 0 and len(df.columns) > 0
