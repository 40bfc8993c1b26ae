from ledgerlens.operators import directory, topk


def _companies(spark, rows):
    return spark.createDataFrame(rows, "row_id long, company_name string, company_code string, "
                                       "industry string, description string, rev_fy_2024 double, "
                                       "rev_fy_2025 double")


def test_top5_ties_nulls_and_short_input(spark):
    rows = [(i, f"C{i}", str(i), "x", "d", None, v) for i, v in
            enumerate([5.0, 7.0, 7.0, None, 1e7, 7.0, 7.0])]
    got = topk.top_revenue(_companies(spark, rows), "2025").orderBy("rank").collect()
    assert [r.row_id for r in got] == [4, 1, 2, 5, 6]          # ties by row order
    few = topk.top_revenue(_companies(spark, rows[:3] + [(9, "N", "9", "x", "d", None, None)]),
                           "2025").orderBy("rank").collect()
    assert [r.row_id for r in few] == [1, 2, 0, 9]             # null included, last


def test_top5_max_skips_null(spark):
    rows = [(0, "A", "0", "x", "d", 10.0, None), (1, "B", "1", "x", "d", None, 3.0),
            (2, "C", "2", "x", "d", None, None)]
    got = topk.top_revenue(_companies(spark, rows), "both").orderBy("rank").collect()
    assert [(r.row_id, r.max_revenue) for r in got] == [(0, 10.0), (1, 3.0), (2, None)]


def test_dedup_keeps_first_and_null_keys_equal(spark):
    rows = [(3, "A", "1", "x", "late"), (1, "A", "1", "x", "early"),
            (5, None, None, "x", "n2"), (4, None, None, "x", "n1")]
    df = spark.createDataFrame(rows, "row_id long, company_name string, company_code string, "
                                     "industry string, description string")
    got = sorted(directory.dedup_first(df, ["company_code", "company_name"]).collect())
    assert [(r.row_id, r.description) for r in got] == [(1, "early"), (4, "n1")]


def test_override_search_and_cards(spark):
    df = spark.createDataFrame(
        [(1, "BHP", "B1", "Mining", ""), (2, "A.B (Ltd)", "A2", None, None)],
        "row_id long, company_name string, company_code string, industry string, description string")
    ov = spark.createDataFrame([("A2", "Short A")], "company_code string, short_description string")
    d = directory.directory(df, ov)
    cards = {r.row_id: r for r in directory.cards(d).collect()}
    assert cards[1].body == "No description provided."
    assert cards[2].body == "Short A" and cards[2].caption == "Industry: —"
    assert [r.row_id for r in directory.search(d, "a.b (").collect()] == [2]
    assert directory.search(d, "nan").count() == 0            # nulls never match
    assert directory.search(d, "").count() == 2
    assert directory.count_rows(directory.search(d, "min")).first().n_records == 1
