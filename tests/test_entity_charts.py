from ledgerlens.operators import charts, entity


def test_detect_first_in_table_order_and_short_names(spark):
    comp = spark.createDataFrame(
        [(0, "BHP Group"), (1, "BHP"), (2, "A.B (Ltd)"), (3, "Q"), (4, None)],
        "row_id long, company_name string")
    qs = spark.createDataFrame(
        [(1, "chart bhp group 2024"), (2, "plot bhp"), (3, "graph a.b (ltd)"),
         (4, "quarterly"), (5, "nothing here"), (6, "")],
        "question_id long, question string")
    got = {r.question_id: r.company for r in entity.detect_company(qs, comp).collect()}
    assert got == {1: "BHP Group", 2: "BHP", 3: "A.B (Ltd)", 4: "Q", 5: None, 6: None}


def test_substring_matches_exact_against_brute_force(spark):
    import random
    random.seed(7)
    texts = ["".join(random.choice("abc ") for _ in range(random.randint(0, 40))) for _ in range(60)]
    pats = ["".join(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(40)]
    t = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    p = spark.createDataFrame(list(enumerate(pats)), "pid long, pat string")
    got = {(r.tid, r.pid) for r in entity.substring_matches(t, "tid", "text", p, "pid", "pat").collect()}
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(pats) if y in x}
    assert got == want


def test_chart_no_data_and_series(spark):
    comp = spark.createDataFrame(
        [(0, "BHP", 1.0, 2.0), (1, "RIO", 3.0, None)],
        "row_id long, company_name string, rev_fy_2024 double, rev_fy_2025 double")
    qs = spark.createDataFrame([(1, "chart BHP 2025"), (2, "plot everything"), (3, "what?")],
                               "question_id long, question string")
    answers, series = charts.chart_answers(qs, comp)
    a = {r.question_id: r for r in answers.collect()}
    assert set(a) == {1, 2} and a[1].status == "ok" and a[1].n_bars == 1
    s = sorted((r.question_id, r.rank, r.series, r.value) for r in series.collect())
    assert (1, 1, "Revenue in 2025", 2.0) in s
    assert len([x for x in s if x[0] == 2]) == 4               # two bars × two years


def test_substring_matches_same_result_both_plans(spark):
    from ledgerlens.operators import entity
    texts = spark.createDataFrame([(1, "The ABC Group and Co"), (2, "xyz"), (3, "an ab test"),
                                   (4, None)], "id long, t string")
    pats = spark.createDataFrame([("abc",), ("ab",), ("group and",), ("zz",), ("",), (None,)],
                                 "p string")
    want = {(1, "abc"), (1, "ab"), (3, "ab"), (1, "group and")}
    small = entity.substring_matches(texts, "id", "t", pats, "p", "p")
    large = entity.substring_matches(texts, "id", "t", pats, "p", "p", max_bytes=1)
    assert {tuple(r) for r in small.collect()} == want
    assert {tuple(r) for r in large.collect()} == want


def test_substring_matches_by_grams_equals_brute_force(spark):
    import random
    random.seed(11)
    texts = ["".join(random.choice("abé ") for _ in range(random.randint(0, 50))) for _ in range(60)]
    pats = ["".join(random.choice("abé") for _ in range(random.randint(1, 7))) for _ in range(40)]
    t = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    p = spark.createDataFrame(list(enumerate(pats)), "pid long, pat string")
    want = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(pats) if y in x)
    for bound in (1, 1 << 20):
        got = entity.substring_matches(t, "tid", "text", p, "pid", "pat", max_bytes=bound)
        assert sorted(map(tuple, got.collect())) == want


def test_substring_matches_without_patterns(spark):
    t = spark.createDataFrame([(1, "abc")], "tid long, text string")
    p = spark.createDataFrame([], "pid long, pat string")
    assert entity.substring_matches(t, "tid", "text", p, "pid", "pat").collect() == []
