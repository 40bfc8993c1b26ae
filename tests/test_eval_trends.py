import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluation as ev
from ledgerlens.operators import trends
from ledgerlens.operators.quantile import exact_quantiles

SHEET = ("sheet string, row_id long, query string, expected_company string, gold string, "
         "pred_k1 string, pred_k3 string, pred_k5 string")


def test_alias_resolution_and_missing_sheet(spark):
    df = spark.createDataFrame([("Infered", 1, "q", "e", "g", "a", "b", "c"),
                                ("out of kb", 2, "q", "e", "g", "a", "b", "c"),
                                ("Other", 3, "q", "e", "g", "a", "b", "c")], SHEET)
    got = {r.sheet: r.cohort for r in ev.resolve_sheets(df).collect()}
    assert got == {"Infered": "Inferred", "out of kb": "Out of KB"}


def test_no_recognised_sheet_raises(spark):
    df = spark.createDataFrame([("Summary", 1, "q", "e", "g", "a", "b", "c")], SHEET)
    with pytest.raises(RuntimeError, match="Available: Summary"):
        ev.per_query_metrics(df)


def test_unpivot_and_outkb_scoring(spark):
    rows = [("Out-of-KB", 1, None, None, None, "I don't know.", "", None),
            ("Out-of-KB", 2, None, None, None, "It is 42.", "   ", "out of kb")]
    df = spark.createDataFrame(rows, SHEET)
    pq = ev.per_query_metrics(df).collect()
    assert len(pq) == 6                                        # 3 rows per input row
    for r in pq:
        assert r.good_refusal + r.hallucination_rate <= 1
        if r.pred == "":
            assert (r.good_refusal, r.hallucination_rate) == (0.0, 0.0)
    assert {(r.row_id, r.k): r.hallucination_rate for r in pq}[(2, 1)] == 1.0


def test_missing_column_behaves_as_empty(spark):
    df = spark.createDataFrame([("Known", 1, "q", "e", "gold text", "gold text", "x")],
                               "sheet string, row_id long, query string, expected_company string, "
                               "gold string, pred_k1 string, pred_k3 string")
    pq = {r.k: r for r in ev.per_query_metrics(df).collect()}
    assert pq[1].rougeL == 1.0 and pq[5].rougeL == 0.0 and pq[5].pred == ""


def test_trend_stats_n1_and_constant_axis(spark):
    df = spark.createDataFrame(
        [(0.5, None, None, None, "Infered", 1, 1, "", "", "", ""),
         (0.5, None, None, None, "Known", 2, 1, "", "", "", ""),
         (0.5, None, None, None, "Known", 3, 1, "", "", "", "")],
        "rougeL double, semantic_cosine double, good_refusal double, hallucination_rate double, "
        "cohort string, row_id long, k int, query string, expected_company string, gold string, pred string")
    long = trends.metric_long(df)
    st = {r.cohort: r for r in trends.trend_stats(long).collect()}
    assert set(st) == {"Inferred", "Known"}                    # label fixed; cosine absent
    assert st["Inferred"].std is None and st["Inferred"].ci95 is None
    ax = trends.axis_range(long).first()
    assert (ax.y_min, ax.y_max) == (pytest.approx(0.42), pytest.approx(0.58))


def test_exact_quantiles_with_dominant_value(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([np.zeros(400), rng.random(800)])
    df = spark.createDataFrame([("m", float(v), i) for i, v in enumerate(vals)],
                               "g string, v double, i long")
    got = {r.q: r.quantile for r in exact_quantiles(df, "g", "v", [0.02, 0.5, 0.98], ["i"]).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(vals, q), abs=1e-12)


def test_label_fix_takes_the_rows_of_the_report(spark):
    from ledgerlens.plans.registry import QUERIES
    got = QUERIES["label_fix"](spark, "/root/testdata/sf0.001")
    report = QUERIES["eval_union"](spark, "/root/testdata/sf0.001").select("cohort", "row_id", "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, report.collect()))
    assert {r.cohort for r in got.collect()} == {"Known", "Inferred", "Out of KB"}
