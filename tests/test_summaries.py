import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import summaries as sm
from ledgerlens.operators import trends

SCHEMA = "metric string, cohort string, row_id long, k int, value double"


def _long(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_parts_equal_the_whole(spark, tmp_path):
    rng = np.random.default_rng(1)
    # far from zero, so that sums of squares would cancel
    rows = [("m", "c", i, 1 + i % 2, 1e8 + float(x)) for i, x in enumerate(rng.random(500))]
    rows += [("m", None, 0, 1, 2.0), ("n", "c", 1, 1, None), ("m", "c", 9, 7, 5.0)]
    whole = _long(spark, rows)
    store = sm.SummaryStore(spark, str(tmp_path))
    for part in (0, 1, 2, 1):                          # the second comes twice
        store.put(whole.where(F.col("row_id") % 3 == part), f"p{part}")
    store.put(whole.limit(0), "empty")
    got = {(r.metric, r.cohort, r.k): r for r in store.stats().collect()}
    want = {(r.metric, r.cohort, r.k): r for r in trends.trend_stats(whole).collect()}
    assert got.keys() == want.keys() and ("n", "c", 1) not in got
    for key, r in want.items():
        assert got[key].n == r.n and got[key].mean == pytest.approx(r["mean"], rel=1e-12)
        assert got[key].std == (None if r["std"] is None else pytest.approx(r["std"], rel=1e-6))


def test_sketch_keeps_its_rank_error(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.random(60_000) ** 3
    long = spark.range(60_000).select(
        F.lit("m").alias("metric"), F.lit("c").alias("cohort"), F.col("id").alias("row_id"),
        F.lit(1).alias("k"), F.element_at(F.lit(values.tolist()), (F.col("id") + 1).cast("int"))
        .alias("value"))
    store = sm.SummaryStore(spark, str(tmp_path))
    for part in range(3):
        store.put(long.where(F.col("row_id") % 3 == part), str(part))
    got = store.axis_range().first()
    ranks = np.searchsorted(np.sort(values), [got.q_lo, got.q_hi]) / len(values)
    assert np.abs(ranks - [0.02, 0.98]).max() < 2 * sm.RANK_ERROR


def test_nothing_delivered(spark):
    none = _long(spark, [])
    assert sm.stats(sm.merged_moments(sm.moments(none))).isEmpty()
    assert sm.sketched_range(sm.sketches(none)).isEmpty()
