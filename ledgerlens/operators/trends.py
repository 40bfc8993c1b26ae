"""Q5 trend report over per-query metrics: P10 label fix · P16 metric gate ·
A2 mean/std/n by k · A11 95 % CI · A3/T6 panel order · A4/A12 axis range ·
A8/A9 Δ(1→5) and last value · F13 labels.

Every statistic is an aggregate over (metric, cohort, k) computed with
partial aggregation; windows only run over already-aggregated rows (one
per cohort or per k), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import (AXIS_PAD_TRENDS, LABEL_FIXES, QUALITY_METRICS, QUANTILE_HI,
                         QUANTILE_LO, Z_95)
from ..functions.text import fmt2
from .quantile import exact_quantiles


def fix_labels(per_query: DataFrame) -> DataFrame:
    """P10: exact-match label replacement on ``cohort``."""
    return per_query.replace(LABEL_FIXES, subset=["cohort"])


def metric_long(per_query: DataFrame, metrics: list[str] = QUALITY_METRICS) -> DataFrame:
    """(metric, cohort, row_id, k, value) for non-null values of the metrics
    present (P7, P16: a metric with no value yields no rows)."""
    present = [m for m in metrics if m in per_query.columns]
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in present])
    return (fix_labels(per_query)
            .select("cohort", "row_id", "k", F.explode(arr).alias("_m"))
            .select(F.col("_m.metric").alias("metric"), "cohort", "row_id", "k",
                    F.col("_m.value").alias("value"))
            .where(F.col("value").isNotNull()))


def trend_stats(long: DataFrame) -> DataFrame:
    """A2 + A11 + A13: per (metric, cohort, k): mean, sample std (null at
    n = 1), n, CI half-width and ribbon."""
    g = long.groupBy("metric", "cohort", "k").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.count("value").cast("long").alias("n"))
    ci = F.lit(Z_95) * F.try_divide(F.col("std"), F.sqrt(F.col("n").cast("double")))
    return (g.where(F.col("n") > 0)
             .withColumn("ci95", ci)
             .withColumn("lo", F.col("mean") - F.col("ci95"))
             .withColumn("hi", F.col("mean") + F.col("ci95")))


def panel_order(long: DataFrame) -> DataFrame:
    """A3 + T6: per metric, cohorts ordered by their k = 1 mean (missing
    baseline last, ties alphabetical)."""
    base = long.groupBy("metric", "cohort").agg(
        F.avg(F.when(F.col("k") == 1, F.col("value"))).alias("baseline"))
    w = Window.partitionBy("metric").orderBy(F.col("baseline").asc_nulls_last(), "cohort")
    return base.withColumn("panel", F.row_number().over(w))


def axis_range(long: DataFrame, pad: float = AXIS_PAD_TRENDS) -> DataFrame:
    """A4 + A12: per metric the 2 %–98 % quantile range, padded by
    ``pad``·range (range 1 when degenerate) and clamped to [0, 1]."""
    q = exact_quantiles(long, "metric", "value", [QUANTILE_LO, QUANTILE_HI],
                        ["cohort", "row_id", "k"])
    wide = q.groupBy("metric").agg(
        F.max(F.when(F.col("q") == QUANTILE_LO, F.col("quantile"))).alias("q_lo"),
        F.max(F.when(F.col("q") == QUANTILE_HI, F.col("quantile"))).alias("q_hi"))
    rng = F.when(F.col("q_hi") > F.col("q_lo"), F.col("q_hi") - F.col("q_lo")).otherwise(F.lit(1.0))
    return wide.select("metric", "q_lo", "q_hi",
                       F.greatest(F.lit(0.0), F.col("q_lo") - F.lit(pad) * rng).alias("y_min"),
                       F.least(F.lit(1.0), F.col("q_hi") + F.lit(pad) * rng).alias("y_max"))


def deltas(stats: DataFrame) -> DataFrame:
    """A8 + A9 + F13: per (metric, cohort) Δ = mean(k=5) − mean(k=1) when
    both exist and are finite, the mean at the largest k, and labels."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c)
    d = stats.groupBy("metric", "cohort").agg(
        F.max(F.when(F.col("k") == 1, F.col("mean"))).alias("_m1"),
        F.max(F.when(F.col("k") == 5, F.col("mean"))).alias("_m5"),
        F.max_by("mean", "k").alias("last_mean"),
        F.max("k").alias("last_k"))
    delta = F.when(finite(F.col("_m1")) & finite(F.col("_m5")), F.col("_m5") - F.col("_m1"))
    return d.select(
        "metric", "cohort", delta.alias("delta_1_5"), "last_mean", "last_k",
        F.when(delta.isNotNull(), F.concat(F.lit("Δ(1→5) = "), fmt2(delta))).alias("delta_label"),
        fmt2(F.col("last_mean")).alias("last_label"))


def trend_labels(stats: DataFrame) -> DataFrame:
    """the n=… annotation per point."""
    return stats.select("metric", "cohort", "k",
                        F.concat(F.lit("n="), F.col("n").cast("string")).alias("n_label"))
