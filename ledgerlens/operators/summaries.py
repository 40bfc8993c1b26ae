"""A1 / A2 / A4 as summaries that are stored and merged.

A delivery of per-query metrics (a sheet, a day) is reduced to two small tables: per
metric, cohort and k the count, mean and sum of squared deviations; per metric and
cohort a quantile sketch (KLL). Both merge: the report over all deliveries comes from their
summaries, without reading a value again.

* Moments are merged around the common mean (sum of n * (own mean - common mean)^2
  added to the deviations), so nothing cancels.
* A sketch of ``SKETCH_K`` keeps a value's rank within ``RANK_ERROR`` of the truth (as
  a share of the count, with 99 % confidence), and is exact up to ``SKETCH_K`` values.
  ``quantile.exact_quantiles`` remains for exact ranges.

A delivery writes its own partition, so one that is delivered again replaces itself.

Defined cases: null values do not count; a group without values has no row; an empty
delivery adds nothing; standard deviation is null for a single value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AXIS_PAD_TRENDS, QUANTILE_HI, QUANTILE_LO, Z_95

#: Size of a sketch, and the error in rank that follows from it (2.296 / k^0.9021).
SKETCH_K, RANK_ERROR = 4096, 0.0013
GROUP = ["metric", "cohort", "k"]


def moments(long: DataFrame) -> DataFrame:
    """``metric, cohort, k, n, mean, m2`` of (metric, cohort, row_id, k, value)."""
    return long.where("value is not null").groupBy(*GROUP).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"))


def merged_moments(parts: DataFrame) -> DataFrame:
    """One row per group from any number of rows of ``moments``."""
    whole = parts.groupBy(*GROUP).agg(F.sum("n").alias("_n"),
                                      (F.sum(F.col("n") * F.col("mean")) / F.sum("n"))
                                      .alias("_mean"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in GROUP]
    apart = F.col("p.mean") - F.col("w._mean")
    return (parts.alias("p").join(whole.alias("w"), same)
            .groupBy(*[F.col(f"w.{c}").alias(c) for c in GROUP],
                     F.col("w._n").alias("n"), F.col("w._mean").alias("mean"))
            .agg(F.sum(F.col("p.m2") + F.col("p.n") * apart * apart).alias("m2")))


def stats(merged: DataFrame) -> DataFrame:
    """A2 + A11 + A13 from moments, in the columns of ``trends.trend_stats``."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    ci = F.lit(Z_95) * (std / F.sqrt(F.col("n").cast("double")))
    return merged.select(*GROUP, "mean", std.alias("std"), F.col("n").cast("long").alias("n"),
                         ci.alias("ci95"), (F.col("mean") - ci).alias("lo"),
                         (F.col("mean") + ci).alias("hi"))


def sketches(long: DataFrame) -> DataFrame:
    """``metric, cohort, sketch`` of (metric, cohort, row_id, k, value); one pass, partial
    sketches are merged after the shuffle."""
    return long.where("value is not null").groupBy("metric", "cohort").agg(
        F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("sketch"))


def sketched_range(parts: DataFrame, pad: float = AXIS_PAD_TRENDS) -> DataFrame:
    """A4 + A12 from rows of ``sketches``: as ``trends.axis_range``, with values of
    the data (no interpolation) whose rank is within ``RANK_ERROR``."""
    one = parts.groupBy("metric").agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("s"))
    wide = one.select(
        "metric", F.kll_sketch_get_quantile_double("s", F.lit(QUANTILE_LO)).alias("q_lo"),
        F.kll_sketch_get_quantile_double("s", F.lit(QUANTILE_HI)).alias("q_hi"))
    span = F.when(F.col("q_hi") > F.col("q_lo"), F.col("q_hi") - F.col("q_lo")).otherwise(
        F.lit(1.0))
    return wide.select("metric", "q_lo", "q_hi",
                       F.greatest(F.lit(0.0), F.col("q_lo") - F.lit(pad) * span).alias("y_min"),
                       F.least(F.lit(1.0), F.col("q_hi") + F.lit(pad) * span).alias("y_max"))


class SummaryStore:
    """Summaries of deliveries in a folder; see the module docstring."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, long: DataFrame, delivery: str) -> None:
        """Adds the summaries of a delivery, or replaces those it had."""
        for kind, table in (("moments", moments(long)), ("sketches", sketches(long))):
            (table.withColumn("delivery", F.lit(delivery)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("delivery")
             .parquet(f"{self.path}/{kind}"))

    def stats(self) -> DataFrame:
        return stats(merged_moments(self.spark.read.parquet(f"{self.path}/moments")))

    def axis_range(self) -> DataFrame:
        return sketched_range(self.spark.read.parquet(f"{self.path}/sketches"))
