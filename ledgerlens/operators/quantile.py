"""A4: exact quantiles with linear interpolation, per group, without
gathering a group's values in one task.

``percentile`` merges a map of every distinct value of a group in a single
task; a group holding a third of the rows would sit on one executor. Here:

1. rows are placed in the order of (group, value, tie-break columns) by
   ``rank.ranked``: range-partitioned, sorted and written once, so that even one
   repeated value spreads over many partitions and ranks and totals come from
   the same written table;
2. a group's least rank and size give the two neighbouring ranks of each
   quantile (h = (n − 1)·q), which are picked with a join and interpolated:
   v_lo + (h − lo)·(v_hi − v_lo) — the definition used by NumPy's default and by
   ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import POSITION, ranked


def exact_quantiles(df: DataFrame, group: str, value: str, qs: list[float],
                    tiebreak: list[str]) -> DataFrame:
    """(group, q, quantile) for each group with at least one non-null value."""
    keys = [group, value, *tiebreak]
    placed = ranked(df.where(F.col(value).isNotNull()).select(*keys),
                    [F.col(k) for k in keys])
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"),
                                      F.min(POSITION).alias("_start"))
    h = (F.col("_n") - 1) * F.col("q")
    targets = (sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
               .select(F.col(group).alias("_g"), "q", "_start", h.alias("_h"),
                       F.floor(h).cast("long").alias("_lo"),
                       F.least(F.ceil(h).cast("long"), F.col("_n") - 1).alias("_hi")))
    # one row per wanted rank; low and high may be the same row of the table
    wanted = targets.select("*", F.explode(F.array("_lo", "_hi")).alias("_k")).distinct()
    found = wanted.join(placed.select(F.col(value).alias("_v"), POSITION),
                        F.col(POSITION) == F.col("_start") + F.col("_k"))
    low = F.max(F.when(F.col("_k") == F.col("_lo"), F.col("_v")))
    high = F.max(F.when(F.col("_k") == F.col("_hi"), F.col("_v")))
    return found.groupBy(F.col("_g").alias(group), "q").agg(
        (low + F.max(F.col("_h") - F.col("_lo")) * (high - low)).alias("quantile"))
