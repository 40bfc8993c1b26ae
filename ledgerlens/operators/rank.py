"""Global positions without a single-task window.

The rows are range-partitioned and sorted by the keys and written once with
their partition number and place in it. Positions and totals are both derived
from that written table, so no second evaluation can cut the data differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions

#: Column names that ``ranked`` adds.
POSITION, BEFORE = "_position", "_before"


def ranked(df: DataFrame, keys: list[Column], weight: Column | None = None) -> DataFrame:
    """``df`` with ``_position`` (0-based place in the order of ``keys``) and,
    if ``weight`` is given, ``_before`` (sum of the weights of all rows before).

    ``keys`` should order the rows fully; rows that tie are placed as the sort
    happens to leave them. The only global step is a running sum over one row
    per partition."""
    spark = df.sparkSession
    w = F.lit(1) if weight is None else weight
    placed = cut_lineage(
        df.withColumn("_w", w.cast("long"))
        .repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_m", 33))
        .withColumn("_place", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"))
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_n0"),
                          F.coalesce(F.sum("_s").over(so_far), F.lit(0)).alias("_s0"))
    out = placed.join(F.broadcast(starts), "_part")     # one row per partition
    out = out.withColumn(POSITION, F.col("_n0") + F.col("_place"))
    if weight is not None:
        inside = (Window.partitionBy("_part").orderBy("_place")
                  .rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(BEFORE, F.col("_s0") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return out.drop("_part", "_place", "_n0", "_s0", "_w")
