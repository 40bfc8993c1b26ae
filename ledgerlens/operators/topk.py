"""Ranked selections.

``nlargest`` semantics: descending, nulls last but still returned when fewer
than n values exist, ties broken by the row position (``row_id``) so the
result is deterministic. A window ``row_number() <= n`` lets Spark insert a
partial ``WindowGroupLimit`` before the exchange, so only n rows per input
partition (and per group) travel, however large or skewed the input is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, by: str | Column, n: int, tie: str = "row_id",
          partition_by: list[str] | None = None, rank_col: str = "rank") -> DataFrame:
    """Rows with the n largest ``by`` (per ``partition_by`` group if given)."""
    by_col = F.col(by) if isinstance(by, str) else by
    w = Window.orderBy(by_col.desc_nulls_last(), F.col(tie).asc_nulls_last())
    if partition_by:
        w = w.partitionBy(*partition_by)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= n))


def row_max(*cols: str) -> Column:
    """Per-row maximum that skips nulls (null only if all are null)."""
    return F.greatest(*[F.col(c) for c in cols])


def top_revenue(companies: DataFrame, years: str, n: int = 5) -> DataFrame:
    """T1 (years="2025"), T2 ("2024"), T3 ("both": max of the two years)."""
    if years == "2025":
        key = F.col("rev_fy_2025")
    elif years == "2024":
        key = F.col("rev_fy_2024")
    else:
        key = row_max("rev_fy_2024", "rev_fy_2025")
    ranked = top_n(companies.withColumn("max_revenue", row_max("rev_fy_2024", "rev_fy_2025")),
                   key, n)
    return ranked.select("rank", "row_id", "company_name", "rev_fy_2024", "rev_fy_2025",
                         "max_revenue")


def directory_order(df: DataFrame) -> list[Column]:
    """T4: name then code, case-sensitive, nulls last; only columns present."""
    return [F.col(c).asc_nulls_last() for c in ("company_name", "company_code")
            if c in df.columns]
