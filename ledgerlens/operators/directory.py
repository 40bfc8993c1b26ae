"""Q6 company directory: P1 prune · A7 keep-first dedup · P11 override ·
T4 sort · P6 any-column search · A5 count · P12 display fallbacks.

Dedup is an aggregate, not a window: ``min_by(struct(row), row_id)`` per key
is combined map-side, so a key that repeats across a third of the input
still ships one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DIRECTORY_COLUMNS, MISSING_META, NO_DESCRIPTION
from ..session import bounded_broadcast
from .topk import directory_order


def prune(df: DataFrame, cols: list[str] = DIRECTORY_COLUMNS,
          keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The listed columns that exist, in list order (missing ones skipped)."""
    present = [c for c in keep if c in df.columns] + [c for c in cols if c in df.columns]
    return df.select(*present)


def dedup_first(df: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """One row per key combination — the one with the smallest ``order``.
    Null keys compare equal (they form one group)."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    others = [c for c in df.columns if c not in keys]
    picked = (df.groupBy(*keys)
                .agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("_r")))
    return picked.select(*[F.col(k) for k in keys],
                         *[F.col(f"_r.{c}").alias(c) for c in others]).select(*df.columns)


def apply_overrides(df: DataFrame, overrides: DataFrame,
                    key: str = "company_code", text: str = "short_description",
                    fallback: str = "description") -> DataFrame:
    """``short_description`` = override for the key, else ``description``.
    Only when both columns exist. The override table is broadcast only
    behind a row-count check; above it the join shuffles. Of several overrides for a
    key the least text counts."""
    if key not in df.columns or fallback not in df.columns:
        return df
    ov = overrides.select(F.col(key).alias("_ov_key"), F.col(text).alias("_ov_text"))
    ov = bounded_broadcast(ov.groupBy("_ov_key").agg(F.min("_ov_text").alias("_ov_text")))
    out = df.join(ov, df[key] == ov["_ov_key"], "left")
    return (out.withColumn(text, F.coalesce(F.col("_ov_text"), F.col(fallback)))
               .drop("_ov_key", "_ov_text"))


def sort_directory(df: DataFrame) -> DataFrame:
    """T4: global order by name, code (range-partitioned sort)."""
    return df.orderBy(*directory_order(df), F.col("row_id").asc_nulls_last())


def search(df: DataFrame, query: str | None, cols: list[str] | None = None) -> DataFrame:
    """Keep rows where any column contains the query (case-insensitive,
    literal). Null cells never match; an empty query keeps every row."""
    if not query:
        return df
    cols = cols or [c for c in df.columns if c != "row_id"]
    ql = F.lit(query.lower())
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(ql), F.lit(False))
    return df.where(hit)


def count_rows(df: DataFrame) -> DataFrame:
    """A5 as a one-row frame (stays lazy)."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_records"))


def _present(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def cards(df: DataFrame) -> DataFrame:
    """Title, caption, body with fallbacks; '' and null both fall
    through to the next choice."""
    name, code = _present(df, "company_name"), _present(df, "company_code")
    industry = _present(df, "industry")
    short, desc = _present(df, "short_description"), _present(df, "description")
    return df.select(
        "row_id",
        F.concat(F.coalesce(name, F.lit(MISSING_META)), F.lit(" ("),
                 F.coalesce(code, F.lit(MISSING_META)), F.lit(")")).alias("title"),
        F.concat(F.lit("Industry: "), F.coalesce(industry, F.lit("—"))).alias("caption"),
        F.coalesce(F.nullif(short, F.lit("")), F.nullif(desc, F.lit("")),
                   F.lit(NO_DESCRIPTION)).alias("body"),
    )


def directory(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """P1 → A7 → P11: the directory table (unsorted; sort on display)."""
    pruned = prune(df)
    deduped = dedup_first(pruned, ["company_code", "company_name"])
    if overrides is not None:
        deduped = apply_overrides(deduped, overrides)
    return deduped
