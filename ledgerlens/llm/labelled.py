"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column,
                    limit: int) -> DataFrame:
    """``doc_id, y int, text`` of at most ``limit`` labelled documents for which
    ``may_learn`` holds, chosen by a hash of the id. Labels that are repeated
    count once, by their least; null ids and null labels are left out. The
    sample's ids (``limit`` longs at most) are broadcast, so texts do not move."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & may_learn)
              .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .join(F.broadcast(chosen), "doc_id"))
