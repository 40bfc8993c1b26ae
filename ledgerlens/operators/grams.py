"""P6 at scale: free-text search over a table through an index of cell trigrams.

The index is a folder with the rows, a posting table (every distinct three-letter piece of
the lower-cased cells, with the rows that hold it), sorted by piece so that a search
reads the row groups of its own pieces, and the number of rows of each piece.

A search of three or more characters takes the rarest ``RAREST`` pieces of its query, keeps
the rows that hold all of them, reads those rows and tests them exactly, as
``directory.search`` does. A piece that no row holds ends the search. Shorter queries
scan the rows.

Defined cases: null cells have no pieces; an empty query keeps every row; pieces never
span two cells; rows are told apart by ``row_id``, which must be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .directory import search

LENGTH, RAREST = 3, 3


def pieces(df: DataFrame, cols: list[str]) -> DataFrame:
    """``piece, row_id``, each once."""
    def of_cell(c: str):
        low = F.lower(F.col(c).cast("string"))
        last = F.length(low) - (LENGTH - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last),
                                             lambda i: F.substring(low, i, F.lit(LENGTH))))

    cells = F.array(*[F.coalesce(of_cell(c), F.array().cast("array<string>")) for c in cols])
    return df.select("row_id", F.explode(F.array_distinct(F.flatten(cells))).alias("piece"))


def build_gram_index(df: DataFrame, path: str, cols: list[str] | None = None) -> None:
    """Writes the index of ``df(row_id, ...)`` over ``cols`` (all but row_id)."""
    spark, n = df.sparkSession, shuffle_partitions(df.sparkSession)
    cols = cols or [c for c in df.columns if c != "row_id"]
    df.repartitionByRange(n, "row_id").sortWithinPartitions("row_id").write.parquet(f"{path}/rows")
    held = pieces(spark.read.parquet(f"{path}/rows"), cols)
    # rows of a frequent piece go to several partitions
    (held.repartitionByRange(n, "piece", "row_id").sortWithinPartitions("piece", "row_id")
     .write.parquet(f"{path}/postings"))
    (spark.read.parquet(f"{path}/postings").groupBy("piece").agg(F.count("*").alias("n"))
     .repartitionByRange(n, "piece").sortWithinPartitions("piece")
     .write.parquet(f"{path}/counts"))


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """``row_id`` of the rows that hold the query's rarest pieces; None if the query is
    too short for the index."""
    low = query.lower()
    wanted = sorted({low[i:i + LENGTH] for i in range(len(low) - LENGTH + 1)})
    if not wanted:
        return None
    counts = spark.read.parquet(f"{path}/counts").where(F.col("piece").isin(wanted)).collect()
    if len(counts) < len(wanted):
        return spark.createDataFrame([], "row_id long")
    rare = [r["piece"] for r in sorted(counts, key=lambda r: (r["n"], r["piece"]))[:RAREST]]
    return (spark.read.parquet(f"{path}/postings").where(F.col("piece").isin(rare))
            .groupBy("row_id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare))
            .select("row_id"))


def search_index(spark: SparkSession, path: str, query: str | None,
                 cols: list[str] | None = None) -> DataFrame:
    """The rows of the indexed table that ``directory.search`` keeps."""
    rows = spark.read.parquet(f"{path}/rows")
    some = candidates(spark, path, query) if query else None
    if some is not None:
        rows = rows.join(some, "row_id", "left_semi")
    return search(rows, query, cols)
