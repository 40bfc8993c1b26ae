"""A store of text vectors, so that no text is embedded twice.

The store is a folder with one partition per embedder; a row is the SHA-256 of a text and
its vector (the text itself is not kept). ``vectors`` looks the wanted texts up by
an anti-join, embeds only those that are missing, appends them, and returns the vectors
of all. Two runs at once may append the same text twice; of vectors under one hash the
least is read, and ``compact`` writes each once.

Defined cases: a null text counts as empty; an empty set of texts embeds nothing; another
embedder's vectors are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import Folder

SCHEMA = "text_hash string, vector array<double>"


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class EmbeddingStore:
    def __init__(self, spark: SparkSession, path: str, embedder: str):
        """``embedder`` names the vector space; one store serves many."""
        self.spark, self.root = spark, f"{path.rstrip('/')}/embedder={quote(embedder, safe='')}"

    def stored(self) -> DataFrame:
        """``text_hash, vector`` of all batches; a text may occur in several."""
        if not Folder(self.spark, self.root).exists("."):
            return self.spark.createDataFrame([], SCHEMA)
        return (self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True)
                .parquet(self.root))

    def add_missing(self, texts: DataFrame, text_col: str, embed: Callable) -> int:
        """Embeds and appends the texts that the store lacks; how many there were."""
        wanted = (texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                  .withColumn("text_hash", text_hash(F.col("text"))).dropDuplicates(["text_hash"]))
        missing = wanted.join(self.stored(), "text_hash", "left_anti")
        if missing.isEmpty():
            return 0
        # a folder for each batch: a batch that fails leaves nothing that is read
        batch = f"{self.root}/batch-{uuid.uuid4().hex}"
        embed(missing, "text", "vector").select(
            "text_hash", F.col("vector").cast("array<double>").alias("vector")).write.parquet(batch)
        return self.spark.read.parquet(batch).count()

    def vectors(self, texts: DataFrame, text_col: str, embed: Callable) -> DataFrame:
        """``text_hash, vector`` of every distinct text, each once."""
        self.add_missing(texts, text_col, embed)
        wanted = texts.select(text_hash(F.col(text_col)).alias("text_hash")).distinct()
        return (self.stored().join(wanted, "text_hash", "left_semi")
                .groupBy("text_hash").agg(F.min("vector").alias("vector")))

    def compact(self) -> None:
        """Writes every vector once, as one batch, and removes the batches read."""
        folder = Folder(self.spark, self.root)
        old = folder.names()
        if len(old) > 1:
            new = f"{self.root}/batch-{uuid.uuid4().hex}"
            self.stored().groupBy("text_hash").agg(F.min("vector").alias("vector")).write.parquet(
                new)
            for name in old:
                folder.remove(name)
