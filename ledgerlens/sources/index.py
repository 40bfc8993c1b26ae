"""Build-if-absent persistent document index, and open it.

The index is a folder. Every build writes a version of its own below it: the
documents (doc_id, row_id, company_code, industry, content, embedding) and, for a
sparse embedder, the inverted index over their vectors. The version becomes the
index when its manifest (version, rows, embedder, dimension, chunks), written whole
beside it, is moved to ``manifest.json`` by one rename unless there is one. So:

* a build that is killed leaves no manifest, and the next one builds anew;
* of two builds at once each writes its own version, and the manifest names one;
* a later build changes nothing (a stale index stays, as a persisted vector
  collection does);
* opening reads the manifest only, and checks that the embedder is the one that
  queries will use, so documents and questions share a vector space.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import DEFAULT_DIM, hashing_embed, is_sparse
from ..operators.postings import CHUNK_ROWS, build_postings, sparse
from ..operators.retrieval import index_documents

HASHING = f"hashing-md5-{DEFAULT_DIM}"
MANIFEST = "manifest.json"


class Folder:
    """Files of a folder in any of the cluster's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.hadoop = self.jvm.org.apache.hadoop
        self.at = self.hadoop.fs.Path(self.path)
        self.fs = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def file(self, name: str):
        return self.hadoop.fs.Path(self.at, name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.file(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.file(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at)]

    def remove(self, name: str) -> None:
        self.fs.delete(self.file(name), True)

    def commit(self, name: str, text: str) -> bool:
        """Writes ``name`` whole, by a rename; False if there is one already."""
        temporary = self.file(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.exists(self.file(name)) and self.fs.rename(temporary, self.file(name)):
            return True
        self.fs.delete(temporary, False)
        return False


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What the index at ``path`` holds; None if no build was ever completed."""
    folder = Folder(spark, path)
    return json.loads(folder.read(MANIFEST)) if folder.exists(MANIFEST) else None


def build_index(docs: DataFrame, path: str, embedder: str = HASHING,
                embed: Callable = hashing_embed) -> bool:
    """Builds the index unless there is one at ``path`` (ids must be unique);
    whether this call's version became the index. ``embedder`` names the vector
    space that ``embed`` maps to."""
    spark = docs.sparkSession
    if read_manifest(spark, path):
        return False
    version = f"version-{uuid.uuid4().hex}"
    root = f"{path.rstrip('/')}/{version}"
    index_documents(docs, embed).write.parquet(f"{root}/documents")
    written = spark.read.parquet(f"{root}/documents")
    size = written.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    chunks = 0
    if is_sparse(embed):
        build_postings(sparse(written, "row_id", "embedding"), "row_id", size["n"]).write.parquet(
            f"{root}/postings")
        chunks = max(1, -(-size["n"] // CHUNK_ROWS))
    return Folder(spark, path).commit(MANIFEST, json.dumps(
        {"version": version, "embedder": embedder, "rows": size["n"], "dimension": size["dim"],
         "chunks": chunks}))


def _opened(spark: SparkSession, path: str, embedder: str) -> tuple[dict, str]:
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise ValueError(f"no index at {path}: no build was completed")
    if manifest["embedder"] != embedder:
        raise ValueError(f"index at {path} was built with {manifest['embedder']}, not {embedder}")
    return manifest, f"{path.rstrip('/')}/{manifest['version']}"


def open_index(spark: SparkSession, path: str, embedder: str = HASHING) -> DataFrame:
    """The documents with their vectors and the embedder's name."""
    _, root = _opened(spark, path, embedder)
    return spark.read.parquet(f"{root}/documents").withColumn("embedder", F.lit(embedder))


def open_postings(spark: SparkSession, path: str, embedder: str = HASHING) -> DataFrame | None:
    """The inverted index over the vectors; None for a dense embedder."""
    manifest, root = _opened(spark, path, embedder)
    return spark.read.parquet(f"{root}/postings") if manifest["chunks"] else None
