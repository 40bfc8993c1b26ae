"""A training-data pipeline over ``documents``: quality classifier, near-duplicates,
secrets, mixing, token ids. Each stage works on all that the one before kept,
written as Parquet and read again. Counted as part of the package ``ledgerlens.llm``.

A null or empty text passes every stage that does not reject it for its quality;
rows without an id stay; an empty table runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, mixing, near_dups, quality_crf, secrets
from ledgerlens.llm.labelled import fold
from ledgerlens.llm.queries import tokenizer_path
from ledgerlens.session import cut_lineage
from ledgerlens.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good stay."""
    crf = quality_crf.train(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return quality_crf.keep_good(docs, crf)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8)."""
    return near_dups.keep_one(docs, width=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the curriculum takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document of the mix."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates),
          ("secret scan", secret_scan), ("source mixing", mix_sources),
          ("bpe encoding", token_ids)]

#: Classifier, MinHash, checksums and tokens are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
