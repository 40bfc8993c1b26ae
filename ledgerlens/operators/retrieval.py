"""Retrieval around J2: document index (A/S9/S10), depth sweep (W4), ranked
context (A10), record listing (Q7: P13, P15), prompt (F11) and answer (X2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (DEFAULT_TOP_K, DOC_SEPARATOR, K_VALUES, MISSING_META,
                         PREVIEW_CHARS, PROMPT_TEMPLATE)
from ..functions.embed import hashing_embed, hashing_terms, is_sparse
from ..session import cut_lineage
from .knn import knn
from .postings import build_postings, search_postings


def index_documents(docs: DataFrame, embed: Callable = hashing_embed) -> DataFrame:
    """Documents (doc_id, row_id, company_code, industry, content) + embedding."""
    return embed(docs, "content", "embedding")


def retrieve(questions: DataFrame, index: DataFrame, k: int = DEFAULT_TOP_K,
             embed: Callable = hashing_embed, qid: str = "question_id", qtext: str = "question",
             did: str = "row_id",
             postings: DataFrame | None = None) -> DataFrame:
    """(question_id, row_id, score, rank) — top-k documents per question. With the
    ``postings`` of a sparse embedder the documents are not touched."""
    if postings is not None and is_sparse(embed):
        return search_postings(hashing_terms(questions.select(qid, qtext), qtext), qid,
                               postings, did, k)
    q = embed(questions.select(qid, qtext), qtext, "q_emb")
    return knn(q, qid, "q_emb", index.select(did, "embedding"), did, "embedding", k)


def search_texts(questions: DataFrame, qid: str, qtext: str, docs: DataFrame, did: str,
                 dtext: str, k: int, n_docs: int) -> DataFrame:
    """Top-k of texts among texts that have no index yet, by their hashed terms."""
    # written: each partition of it is read once for every partition of questions
    postings = cut_lineage(build_postings(hashing_terms(docs.select(did, dtext), dtext), did,
                                          n_docs))
    return search_postings(hashing_terms(questions.select(qid, qtext), qtext), qid, postings,
                           did, k)


def depth_sweep(hits: DataFrame, ks: list[int] = K_VALUES) -> DataFrame:
    """Retrieve once at max k, then one row per (k, kept hit)."""
    return (hits.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
                .where(F.col("rank") <= F.col("k")))


def _meta(c: str) -> Column:
    """Metadata value or '?' when absent."""
    return F.coalesce(F.col(c), F.lit(MISSING_META))


def doc_header(rank: Column) -> Column:
    return F.concat(F.lit("[Doc "), rank.cast("string"), F.lit("] Company Code: "),
                    _meta("company_code"), F.lit(" | Industry: "), _meta("industry"))


def with_documents(hits: DataFrame, docs: DataFrame, did: str = "row_id") -> DataFrame:
    return hits.join(docs.select(did, "company_code", "industry", "content"), did, "left")


def build_context(hits_with_docs: DataFrame, qid: str = "question_id") -> DataFrame:
    """A10: per question the formatted documents in rank order, joined by the
    separator. The group is at most k rows."""
    part = F.struct(F.col("rank"), F.concat(doc_header(F.col("rank")), F.lit("\n"),
                                            F.coalesce(F.col("content"), F.lit(""))).alias("t"))
    return (hits_with_docs.groupBy(qid)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)),
                                          lambda x: x["t"]), DOC_SEPARATOR).alias("context"),
                 F.min_by("content", "rank").alias("_top")))


def render_prompt(context: Column, question: Column) -> Column:
    """the template with {reviews} and {question} filled in."""
    head, rest = PROMPT_TEMPLATE.split("{reviews}")
    mid, tail = rest.split("{question}")
    return F.concat(F.lit(head), F.coalesce(context, F.lit("")), F.lit(mid),
                    F.coalesce(question, F.lit("")), F.lit(tail))


def extractive_answer(top_content: Column) -> Column:
    """X2 offline default: first line of the best document."""
    return F.coalesce(F.substring_index(top_content, "\n", 1), F.lit(""))


def retrieved_records(hits_with_docs: DataFrame, qid: str = "question_id") -> DataFrame:
    """Q7: per question and rank: header and a preview of the content."""
    return hits_with_docs.select(
        qid, "rank", "row_id",
        _meta("company_code").alias("company_code"),
        _meta("industry").alias("industry"),
        F.concat(F.lit("Doc "), F.col("rank").cast("string"), F.lit(" — Company Code: "),
                 _meta("company_code"), F.lit(" | Industry: "), _meta("industry"))
         .alias("header"),
        F.substring(F.coalesce(F.col("content"), F.lit("")), 1, PREVIEW_CHARS).alias("preview"))
