"""Q1 / Q7: batch question answering over the company documents.

route (F4) → text questions → hashing embedder (X3) → exact top-k (J2, W1)
→ ranked context (A10) → prompt (F11) → answer (X2). Chart questions take
the chart branch (``operators/charts.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_TOP_K
from ..functions.embed import hashing_embed, is_sparse
from ..operators import retrieval
from ..operators.charts import route
from ..operators.render import render_documents
from ..session import cut_lineage


def text_questions(questions: DataFrame) -> DataFrame:
    return route(questions).where(~F.col("is_chart")).select("question_id", "question")


def retrieval_hits(questions: DataFrame, companies: DataFrame, k: int = DEFAULT_TOP_K,
                   embed: Callable = hashing_embed):
    # rendered once: searched, counted and joined to the hits
    docs = cut_lineage(render_documents(companies))
    tq = text_questions(questions)
    # count before embedding: the embedder is not run just to size blocks
    n_docs = docs.count()
    if is_sparse(embed):
        hits = retrieval.search_texts(tq, "question_id", "question", docs, "row_id", "content",
                                      k, n_docs)
    else:
        hits = retrieval.retrieve(tq, retrieval.index_documents(docs, embed), k, embed)
    return tq, docs, retrieval.with_documents(hits, docs)


def rag_answers(questions: DataFrame, companies: DataFrame, k: int = DEFAULT_TOP_K,
                generator=None, embed: Callable = hashing_embed) -> DataFrame:
    """(question_id, question, context, prompt, answer). ``generator`` maps
    a prompt column to an answer column (e.g. a ``predict_batch_udf``);
    the default is the extractive stand-in."""
    tq, _, hd = retrieval_hits(questions, companies, k, embed)
    return _answer(tq, hd, generator)


def rag_answers_from_index(questions: DataFrame, index: DataFrame, k: int = DEFAULT_TOP_K,
                           generator=None, embed: Callable = hashing_embed,
                           postings: DataFrame | None = None) -> DataFrame:
    """As ``rag_answers`` against a persisted index (S10), with its ``postings`` if
    the embedder is sparse."""
    tq = text_questions(questions)
    hits = retrieval.retrieve(tq, index, k, embed, postings=postings)
    return _answer(tq, retrieval.with_documents(hits, index), generator)


def _answer(tq: DataFrame, hd: DataFrame, generator) -> DataFrame:
    ctx = retrieval.build_context(hd)
    out = tq.join(ctx, "question_id", "left")
    prompt = retrieval.render_prompt(F.col("context"), F.col("question"))
    answer = generator(prompt) if generator else retrieval.extractive_answer(F.col("_top"))
    return out.select("question_id", "question", "context", prompt.alias("prompt"),
                      answer.alias("answer"))
