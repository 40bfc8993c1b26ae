"""J2 / T8 for sparse vectors: exact top-k by inner product over an inverted index.

The index is a table with one row per chunk of documents. A row holds, for every
term of its documents, the posting list (places of the documents in the chunk, in
order, and weights), and the list's greatest and least weight. It is built once,
kept with a document index, and scanned where it lies: no document moves when
questions come.

A question needs the lists of its own terms only. Its k-th best score so far is a
threshold, carried from chunk to chunk within a task:

* a list can add at most ``question weight * greatest weight`` to a score. Lists are
  read by falling bound until the bounds of the rest together stay below the
  threshold: a document in none of the lists read cannot reach it;
* the rest are only looked up for documents found so far, and a document whose score
  plus the bounds still to come stays below the threshold is dropped on the way.

Where lists hold a good part of a chunk's documents (``DENSE``), as those of few hashed
terms do, thresholds leave out little: then the lists of a chunk are laid out as a matrix, and
blocks of questions are multiplied with it (``blocks.best_products``, exact as well).

Documents that share no term score 0 and stand after all with positive scores, ties
by id, as in the dense product; scores are rounded in the same way. Questions are packed,
at most ``SLICE`` to a row, and written once; a cross join brings every pack to
every chunk, and a task emits k rows a question.

Defined cases: null vectors take no part; a vector without terms scores 0 with
everything; fewer than k documents give fewer rows; an id that repeats counts as
often as it occurs; an empty side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .blocks import SCORE_DECIMALS, Best, best_products

#: Documents of a chunk; questions of a pack.
CHUNK_ROWS, SLICE = 1024, 4096
#: Share of a chunk's (term, document) pairs in its lists from which they are a matrix;
#: numbers that the matrix of a pack of questions may have.
DENSE, LARGEST = 1 / 16, 1 << 24
#: Below the threshold by this much, a score is below it after rounding as well.
SLACK = 2 * 10.0 ** -SCORE_DECIMALS

POSTINGS = ("chunk long, ids array<long>, terms array<int>, starts array<int>, "
            "places array<int>, weights array<double>")


@dataclass
class Chunk:
    """Posting lists of a chunk; ``ids`` ascend."""

    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        firsts = self.starts[:-1]
        some = len(self.terms) > 0
        self.most = np.maximum.reduceat(self.weights, firsts) if some else self.weights
        self.least = np.minimum.reduceat(self.weights, firsts) if some else self.weights

    @classmethod
    def of(cls, ids: np.ndarray, terms: list[np.ndarray], weights: list[np.ndarray]) -> Chunk:
        order = np.argsort(ids, kind="stable")
        place = np.repeat(np.arange(len(ids)), [len(terms[i]) for i in order])
        flat = np.concatenate([terms[i] for i in order]) if len(ids) else np.empty(0, np.int64)
        held = np.concatenate([weights[i] for i in order]) if len(ids) else np.empty(0)
        by_term = np.argsort(flat, kind="stable")
        names, starts = np.unique(flat[by_term], return_index=True)
        return cls(ids[order], names, np.append(starts, len(flat)), place[by_term], held[by_term])

    def is_dense(self) -> bool:
        return len(self.places) >= DENSE * len(self.terms) * len(self.ids) > 0

    def matrix(self) -> np.ndarray:
        """One row a document, one column for each of ``terms``."""
        out = np.zeros((len(self.ids), len(self.terms)))
        out[self.places, np.repeat(np.arange(len(self.terms)), np.diff(self.starts))] = self.weights
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int,
               floor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, rounded scores, postings read) of the documents that may be
        among the k best: scores of at least ``floor``."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        held = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[held], weights[held]
        bound = np.maximum(np.maximum(weights * self.most[at], weights * self.least[at]), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        score, read = np.zeros(len(self.ids)), 0
        prune = floor > SLACK
        found = None if prune else np.arange(len(self.ids))
        seen = np.zeros(len(self.ids), bool)
        for i, j in enumerate(order.tolist()):
            own = slice(self.starts[at[j]], self.starts[at[j] + 1])
            places = self.places[own]
            if prune and found is None and rest[i] < floor - SLACK:
                found = np.flatnonzero(seen)
            if not prune or found is None:
                score[places] += weights[j] * self.weights[own]
                seen[places] = True
                read += len(places)
                continue
            found = found[score[found] + rest[i] >= floor - SLACK]
            if not len(found):
                break
            near = np.searchsorted(places, found)
            near[near == len(places)] = 0
            hit = places[near] == found
            score[found[hit]] += weights[j] * self.weights[own][near[hit]]
            read += min(len(found), len(places))
        if found is None:
            found = np.flatnonzero(seen)
        scores = np.round(score[found], SCORE_DECIMALS)
        if prune:
            found, scores = found[scores >= floor], scores[scores >= floor]
        if len(found) > k:                      # ties to the smaller id: places ascend
            top = np.argsort(-scores, kind="stable")[:k]
            found, scores = found[top], scores[top]
        return found, scores, read


def sparse(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, terms array<int>, weights array<double>`` of dense vectors."""
    pairs = F.filter(F.transform(F.col(vec_col).cast("array<double>"),
                                 lambda x, i: F.struct(i.alias("t"), x.alias("w"))),
                     lambda p: p["w"] != 0)
    return vectors.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col), pairs.alias("_p")).select(
        id_col, F.col("_p.t").alias("terms"), F.col("_p.w").alias("weights"))


def build_postings(vectors: DataFrame, id_col: str, n_rows: int) -> DataFrame:
    """The index of ``vectors(id, terms array<int>, weights array<double>)`` (terms
    distinct), which has about ``n_rows`` rows; one shuffle, by chunk."""
    n_chunks = max(1, math.ceil(n_rows / CHUNK_ROWS))
    packed = (vectors.where("terms is not null")
              .select(F.pmod(F.xxhash64(id_col), F.lit(n_chunks)).alias("chunk"),
                      F.struct(F.col(id_col).cast("long").alias("i"), F.col("terms").alias("t"),
                               F.col("weights").alias("w")).alias("d"))
              .groupBy("chunk").agg(F.collect_list("d").alias("d")))
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())),
                        ("terms", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
                        ("places", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column(1)[row].values
                c = Chunk.of(docs.field("i").to_numpy(), _lists(docs.field("t")),
                             _lists(docs.field("w")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()], pa.int64()),
                     *[pa.array([x], f.type) for x, f in zip(
                         (c.ids, c.terms, c.starts, c.places, c.weights), list(schema)[1:])]],
                    schema=schema)

    return packed.mapInArrow(run, POSTINGS)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Searcher:
    """The k best documents of each of some questions, over the chunks of a task."""

    def __init__(self, questions: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.questions, self.k = questions, k
        self.best = Best(len(questions), k)
        self.read = 0
        self._dense: np.ndarray | None = None
        self.dim = 1 + max((int(t.max()) for t, _ in questions if len(t)), default=0)

    def add(self, chunk: Chunk) -> None:
        if chunk.is_dense() and self.dim * len(self.questions) <= LARGEST:
            self._products(chunk)
            return
        rows, ids, scores = [], [], []
        for q, (terms, weights) in enumerate(self.questions):
            places, own, read = chunk.search(terms, weights, self.k, self.best.floor[q])
            self.read += read
            rows.append(np.full(len(places), q))
            ids.append(chunk.ids[places])
            scores.append(own)
        if rows:
            self.best.add(np.concatenate(rows), np.concatenate(ids), np.concatenate(scores))
            self.best.settle()

    def _products(self, chunk: Chunk) -> None:
        if self._dense is None:
            self._dense = np.zeros((len(self.questions), self.dim))
            for q, (terms, weights) in enumerate(self.questions):
                self._dense[q, terms] = weights
        held = np.flatnonzero(chunk.terms < self.dim)
        names = chunk.terms[held]
        if not len(names):                 # no question has any of the chunk's terms
            held, names = np.zeros(1, np.int64), np.zeros(1, np.int64)
            asked, docs = np.zeros((len(self.questions), 1)), np.zeros((len(chunk.ids), 1))
        else:
            whole = len(names) == self.dim
            asked = self._dense if whole else self._dense[:, names]
            docs = chunk.matrix()[:, held]
        best_products(self.best, asked, docs, chunk.ids)
        self.read += len(chunk.places) * len(self.questions)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, id, score) of the best, in order."""
        return self.best.settle()

    def _of(self, column: int) -> list[np.ndarray]:
        found = self.found()
        cuts = np.searchsorted(found[0], np.arange(1, len(self.questions)))
        return np.split(found[column], cuts) if self.questions else []

    @property
    def ids(self) -> list[np.ndarray]:
        return self._of(1)

    @property
    def scores(self) -> list[np.ndarray]:
        return self._of(2)


def _packed_questions(questions: DataFrame, qid: str) -> DataFrame:
    """``pack long, q array<long>, starts array<int>, terms array<int>, weights
    array<double>`` of at most ``SLICE`` questions each. Written once."""
    most = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if held and sum(b.num_rows for b in held) + part.num_rows > most:
                    yield pack(held)
                    held = []
                held.append(part)
        if held:
            yield pack(held)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        q, terms, weights = (c.combine_chunks() for c in pa.Table.from_batches(
            held).combine_chunks().columns)
        terms, weights = _lists(terms), _lists(weights)
        starts = np.append(0, np.cumsum([len(t) for t in terms])).astype(np.int32)
        columns = [(q.to_numpy(), pa.int64()), (starts, pa.int32()),
                   (np.concatenate(terms), pa.int32()), (np.concatenate(weights), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in columns],
                                          names=["q", "qstarts", "qterms", "qweights"])

    asked = questions.where("terms is not null").select(
        F.col(qid).cast("long").alias("q"), "terms", "weights")
    return cut_lineage(asked.mapInArrow(run, "q array<long>, qstarts array<int>, "
                                        "qterms array<int>, qweights array<double>")
                       .withColumn("pack", F.monotonically_increasing_id()))


def search_postings(questions: DataFrame, qid: str, postings: DataFrame, did: str,
                    k: int) -> DataFrame:
    """Exact top-k: ``qid, did, score, rank`` for ``questions(qid, terms, weights)``
    (ids are longs) in the index ``postings``."""
    packs = _packed_questions(questions, qid).select("pack", "q", "qstarts", "qterms", "qweights")
    # always pairs of scans, whatever the sizes: nothing is collected or broadcast
    pairs = packs.hint("shuffle_replicate_nl").crossJoin(
        postings.select("ids", "terms", "starts", "places", "weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[np.ndarray, Searcher]] = {}
        for batch in batches:
            packs = batch.column(0).to_pylist()
            columns = [_lists(batch.column(i)) for i in range(1, 10)]
            for pack, q, cuts, terms, weights, *chunk in zip(packs, *columns):
                if pack not in asked:
                    asked[pack] = q.copy(), Searcher(
                        [(terms[a:b].astype(np.int64), weights[a:b].copy())
                         for a, b in zip(cuts[:-1], cuts[1:])], k)
                asked[pack][1].add(Chunk(*chunk))
        for q, searcher in asked.values():
            rows, ids, scores = searcher.found()
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(q[rows]), pa.array(ids),
                                                  pa.array(scores)], names=["q", "d", "score"])

    found = pairs.mapInArrow(run, "q long, d long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("q").alias(qid), F.col("d").alias(did), "score", "rank"))
