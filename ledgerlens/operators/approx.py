"""J2 approximate: k-means cells with residual codes, recall measured.

Every vector belongs to its nearest cell. What is left after the cell's centre is
taken off (the residual) is cut into ``subspaces`` parts, and each part is replaced by
the number of the nearest of at most 256 code vectors, so a vector takes one byte per
part. A question's product with a vector is then about

    question · centre  +  sum over the parts of (question part · code vector),

the product with the vector that the codes stand for. The codes are a table with one row per
chunk of a cell; only chunks of the ``probes`` cells with the greatest products are worked on
for a question, all questions of a pack that probe the cell in one product. Chunks are packed
for the search, and packs of questions are cross joined with them (``blocks``). The best
``rerank`` of each question by codes stay with its pack, which is cross joined with the
packed vectors to score them exactly: no row for a question and a candidate is shuffled.

More probes and a longer rerank list find more of the true neighbours; all cells and a
list as long as the corpus give the exact result. ``recall`` measures it against
``knn``, the exact way. Centres and code vectors are fitted on at most
``SAMPLE_ROWS`` vectors, chosen by a hash of the id; every vector is coded.

Defined cases: null vectors take no part; all vectors have one length; fewer than k
documents give fewer rows; an empty side gives no rows; ties go to the smaller id; scores
are rounded as in ``knn``.
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

from ..session import bounded_broadcast, cut_lineage
from . import blocks
from .blocks import Best, SCORE_DECIMALS, found_rows, ids_of, matrix as _matrix, packed, unpacked
from .ivf import _train_cells

#: Vectors for fitting the cells, and of them for the code vectors; rows of a chunk.
SAMPLE_ROWS, CODE_ROWS, CHUNK_ROWS = 50_000, 10_000, 4096
#: Rounds of the code vectors' fit; questions of one product; codes that a task goes through.
ROUNDS, SLICE, TASK_ROWS = 8, 1024, 2_000_000


@dataclass
class Cells:
    """Centres (cells, dim), code vectors of each part, and the coded corpus
    ``cell int, ids array<long>, code array<binary>`` beside the vectors themselves.
    ``packs``: several rows of the codes in one (array ``d``); ``whole``: packed vectors."""

    centres: np.ndarray
    books: list[np.ndarray]
    codes: DataFrame
    vectors: DataFrame
    packs: DataFrame
    whole: DataFrame
    n: int


def _cuts(dim: int, parts: int) -> np.ndarray:
    return np.linspace(0, dim, min(parts, dim) + 1).astype(int)


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * v @ centres.T).argmin(axis=1)


def fit_codes(rest: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """At most 256 code vectors of each part of the residuals (Lloyd rounds)."""
    cuts, books = _cuts(rest.shape[1], parts), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = rest[:, a:b]
        book = own[rng.choice(len(own), max(1, min(256, len(own) // 4)), replace=False)].copy()
        for _ in range(ROUNDS):
            at = _nearest(own, book)
            n = np.bincount(at, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, at, own)
            book[n > 0] = total[n > 0] / n[n > 0, None]
        books.append(book)
    return books


def encode(v: np.ndarray, centres: np.ndarray,
           books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, one byte per part) of each vector."""
    cell = _nearest(v, centres)
    rest = v - centres[cell]
    cuts = np.cumsum([0, *(b.shape[1] for b in books)])
    codes = np.column_stack([_nearest(rest[:, a:b], book)
                             for a, b, book in zip(cuts[:-1], cuts[1:], books)])
    return cell.astype(np.int32), codes.astype(np.uint8)


def build_cells(corpus: DataFrame, did: str, dvec: str, n_cells: int | None = None,
                subspaces: int = 16, seed: int = 7) -> Cells | None:
    """Fits and codes ``corpus(did long, dvec)``; None if it has no vector."""
    vectors = cut_lineage(corpus.where(F.col(dvec).isNotNull()).select(
        F.col(did).cast("long").alias("_did"), F.col(dvec).cast("array<double>").alias("_v")))
    n = vectors.count()
    if n == 0:
        return None
    sample = cut_lineage(vectors.orderBy(F.xxhash64("_did"), "_did").limit(SAMPLE_ROWS))
    cells = min(n, SAMPLE_ROWS, n_cells or max(1, round(math.sqrt(n))))
    few = np.array([r["_v"] for r in sample.orderBy(F.xxhash64("_did"), "_did")
                    .limit(CODE_ROWS).collect()])
    centres = _train_cells(sample, cells, seed, 10)[1] if cells > 1 else few.mean(
        axis=0, keepdims=True)
    books = fit_codes(few - centres[_nearest(few, centres)], subspaces,
                      np.random.default_rng(seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, codes = encode(_matrix(b.column(1)), centres, books)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(cell), pa.array([c.tobytes() for c in codes])],
                    names=["_did", "cell", "code"])

    coded = cut_lineage(vectors.mapInArrow(run, "_did long, cell int, code binary"))
    # a cell that holds most rows is spread over as many chunks as it needs
    parts = coded.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("parts"))
    chunks = (coded.join(bounded_broadcast(cut_lineage(parts), SAMPLE_ROWS), "cell")
              .withColumn("part", F.pmod(F.xxhash64("_did"), F.col("parts")))
              .groupBy("cell", "part")
              .agg(F.collect_list(F.struct("_did", "code")).alias("d"))
              .select("cell", F.col("d._did").alias("ids"), F.col("d.code").alias("code")))
    codes = cut_lineage(chunks)
    n_packs = max(1, math.ceil(n / blocks.PACK_ROWS))
    packs = cut_lineage(codes.groupBy(F.pmod(F.xxhash64("cell", F.get("ids", F.lit(0))),
                                             F.lit(n_packs)).alias("pack"))
                        .agg(F.collect_list(F.struct("cell", "ids", "code")).alias("d"))
                        .select("d"))
    return Cells(centres, books, codes, vectors, packs, packed(vectors, "_did", "_v"), n)


class Lookup:
    """Scores of coded vectors for some questions, and the best of each."""

    def __init__(self, q: np.ndarray, centres: np.ndarray, books: list[np.ndarray],
                 probes: int, keep: int):
        near = q @ centres.T
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        self.q, self.centres, self.books, self.keep = q, centres, books, keep
        self.probed = np.zeros(near.shape, bool)
        np.put_along_axis(self.probed, order, True, axis=1)
        self.best = Best(len(q), keep)
        self.looked = 0

    def add(self, cell: int, ids: np.ndarray, codes: np.ndarray) -> None:
        asked = np.flatnonzero(self.probed[:, cell])
        self.looked += len(asked) * len(ids)
        coded = self.centres[cell] + np.column_stack(
            [book[codes[:, part]] for part, book in enumerate(self.books)])
        for at in range(0, len(asked), SLICE):
            rows = asked[at:at + SLICE]
            score = self.q[rows] @ coded.T
            least = self.best.floor[rows]
            if len(ids) > self.keep and not np.isfinite(least).all():
                kth = np.partition(score, len(ids) - self.keep, axis=1)[:, len(ids) - self.keep]
                least = np.maximum(least, kth)
            r, c = np.divmod(np.flatnonzero(score >= least[:, None]), len(ids))
            self.best.add(rows[r], ids[c], score[r, c])


def search_cells(queries: DataFrame, qid: str, qvec: str, index: Cells | None, did: str, k: int,
                 probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """``qid, did, score, rank``: the k best of the ``rerank`` (20 k) best by codes in
    the ``probes`` cells next to each question. By default two thirds of all cells are
    probed, which is what vectors without any structure need for a recall of 0.9;
    clustered vectors need a few (both measured in the tests)."""
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], f"`{qid}` long, `{did}` long, score double, rank int")
    asked = packed(queries.select(F.col(qid).cast("long").alias("_qid"), F.col(qvec).alias("_q")),
                   "_qid", "_q")
    probes = probes or -(-2 * len(index.centres) // 3)
    short = _shortlists(asked, index, probes, rerank or 20 * k)
    scored = short.crossJoin(index.whole.select(F.col("ids").alias("dids"),
                                                F.col("v").alias("dv"))).mapInArrow(
        _rerank_fn(k), "_qid long, _did long, score double")
    order = Window.partitionBy("_qid").orderBy(F.desc("score"), "_did")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("_qid").alias(qid), F.col("_did").alias(did), "score", "rank"))


def _shortlists(asked: DataFrame, index: Cells, probes: int, keep: int) -> DataFrame:
    """``pack, ids, v`` of the packs of questions, with ``docs``, the ids of the ``keep``
    best by codes of all its questions in order, and whose they are (``rows``)."""
    shared = asked.sparkSession.sparkContext.broadcast((index.centres, index.books))
    # few tasks share a question, each goes through many codes (24 bytes a row)
    codes = index.packs.coalesce(max(1, math.ceil(index.n / TASK_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        found: dict[int, Lookup] = {}
        for b in batches:
            for pack, qids, v, d in zip(*b.columns):
                key = pack.as_py()
                if key not in found:
                    q = unpacked(v, len(qids.values)).copy()    # a view would keep the batch
                    found[key] = Lookup(q, centres, books, probes, keep)
                held = d.values
                for cell, docs, code in zip(held.field("cell").to_pylist(), held.field("ids"),
                                            held.field("code")):
                    found[key].add(cell, ids_of(docs.values), np.frombuffer(
                        b"".join(code.as_py()), np.uint8).reshape(-1, len(books)))
        for key, own in found.items():
            rows, docs, near = own.best.settle()
            yield pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([rows.astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([near], pa.list_(pa.float64()))],
                names=["pack", "rows", "docs", "near"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                best = Best(len(b.column(1)[i].values), keep)
                for part in b.column(3)[i]:
                    best.add(*(ids_of(part[c].values) for c in ("rows", "docs", "near")))
                rows, docs, _ = best.settle()
                order = np.argsort(docs, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, 1) for c in range(3)),
                     pa.array([rows[order].astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([docs[order]], pa.list_(pa.int64()))],
                    names=["pack", "ids", "v", "rows", "docs"])

    parts = asked.crossJoin(codes).mapInArrow(
        run, "pack long, rows array<int>, docs array<long>, near array<double>")
    lists = parts.groupBy("pack").agg(F.collect_list(F.struct("rows", "docs", "near")).alias("d"))
    return cut_lineage(asked.join(lists, "pack").select("pack", "ids", "v", "d").mapInArrow(
        merge, "pack long, ids array<long>, v binary, rows array<int>, docs array<long>"))


def _rerank_fn(k: int):
    """Rows ``pack, ids, v, rows, docs, dids, dv``: the k best of the shortlists by exact
    products, of those in the packs of vectors that a task meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, Best]] = {}
        for b in batches:
            for pack, qids, v, rows, docs, dids, dv in zip(*b.columns):
                own, ids, listed = ids_of(qids.values), ids_of(dids.values), ids_of(docs.values)
                q, d = unpacked(v, len(own)), unpacked(dv, len(ids))
                key = pack.as_py()
                if key not in found:
                    found[key] = own.copy(), Best(len(own), k)  # a view would keep the batch
                best = found[key][1]
                first = np.searchsorted(listed, ids)
                times = np.searchsorted(listed, ids, "right") - first
                doc = np.repeat(np.arange(len(ids)), times)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
                row = ids_of(rows.values)[np.repeat(first, times) + place]
                some = max(1, blocks.EXACT // max(1, q.shape[1]))
                for at in range(0, len(row), some):
                    r, c = row[at:at + some], doc[at:at + some]
                    best.add(r, ids[c], np.round(np.einsum("ij,ij->i", q[r], d[c]),
                                                 SCORE_DECIMALS))
        yield from found_rows(found, pa.int64(), pa.int64())
    return run


def recall(found: DataFrame, exact: DataFrame, qid: str, did: str) -> DataFrame:
    """One row: ``wanted`` rows of the exact result, how many of them were ``hit``, and
    their share. A document as good as the exact result's last one counts as hit."""
    least = exact.groupBy(qid).agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
    per = (least.join(found, qid, "left").groupBy(qid, "_n")
           .agg(F.sum(F.when(F.col("score") >= F.col("_least"), 1).otherwise(0)).alias("_hit")))
    return per.agg(F.sum("_n").alias("wanted"), F.sum("_hit").alias("hit"),
                   (F.sum("_hit") / F.sum("_n")).alias("recall"))
