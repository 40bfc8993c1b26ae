"""Packed rows for work on all pairs of two tables, and the k best of each question.

``packed`` turns up to ``PACK_ROWS`` vectors into one row (ids, and the matrix as bytes),
written once. ``crossJoin`` of two such tables brings every pack of one to every pack of
the other: Spark pairs the partitions of two scans, so neither table is copied into a
shuffle. A task keeps the best of its questions over all packs that it meets
(``Best``) and puts out k rows a question, not k for each pair of packs.

``best_products`` fills them. Products are first taken in single precision, whose error
is at most ``(dim + 8) * 2**-24 * |q| * |d|``; only pairs that may still be among the k best
by that bound are computed in double precision, so scores and ranks are those of the
double products. Where most pairs may be, the double products are taken at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, spread

SCORE_DECIMALS = 9
#: Rows of a pack; pairs of one product; numbers of the rows that are scored exactly at once.
PACK_ROWS, PAIRS, EXACT = 4096, 1 << 18, 1 << 20
#: Half a unit of the last decimal that scores keep, and a little.
ROUNDED = 10.0 ** -SCORE_DECIMALS
#: Beyond this, products in single precision might overflow.
LARGE = 1e30


def matrix(vectors: pa.Array) -> np.ndarray:
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def ids_of(ids: pa.Array) -> np.ndarray:
    """Of numbers a view: as long as it is held, so is the whole batch it came with."""
    return ids.to_numpy(zero_copy_only=False)


def packed(df: DataFrame, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    """``pack long, ids array, v binary`` and an array of each ``keep`` column, of the rows
    with a vector. Written once."""
    names = [id_col, *keep]
    rows = df.where(F.col(vec_col).isNotNull()).select(
        *names, F.col(vec_col).cast("array<double>").alias("_v"))
    schema = T.StructType([*(T.StructField(f"ids_{i}", T.ArrayType(rows.schema[c].dataType))
                             for i, c in enumerate(names)), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(at, PACK_ROWS)
                if held and sum(b.num_rows for b in held) + part.num_rows > PACK_ROWS:
                    yield pack(held)
                    held = []
                held.append(part)
        if held:
            yield pack(held)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = [whole.column(i).combine_chunks() for i in range(len(names) + 1)]
        out = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
               for c in columns[:-1]]
        return pa.RecordBatch.from_arrays(
            [*out, pa.array([matrix(columns[-1]).tobytes()])], names=schema.names)

    made = spread(rows).mapInArrow(run, schema).withColumn(
        "pack", F.monotonically_increasing_id())
    written = cut_lineage(made)
    return written.select("pack", F.col("ids_0").alias("ids"),
                          *(F.col(f"ids_{i + 1}").alias(c) for i, c in enumerate(keep)), "v")


def unpacked(v: pa.BinaryScalar, n: int) -> np.ndarray:
    """A view, like ``ids_of``."""
    return np.frombuffer(v.as_buffer(), np.float64).reshape(n, -1)


class Best:
    """The k best (score, id) of each of n questions: higher scores first, ties to the
    smaller id. ``floor`` is a score below which no more can come in."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.settled = self.pending = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor[rows]
        if good.any():
            self.parts.append((rows[good], ids[good], scores[good]))
            self.pending += int(good.sum())
            if self.pending > self.settled // 4:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, id, score) of what is kept, in order."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rows, ids, scores = (np.concatenate(x) for x in zip(*self.parts))
        if self.pending:
            by_id = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]
            order = np.lexsort((by_id, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = place < self.k
            last = place == self.k - 1
            self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last])
            rows, ids, scores = rows[keep], ids[keep], scores[keep]
            self.parts, self.settled, self.pending = [(rows, ids, scores)], len(rows), 0
        return rows, ids, scores


def best_products(best: Best, q: np.ndarray, d: np.ndarray, ids: np.ndarray,
                  rows: np.ndarray | None = None) -> None:
    """Adds the documents ``d`` to the best of the questions ``q`` (which are the ``rows``
    of ``best``, by default all in order), by rounded double products."""
    if not len(q) or not len(d):
        return
    rows = np.arange(len(q)) if rows is None else rows
    dim = q.shape[1]
    of_q, of_d = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (q, d))
    norm = of_q * of_d.max()
    single = bool((of_q < LARGE).all() and (of_d < LARGE).all() and (norm < LARGE).all())
    step = max(1, PAIRS // len(d))
    if single:
        q32, d32 = q.astype(np.float32), d.astype(np.float32).T
        slack = (dim + 8) * 2.0 ** -24 * norm + 1e-30
    for at in range(0, len(q), step):
        own = slice(at, at + step)
        near = rows[own]
        if single:
            s = q32[own] @ d32
            floor = best.floor[near]
            cold = np.flatnonzero(floor == -np.inf)
            if len(cold) and len(d) > best.k:
                floor = floor.copy()
                kth = np.partition(s[cold], len(d) - best.k, axis=1)[:, len(d) - best.k]
                floor[cold] = kth - slack[own][cold]
            # single comparisons: the bound goes to the next smaller float
            least = np.nextafter((floor - slack[own] - ROUNDED).astype(np.float32),
                                 np.float32(-np.inf))
            may = s >= least[:, None]
            if np.count_nonzero(may) * 8 < may.size:
                r, c = np.divmod(np.flatnonzero(may), len(d))
                del s, may
                some = max(1, EXACT // dim)
                for i in range(0, len(r), some):
                    rr, cc = r[i:i + some], c[i:i + some]
                    scores = np.einsum("ij,ij->i", q[at + rr], d[cc])
                    best.add(near[rr], ids[cc], np.round(scores, SCORE_DECIMALS))
                continue
        s = np.round(q[own] @ d.T, SCORE_DECIMALS)
        least = best.floor[near]
        if len(d) > best.k:
            least = np.maximum(least, np.partition(s, len(d) - best.k, axis=1)[:, len(d) - best.k])
        r, c = _first_k(s >= least[:, None], s, ids, best.k)
        best.add(near[r], ids[c], s[r, c])


def _first_k(may: np.ndarray, s: np.ndarray, ids: np.ndarray,
             k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs that may count, k a row at most: greater scores, then smaller ids."""
    by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    rows, cols = np.nonzero(may)
    order = np.lexsort((by_id[cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


def found_rows(questions: dict[int, tuple[np.ndarray, Best]], qid_type: pa.DataType,
               did_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """``_qid, _did, score`` of the best of each pack of questions."""
    for ids, best in questions.values():
        rows, docs, scores = best.settle()
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]).cast(qid_type), pa.array(docs).cast(did_type),
                 pa.array(scores)], names=["_qid", "_did", "score"])
