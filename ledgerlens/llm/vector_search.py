"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, few at the coarse level and more at the finer
one. Of each segment the mean m and the deviation d (length of the rest after the
mean is taken off) are kept. For a segment of n components

    <q, c> <= n * m(q) * m(c) + d(q) * d(c),

so the sum over segments bounds the inner product from above, that is, it bounds
the squared distance |q|^2 + |c|^2 - 2<q, c> from below, and the bound tightens from
coarse to fine. A block of queries meets the chunks of candidates of a task one after
the other. The k-th best score so far is a query's threshold; before there is one, the
exact scores of the candidates with the best coarse bounds give it. Candidates whose
coarse bound is below the thresholds of all queries of a sub-block are dropped, then
those whose fine bound is; exact products are computed for the survivors. Nothing is
approximate.

Candidates go to chunks, and queries to blocks, in turn, so equal or frequent vectors
spread evenly; the size of either is bounded. Each chunk and each block is one row,
written once. A Cartesian product of the two tables pairs the partitions of their scans,
so no block is copied for the chunks that it meets, neither into a shuffle nor into a
broadcast. A task keeps the k best of its queries and puts them out at its end.

Defined cases: vectors that are null or hold a null or non-finite component take no
part; an id is a key: of rows that repeat it, the least vector counts; rows without
an id take no part; vectors are compared only with vectors of their own length;
an empty table gives no rows; zero-length vectors score 0; components or scores that do
not fit a long end the query with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import Best, found_rows, ids_of
from ..session import cut_lineage
from . import vectors
from .vectors import exact, matrices

#: Rows of a chunk of candidates, of a block of queries, queries pruned together.
CHUNK_ROWS, BLOCK_ROWS, TOGETHER = 4096, 2048, 64
#: Chunks that are packed in one task; bytes of a chunk's or block's vectors as longs.
TASK_CHUNKS, PACK_BYTES = 2, 16 << 20
#: Rounding of bounds, as a share of the product of the lengths.
SLACK = 1e-9
#: Segments at the coarse and fine level.
LEVELS = (4, 16)


def whole_numbers(vector: Column, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of every component, as longs; null if the vector
    cannot take part."""
    return vectors.whole_numbers(vector, scale)


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Rows (sqrt(n) * mean of each segment, deviation of each segment)."""
    dim = v.shape[1]
    cuts = np.linspace(0, dim, min(segments, dim) + 1).astype(int)
    n = np.diff(cuts)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / n
    rest = np.add.reduceat((v - np.repeat(mean, n, axis=1)) ** 2, cuts[:-1], axis=1)
    return np.hstack([np.sqrt(n) * mean, np.sqrt(rest)])


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query id, candidate id, score) of the k best candidates of each query, a
    query's own id excluded, and how many products were computed."""
    best = Best(len(q_ids), k)
    work = scan(best, q_ids, q, c_ids, c)
    rows, ids, scores = best.settle()
    return q_ids[rows], ids, scores, work


def scan(best: Best, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray,
         c: np.ndarray) -> int:
    """Adds a chunk of candidates to the best of each query, a query's own id
    excluded; how many products were computed."""
    order = np.argsort(c_ids)
    c_ids, c = c_ids[order], c[order]
    (qx, cx), work, k = exact(q, c), 0, best.k
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    usable = q.shape[1] > 0
    levels = [(segment_statistics(qf, s), segment_statistics(cf, s)) for s in LEVELS] \
        if usable else []
    of_q, of_c = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (qf, cf))
    slack = SLACK * (1 + of_q * of_c.max(initial=0))

    def chosen(table: np.ndarray, left: np.ndarray) -> np.ndarray:
        return table if len(left) == len(table) else table[left]

    for at in range(0, len(q_ids), TOGETHER):
        rows = np.arange(at, min(at + TOGETHER, len(q_ids)))
        ids, left, floor = q_ids[rows], np.arange(len(c_ids)), best.floor[rows]
        cold = floor == -np.inf
        if levels and (len(c_ids) > 4 * k or not cold.any()):
            bound = levels[0][0][rows] @ levels[0][1].T
            if cold.any():
                own = ids[cold][:, None] == c_ids[None, :]
                first = np.argpartition(-np.where(own, -np.inf, bound[cold]), k, axis=1)[:, :k]
                seed = np.einsum("qd,qkd->qk", qx[rows[cold]], cx[first])
                floor[cold] = seed.min(axis=1).astype(np.float64)
            for level, (qs, cs) in enumerate(levels):
                if level:
                    bound = qs[rows] @ chosen(cs, left).T
                left = left[(bound >= (floor - slack[rows])[:, None]).any(axis=0)]
        scores = qx[rows] @ chosen(cx, left).T
        if scores.dtype == object:
            if np.abs(scores).max(initial=0) >= 1 << 61:
                raise OverflowError("a score does not fit a long")
            scores = scores.astype(np.int64)
        work += scores.size
        if cold.any() and len(left) > k + 1:           # one of the k + 1 best may be the query
            least = np.partition(scores[cold], len(left) - k - 1, axis=1)[:, len(left) - k - 1]
            floor[cold] = np.maximum(floor[cold], least)
        row, col = _first(scores, (scores >= floor[:, None])
                          & (ids[:, None] != c_ids[left][None, :]), k)
        best.add(rows[row], c_ids[left[col]], scores[row, col].astype(np.int64))
    return work


def _first(scores: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what may count, the k greatest of a row at most, ties to the
    first columns."""
    row, col = np.nonzero(may)
    many = np.bincount(row, minlength=len(may))
    if many.max(initial=0) <= k:
        return row, col
    ends, keep = np.cumsum(many), np.ones(len(row), bool)
    for i in np.flatnonzero(many > k):
        own = slice(ends[i] - many[i], ends[i])
        keep[own] = False
        keep[own.start + np.argsort(-scores[i, col[own]], kind="stable")[:k]] = True
    return row[keep], col[keep]


def _smallest(v: np.ndarray) -> np.ndarray:
    """The numbers in the smallest of numpy's integer types that holds them."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64)
                         if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def packed(rows: DataFrame, task_rows: int, pack_rows: int) -> DataFrame:
    """``pack long, dim int, ids array<long>, v binary`` of up to ``pack_rows`` of
    ``rows(vec_id, v)`` with vectors of the same length, about ``task_rows`` dealt to a
    task. Written once; ``unpacked`` reads ``v``."""
    n_tasks = max(1, -(-rows.count() // task_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, v in matrices(batch, 1):
                dim = v.shape[1]
                most = max(1, min(pack_rows, PACK_BYTES // (8 * max(dim, 1))))
                for part in np.array_split(np.arange(len(at)), -(-len(at) // most)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([ids[at[part]]]),
                         pa.array([_smallest(v[part]).tobytes()])], names=["dim", "ids", "v"])

    made = rows.select("vec_id", "v").repartition(n_tasks).mapInArrow(
        run, "dim int, ids array<long>, v binary")
    return cut_lineage(made.withColumn("pack", F.monotonically_increasing_id()))


def unpacked(v: pa.BinaryScalar, n: int, dim: int) -> np.ndarray:
    if not n * dim:
        return np.zeros((n, dim), np.int64)
    whole = v.as_buffer()
    return np.frombuffer(whole, f"i{whole.size // (n * dim)}").reshape(n, dim).astype(np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest inner products of each
    of ``queries(vec_id, v array<long>)`` among ``candidates(vec_id, v)``."""
    def usable(df: DataFrame) -> DataFrame:
        return (df.where("vec_id is not null and v is not null")
                .groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v")))

    chunks = packed(cut_lineage(usable(candidates)), TASK_CHUNKS * CHUNK_ROWS, CHUNK_ROWS)
    blocks = packed(cut_lineage(usable(queries)), BLOCK_ROWS, BLOCK_ROWS).select(
        "pack", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("v").alias("q"))
    # not as an equality, by which Spark would deal all packs of a length to one task
    alike = F.col("dim").between(F.col("q_dim"), F.col("q_dim"))
    pairs = chunks.select("dim", "ids", "v").join(blocks.hint("shuffle_replicate_nl"), alike)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            for pack, dim, q_ids, q, c_ids, c in zip(*batch.columns):
                if pack.as_py() not in asked:
                    own = ids_of(q_ids.values).copy()       # a view would keep the batch
                    asked[pack.as_py()] = own, Best(len(own), k)
                own, best = asked[pack.as_py()]
                others, n = ids_of(c_ids.values), dim.as_py()
                scan(best, own, unpacked(q, len(own), n), others, unpacked(c, len(others), n))
        yield from found_rows(asked, pa.int64(), pa.int64())

    near = (pairs.select("pack", "dim", "q_ids", "q", "ids", "v")
            .mapInArrow(run, "_qid long, _did long, score long"))
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.select(F.col("_qid").alias("query_id"), F.col("_did").alias("vec_id"), "score")
            .withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
