"""Centroid clustering (Lloyd rounds over integers) with n-simplex projection.

A few pivots, taken from the first centroids, are fixed for the whole run. Their
mutual distances place them as the corners of a simplex, in lower triangular
coordinates. The distances of a vector to the pivots then place it as an apex over
that simplex: one coordinate for each edge direction and its height above them. The
distances are computed once and the apexes are written with the vectors.

For two apexes (x, g) and (y, h), with coordinates x and y and heights g and h,

    |x - y|^2 + (g - h)^2  <=  squared distance  <=  |x - y|^2 + (g + h)^2.

In each round every centroid's apex meets every vector's apex. Centroids whose lower
bound is above the vector's least upper bound are out. The others are compared
exactly, in whole numbers, by ascending lower bound, until the next lower bound is
above the best distance found. Bounds carry a slack for rounding, so the nearest
centroid, and every one tied with it, is always compared exactly.

A task sends one sum per cluster and component, so a cluster that holds most
vectors costs no more than a small one; the driver sees k rows of ``dim`` numbers.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component take no part; vectors that repeat, also under one id, count as
often as they occur; rows without an id take part, and are the last choice as first
centroids; fewer vectors than k give fewer centroids; equal first centroids stay
centroids, ties go to the smaller number; an empty table gives no rows; sums or
distances that do not fit a long end the query with an error; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .vectors import exact, matrices

#: Share of the squared distances by which a bound may be off through rounding.
SLACK = 1e-7
#: A pivot must stand at least this share of the greatest distance above the others.
APART = 1e-3
#: Vectors that are compared at once.
BLOCK = 4096


class Simplex:
    """Pivots and their simplex; see the module docstring."""

    def __init__(self, points: np.ndarray, most: int):
        """The first point is a pivot; then the one that stands highest above the
        simplex so far, up to ``most`` or until none stands clear of it."""
        points = points.astype(np.float64)
        chosen, corners = [0], np.zeros((1, 0))
        widest = max(_distances(points, points[:1]).max(), 1e-300)
        while len(chosen) < min(most, len(points)):
            self.pivots, self.corners = points[chosen], corners
            height = self.apexes(points)[:, -1]
            best = int(height.argmax())
            if height[best] <= APART * widest:
                break
            corners = np.vstack([np.hstack([corners, np.zeros((len(corners), 1))]),
                                 self.apexes(points[best:best + 1])])
            chosen.append(best)
        self.pivots, self.corners = points[chosen], corners

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Apex coordinates of each vector from its distances to the pivots, the
        height last. With the first corner at the origin, the distances to it
        and to corner c give c . x = (d0^2 - dc^2 + |c|^2) / 2, solved corner by
        corner because corner i has i coordinates."""
        to = _distances(vectors, self.pivots) ** 2
        c = self.corners
        x = np.zeros((len(vectors), c.shape[1]))
        for i in range(1, len(c)):
            right = (to[:, 0] - to[:, i] + c[i] @ c[i]) / 2
            x[:, i - 1] = (right - x[:, :i - 1] @ c[i, :i - 1]) / c[i, i - 1]
        return np.column_stack([x, np.sqrt(np.maximum(to[:, 0] - (x * x).sum(axis=1), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class Nearest:
    """Nearest centroid of vectors that come with their apexes."""

    def __init__(self, simplex: Simplex, centroids: np.ndarray):
        self.centroids, self.apexes = centroids, simplex.apexes(centroids)
        self.compared = 0

    def __call__(self, v: np.ndarray, apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row."""
        parts = [self._block(v[i:i + BLOCK], apexes[i:i + BLOCK])
                 for i in range(0, len(v), BLOCK)]
        return (np.concatenate([p[0] for p in parts]),
                np.concatenate([p[1] for p in parts]))

    def _block(self, v: np.ndarray, apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, g = apexes[:, :-1], apexes[:, -1:]
        y, h = self.apexes[:, :-1], self.apexes[:, -1]
        sizes = (apexes ** 2).sum(axis=1)[:, None] + (self.apexes ** 2).sum(axis=1)
        low = sizes - 2 * (x @ y.T + g * h)
        slack = SLACK * (1 + sizes)
        least_upper = (low + 4 * g * h + slack).min(axis=1)
        low -= slack
        low[low > least_upper[:, None]] = np.inf
        order = np.argsort(low, axis=1, kind="stable")
        vx, cx = exact(v, self.centroids)
        number = np.full(len(v), -1, np.int64)
        best = np.full(len(v), np.inf)                 # for pruning only
        found = np.zeros(len(v), vx.dtype)
        rows = np.arange(len(v))
        for step in range(order.shape[1]):
            rows = rows[low[rows, order[rows, step]] <= best[rows]]
            if not len(rows):
                break
            at = order[rows, step]
            gap = vx[rows] - cx[at]
            square = (gap * gap).sum(axis=1)
            self.compared += len(rows)
            better = ((number[rows] < 0) | (square < found[rows])
                      | ((square == found[rows]) & (at < number[rows])))
            won = rows[better]
            number[won], found[won] = at[better], square[better]
            # a hair above, so that a tie beyond a double's digits is still compared
            best[won] = square[better].astype(np.float64) * (1 + 1e-12)
        return number, found if found.dtype == object else found.astype(np.int64)


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors (rows of the result) with the smallest SHA-256 of
    ``salt:<vec_id>``, in the order of the hash."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = (kept.select("vec_id", "v", key.alias("key"))
            .orderBy(F.asc_nulls_last("key"), "vec_id", "v").limit(k).collect())
    return np.array([r["v"] for r in rows], np.int64)


def _with_apexes(kept: DataFrame, simplex: Simplex) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())),
                        ("apex", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in matrices(batch, 1):
                apex = simplex.apexes(v)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * apex.shape[1]
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(schema.field(1).type),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(apex.ravel()))],
                    schema=schema)

    return kept.select("vec_id", "v").mapInArrow(
        run, "vec_id long, v array<long>, apex array<double>")


def _table(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _mapped(table: DataFrame, simplex: Simplex, centroids: np.ndarray, make: Callable,
            schema: str) -> DataFrame:
    """``make(batch, vectors, numbers, distances)`` over the written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(simplex, centroids)
        for batch in batches:
            if batch.num_rows:
                v = _table(batch, 1)
                yield make(batch, v, *nearest(v, _table(batch, 2)))

    return table.mapInArrow(run, schema)


def _sums(batch, v, number, distance) -> pa.RecordBatch:
    """Count and sum of each component of the clusters of a batch."""
    clusters, place = np.unique(number, return_inverse=True)
    if len(v) * int(np.abs(v).max(initial=0)) >= 1 << 62:
        v = v.astype(object)
    total = np.zeros((len(clusters), v.shape[1]), v.dtype)
    np.add.at(total, place, v)
    dim = v.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(clusters, dim)), pa.array(np.tile(np.arange(dim), len(clusters))),
         pa.array(total.ravel().tolist(), pa.int64()),
         pa.array(np.repeat(np.bincount(place), dim))],
        names=["cluster", "place", "total", "n"])


def _moved(table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; those of empty clusters stay."""
    parts = _mapped(table, simplex, centroids, _sums,
                    "cluster long, place long, total long, n long")
    rows = parts.groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    moved = centroids.copy()
    for r in rows:                                     # k * dim at most
        moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return moved


def _assigned(batch, v, number, distance) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(number.astype(np.int32)),
         pa.array(distance.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])


RESULT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
          "centroid array<long>")


def cluster(vectors: DataFrame, k: int, rounds: int, salt: str, dim: int,
            pivots: int = 40) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>``
    of every vector of ``vectors(vec_id, v array<long>)`` that has ``dim``
    components, after ``rounds`` rounds and one more assignment."""
    spark = vectors.sparkSession
    kept = spread(vectors).select(F.col("vec_id").cast("long"), "v").where(F.size("v") == dim)
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    simplex = Simplex(centroids, pivots)
    table = cut_lineage(_with_apexes(kept, simplex))
    for _ in range(rounds):
        centroids = _moved(table, simplex, centroids)
    found = cut_lineage(_mapped(table, simplex, centroids, _assigned,
                                "vec_id long, cluster int, distance long"))
    totals = {r["cluster"]: int(r["sum"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}    # k at most
    whole = sum(totals.values())
    of_cluster = spark.createDataFrame(
        [(i, totals[i], whole, c.tolist()) for i, c in enumerate(centroids) if i in totals],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
