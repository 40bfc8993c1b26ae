"""J2 at scale: exact top-k inner-product search over k-means cells.

The corpus is split into cells by k-means (``pyspark.ml``, trained on the
whole corpus). For a query q and a cell with centre c and radius r (largest
distance of a member to c), every member d satisfies

    q·d = q·c + q·(d − c) ≤ q·c + ‖q‖·r          (Cauchy–Schwarz)

so the bound ``ub(q, cell)`` caps every score inside the cell.

1. each query probes the ``n_probe`` cells with the highest bound;
2. the best k of those give the query a threshold s_k (its k-th score);
3. every other cell with ``ub ≥ s_k`` is searched as well — a cell below the
   threshold cannot hold a better document, so the result is **exact** (same
   rows as the blocked brute force, ties to the smaller document id).

Members of a cell are split into pieces of at most about ``chunk_rows``, and whole pieces are
packed together into rows of about ``blocks.PACK_ROWS`` vectors. In both passes every pack
of queries meets every pack of pieces (``blocks``: a cross join of two written tables, no
(query, cell) rows with copies of the vectors); within a pair of packs only the products of
queries that search the piece's cell are taken, and a query's k-th score so far is its
threshold. The centres (``n_cells × dim``) are the only thing shipped to tasks; their
count is a parameter, not data-sized.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import bounded_broadcast, cut_lineage, spread
from . import blocks
from .blocks import Best, best_products, found_rows, ids_of, packed, unpacked
from .knn import _arrow_type, knn

# bound slack: scores are rounded to 9 decimals before ranking
SLACK = 1e-7
MAX_CELLS = 1 << 16


def _train_cells(corpus: DataFrame, n_cells: int, seed: int, max_iter: int):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = corpus.select(array_to_vector("_v").alias("_f"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_f",
                   predictionCol="_cell").fit(feats)
    return model, np.array(model.clusterCenters(), dtype=np.float64)


def _bounds(qm: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    ub = qm @ centres.T + np.linalg.norm(qm, axis=1)[:, None] * radius[None, :]
    ub[:, ~np.isfinite(radius)] = -np.inf          # empty cells
    return ub


def _probed(queries: DataFrame, centres: np.ndarray, radius: np.ndarray,
            n_probe: int) -> DataFrame:
    """``_qid, _v, _probes``: the cells with the highest bounds of each query, -1 for
    empty cells. Written once, so both passes go by the same probes."""
    schema = T.StructType([*queries.schema.fields,
                           T.StructField("_probes", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ub = _bounds(blocks.matrix(b.column(1)), centres, radius)
                best = np.argsort(-ub, axis=1, kind="stable")[:, :n_probe]
                best = np.where(np.isfinite(np.take_along_axis(ub, best, 1)), best, -1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))],
                    names=schema.names)

    return cut_lineage(spread(queries).mapInArrow(run, schema))


def _probe_matrix(probes: pa.ListScalar) -> np.ndarray:
    """Of the probes of a pack."""
    return ids_of(probes.values.flatten()).reshape(len(probes.values), -1)


def _assigned(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """``_did, _v, _cell, _r``: the nearest cell of each vector and the distance to it."""
    schema = T.StructType([*corpus.schema.fields, T.StructField("_cell", T.IntegerType()),
                           T.StructField("_r", T.DoubleType())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                v = blocks.matrix(b.column(1))
                cell = ((centres * centres).sum(axis=1) - 2 * v @ centres.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(cell.astype(np.int32)),
                     pa.array(np.linalg.norm(v - centres[cell], axis=1))], names=schema.names)

    return cut_lineage(spread(corpus).mapInArrow(run, schema))


def _cell_packs(assigned: DataFrame, subs: DataFrame, n_rows: int) -> DataFrame:
    """``cells array<int>, starts array<int>, ids, v binary``: whole pieces of cells, the
    members of a piece one after another. Written once; one shuffle of the corpus."""
    n_packs = max(1, math.ceil(n_rows / blocks.PACK_ROWS))
    dtype = assigned.schema["_did"].dataType
    sub = F.pmod(F.xxhash64("_did"), F.col("_nsub")).cast("int")
    rows = (assigned.join(bounded_broadcast(subs, MAX_CELLS), "_cell")
            .select(F.pmod(F.xxhash64("_cell", sub), F.lit(n_packs)).alias("_pack"),
                    F.struct(F.col("_cell").alias("cell"), F.col("_did").alias("id"),
                             F.col("_v").alias("v")).alias("_s"))
            .groupBy("_pack").agg(F.collect_list("_s").alias("_s")).select("_s"))
    schema = T.StructType([T.StructField("cells", T.ArrayType(T.IntegerType())),
                           T.StructField("starts", T.ArrayType(T.IntegerType())),
                           T.StructField("ids", T.ArrayType(dtype)),
                           T.StructField("v", T.BinaryType())])

    def run(batches):
        for b in batches:
            for row in b.column(0):
                held = row.values
                cell = held.field("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                cells, starts = np.unique(cell[order], return_index=True)
                ids = held.field("id").take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cells], pa.list_(pa.int32())),
                     pa.array([np.append(starts, len(order))], pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     pa.array([blocks.matrix(held.field("v"))[order].tobytes()])],
                    names=schema.names)

    return cut_lineage(rows.mapInArrow(run, schema))


def _search_fn(centres: np.ndarray, radius: np.ndarray, k: int, block_rows: int, others: bool,
               qid_type: pa.DataType, did_type: pa.DataType):
    """Rows ``qpack, qids, thr, probes, qv, cells, starts, ids, v``: the best of the probed cells, or
    of all ``others`` whose bound reaches the query's k-th score (all non-empty ones
    when fewer than k documents were found)."""
    def run(batches):
        asked: dict[int, tuple[np.ndarray, Best]] = {}
        probes: dict[int, np.ndarray] = {}
        for b in batches:
            for pack, qids, thr, probe, qv, cells, starts, ids, v in zip(*b.columns):
                own, dids = ids_of(qids.values), ids_of(ids.values)
                q, d = unpacked(qv, len(own)), unpacked(v, len(dids))
                key = pack.as_py()
                if key not in asked:
                    floor = ids_of(thr.values).astype(np.float64)
                    asked[key] = own.copy(), Best(
                        len(own), k, np.where(np.isnan(floor), -np.inf, floor))
                    probes[key] = _probe_matrix(probe).copy()   # views would keep the batch
                best, cuts = asked[key][1], ids_of(starts.values)
                names = ids_of(cells.values)
                ub = _bounds(q, centres[names], radius[names]) if others else None
                for i, cell in enumerate(names):
                    mine = (probes[key] == cell).any(axis=1)
                    if others:
                        mine = ~mine & (ub[:, i] >= best.floor - SLACK)
                    rows, part = np.flatnonzero(mine), slice(cuts[i], cuts[i + 1])
                    for at in range(0, len(rows), block_rows):
                        r = rows[at:at + block_rows]
                        best_products(best, q[r], d[part], dids[part], r)
        yield from found_rows(asked, qid_type, did_type)
    return run


def _pairs_fn(centres: np.ndarray, radius: np.ndarray):
    """How many (query, cell) pairs each pass searches, of packs ``qids, thr, probes, qv``."""
    def run(batches):
        for b in batches:
            for qids, thr, probe, qv in zip(*b.columns):
                q = unpacked(qv, len(qids.values))
                floor = ids_of(thr.values).astype(np.float64)
                floor = np.where(np.isnan(floor), -np.inf, floor)
                need = _bounds(q, centres, radius) >= floor[:, None] - SLACK
                need[:, ~np.isfinite(radius)] = False
                probes = _probe_matrix(probe)
                for p in probes.T:
                    need[np.flatnonzero(p >= 0), p[p >= 0]] = False
                yield pa.RecordBatch.from_pydict(
                    {"first": [int((probes >= 0).sum())], "second": [int(need.sum())],
                     "n": [len(q)]})
    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_qid").orderBy(F.col("score").desc(), F.col("_did").asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_ivf(queries: DataFrame, qid: str, qvec: str, corpus: DataFrame, did: str, dvec: str,
            k: int, n_cells: int | None = None, n_probe: int = 2, block_rows: int = 1024,
            chunk_rows: int = 4096, seed: int = 7, max_iter: int = 10,
            stats: dict | None = None) -> DataFrame:
    """Exact top-k (qid, did, score, rank) by inner product. ``stats``, if
    given, receives the number of cells and of (query, cell) pairs searched
    in each pass (of the second those that the first pass's scores leave)."""
    spark = queries.sparkSession
    qtype, dtype = queries.schema[qid].dataType, corpus.schema[did].dataType
    corp = corpus.where(F.col(dvec).isNotNull()).select(
        F.col(did).alias("_did"), F.col(dvec).cast("array<double>").alias("_v"))
    qs = queries.where(F.col(qvec).isNotNull()).select(
        F.col(qid).alias("_qid"), F.col(qvec).cast("array<double>").alias("_v"))
    n_c = corp.count()
    out_schema = T.StructType([T.StructField(qid, qtype), T.StructField(did, dtype),
                               T.StructField("score", T.DoubleType()),
                               T.StructField("rank", T.IntegerType())])
    if n_c == 0:
        return spark.createDataFrame([], out_schema)
    if n_c == 1:                                       # nothing to cluster
        return knn(queries, qid, qvec, corpus, did, dvec, k)
    n_cells = min(n_cells or min(MAX_CELLS, max(1, round(math.sqrt(n_c)))), n_c)

    # 1. cells: centres, membership, radius and size per cell
    _, centres = _train_cells(corp, n_cells, seed, max_iter)
    assigned = _assigned(corp, centres)
    cell_rows = (assigned.groupBy("_cell")
                 .agg(F.max("_r").alias("_r"), F.count(F.lit(1)).alias("_n")).collect())
    # radius per cell; cells without members stay non-finite and are masked
    radius = np.full(len(centres), np.inf, dtype=np.float64)
    subs_rows = []
    for r in cell_rows:
        radius[r["_cell"]] = r["_r"] * (1 + 1e-9) + 1e-12
        subs_rows.append((r["_cell"], max(1, math.ceil(r["_n"] / chunk_rows))))
    subs = spark.createDataFrame(subs_rows, "_cell int, _nsub int")
    cells = _cell_packs(assigned, subs, n_c)
    hit_schema = T.StructType([T.StructField("_qid", qtype), T.StructField("_did", dtype),
                               T.StructField("score", T.DoubleType())])

    def search(asked: DataFrame, others: bool) -> DataFrame:
        packs = asked.select(F.col("pack").alias("qpack"), F.col("ids").alias("qids"),
                             F.col("_thr").alias("thr"), F.col("_probes").alias("probes"),
                             F.col("v").alias("qv"))
        return packs.crossJoin(cells).mapInArrow(
            _search_fn(centres, radius, k, block_rows, others, _arrow_type(qtype),
                       _arrow_type(dtype)), hit_schema)

    # 2. pass 1: the n_probe best cells of every query
    probed = _probed(qs, centres, radius, n_probe)
    none = F.lit(None).cast("double")
    first = packed(probed.withColumn("_thr", none), "_qid", "_v", "_thr", "_probes")
    top1 = cut_lineage(_top(search(first, others=False), k))

    # 3. pass 2: other cells whose bound reaches the k-th score
    thr = top1.groupBy("_qid").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_thr"))
    second = packed(probed.join(thr, "_qid", "left"), "_qid", "_v", "_thr", "_probes")
    if stats is not None:
        n = second.select("ids", "_thr", "_probes", "v").mapInArrow(
            _pairs_fn(centres, radius), "first long, second long, n long").agg(
            F.sum("first"), F.sum("second"), F.sum("n")).first()
        stats.update(cells=len(centres), pairs_pass1=n[0], pairs_pass2=n[1], queries=n[2])
    merged = top1.select("_qid", "_did", "score").unionByName(search(second, others=True))
    return _top(merged, k).select(F.col("_qid").alias(qid), F.col("_did").alias(did),
                                  "score", F.col("rank").cast("int").alias("rank"))
