"""Exact top-k nearest neighbours by inner product (= cosine on
unit vectors), as blocked matrix products.

Plan (no row-level cross join, no pair rows, no copies in a shuffle):

1. corpus rows and queries are packed (``blocks.packed``): one row holds the
   vectors of up to ``blocks.PACK_ROWS`` rows, written once;
2. a cross join of the two packed tables brings every pack of queries to every
   pack of the corpus (the inherent cost of exact search): Spark pairs the
   partitions of their scans;
3. NumPy products of ``block_rows`` queries and ``chunk_rows`` documents in
   ``mapInArrow``; a task keeps the k best of each query over all packs it
   meets and emits them at its end;
4. a ``row_number() <= k`` window per query (partial ``WindowGroupLimit``
   before the shuffle) merges the tasks' winners.

Scores are rounded to 9 decimals before ranking and ties go to the smaller
document id, so the ranking does not depend on summation order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import (SCORE_DECIMALS, Best, best_products, found_rows, ids_of,  # noqa: F401
                     matrix as _matrix, packed, unpacked)


def _pack_products(k: int, qid_type: pa.DataType, did_type: pa.DataType, block_rows: int,
                   chunk_rows: int):
    """Rows ``qpack, qids, qv, ids, v``: a pack of queries and one of documents."""
    def run(batches):
        asked: dict[int, tuple[np.ndarray, Best]] = {}
        for b in batches:
            for pack, qids, qv, ids, v in zip(*b.columns):
                if pack.as_py() not in asked:
                    own = ids_of(qids.values).copy()        # a view would keep the batch
                    asked[pack.as_py()] = own, Best(len(own), k)
                own, best = asked[pack.as_py()]
                q, dids = unpacked(qv, len(own)), ids_of(ids.values)
                d = unpacked(v, len(dids))
                for at in range(0, len(q), block_rows):
                    rows = np.arange(at, min(at + block_rows, len(q)))
                    for to in range(0, len(d), chunk_rows):
                        best_products(best, q[rows], d[to:to + chunk_rows],
                                      dids[to:to + chunk_rows], rows)
        yield from found_rows(asked, qid_type, did_type)
    return run


def _arrow_type(dt: T.DataType) -> pa.DataType:
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(),
            T.StringType: pa.string()}[type(dt)]


def knn(queries: DataFrame, qid: str, qvec: str, corpus: DataFrame, did: str, dvec: str,
        k: int, block_rows: int = 1024, chunk_rows: int = 4096) -> DataFrame:
    """Exact top-k: (qid, did, score, rank). Fewer than k rows per query
    when the corpus is smaller than k."""
    asked = packed(queries, qid, qvec).select(
        F.col("pack").alias("qpack"), F.col("ids").alias("qids"), F.col("v").alias("qv"))
    pairs = asked.crossJoin(packed(corpus, did, dvec).select("ids", "v"))
    qtype, dtype = queries.schema[qid].dataType, corpus.schema[did].dataType
    local = pairs.mapInArrow(
        _pack_products(k, _arrow_type(qtype), _arrow_type(dtype), block_rows, chunk_rows),
        T.StructType([T.StructField("_qid", qtype), T.StructField("_did", dtype),
                      T.StructField("score", T.DoubleType())]))
    w = Window.partitionBy("_qid").orderBy(F.col("score").desc(), F.col("_did").asc())
    return (local.withColumn("rank", F.row_number().over(w))
                 .where(F.col("rank") <= k)
                 .select(F.col("_qid").alias(qid), F.col("_did").alias(did), "score", "rank"))
