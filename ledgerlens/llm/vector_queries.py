"""Queries op11 and op13 and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import hard_negatives, simplex_clusters
from .vectors import whole_numbers

SCALE = 256.0
CENTROIDS, ROUNDS, SALT, DIM = 40, 5, "2", 64


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", moved.alias("label"), whole_numbers(F.col("embedding"), SCALE).alias("v"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")


def op13_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", whole_numbers(F.col("embedding"), SCALE).alias("v"))
    found = simplex_clusters.cluster(vectors, CENTROIDS, ROUNDS, SALT, DIM)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join("centroid", ",").cast("binary"), 256)
                        .alias("centroid_sha256"))


_WHOLE = """
          SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"""

_OP11 = f"""
        WITH w AS ({_WHOLE} AND vec_id IS NOT NULL AND label IS NOT NULL),
        r AS (
          SELECT vec_id, label, v::DOUBLE[] AS v FROM (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   v
            FROM w)
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
        s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
                 list_inner_product(a.v, b.v)::BIGINT AS score
          FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE a.vec_id % 100 = 0),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER o)::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT alike AND 80 * positive_score <= 100 * score
          AND 100 * score <= 100 * positive_score
        WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER o <= 5"""


def _rounds() -> str:
    parts = []
    for i in range(ROUNDS + 1):
        parts.append(f"""
        a{i} AS MATERIALIZED (
          SELECT row_id, min({{'d': d, 'c': c}}) AS best FROM (
            SELECT r.row_id, c.c,
                   (r.vv - 2 * list_inner_product(r.v, c.v)
                    + list_inner_product(c.v, c.v))::BIGINT AS d
            FROM r, c{i} c) GROUP BY row_id)""")
        if i < ROUNDS:
            parts.append(f"""
        s{i} AS (
          SELECT c, place, sum(x)::BIGINT AS total, count(*) AS n FROM (
            SELECT best.c AS c, unnest(r.v)::BIGINT AS x,
                   unnest(generate_series(1, len(r.v))) AS place
            FROM a{i} JOIN r USING (row_id)) GROUP BY c, place),
        c{i + 1} AS MATERIALIZED (
          SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
            SELECT c, list(((total - ((total % n) + n) % n) // n)::DOUBLE ORDER BY place) AS v
            FROM s{i} GROUP BY c) m USING (c))""")
    return ",".join(parts)


_OP13 = f"""
        WITH w AS ({_WHOLE} AND len(embedding) = {DIM}),
        r AS MATERIALIZED (
          SELECT row_number() OVER () AS row_id, vec_id, v::DOUBLE[] AS v,
                 list_inner_product(v::DOUBLE[], v::DOUBLE[]) AS vv FROM w),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (
                   ORDER BY sha256('{SALT}:' || vec_id) NULLS LAST, vec_id, v) - 1 AS c, v
          FROM r QUALIFY c < {CENTROIDS}),
        {_rounds().lstrip()},
        o AS (SELECT vec_id, best.c AS c, best.d AS d FROM a{ROUNDS} JOIN r USING (row_id))
        SELECT vec_id, c::INTEGER AS cluster, d AS distance,
               (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string([x::BIGINT for x in v], ',')) AS centroid_sha256
        FROM o JOIN c{ROUNDS} USING (c)"""

QUERIES = {f.__name__: f for f in (op11_hard_negatives, op13_simplex_clusters)}
ORACLES = {"op11_hard_negatives": _OP11, "op13_simplex_clusters": _OP13}
