"""Residual-coded cells: recall against the exact way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import approx, knn
from ledgerlens.sources.tables import Tables


def _frames(spark, vectors):
    c = spark.createDataFrame([(i, None if v is None else [float(x) for x in v])
                               for i, v in enumerate(vectors)], "did long, v array<double>")
    return c.select(F.col("did").alias("qid"), F.col("v").alias("q")), c


def test_recall_on_the_given_vectors(spark):
    emb = Tables(spark, "/root/testdata/sf0.1").embeddings.select(
        F.col("vec_id").alias("did"), F.col("embedding").alias("v"))
    q = emb.where("did % 10 = 0").select(F.col("did").alias("qid"), F.col("v").alias("q"))
    exact = knn.knn(q, "qid", "q", emb, "did", "v", 5)
    cells = approx.build_cells(emb, "did", "v")
    shares = [approx.recall(approx.search_cells(q, "qid", "q", cells, "did", 5, probes=p), exact,
                            "qid", "did").first()["recall"]
              for p in (3, None, len(cells.centres))]
    assert shares[0] < shares[1] <= shares[2] and shares[1] >= 0.9 and shares[2] >= 0.97


@pytest.mark.parametrize("rows", [7, 4096])
def test_all_cells_and_a_whole_list_are_exact(spark, monkeypatch, rows):
    monkeypatch.setattr(approx, "CHUNK_ROWS", rows)
    monkeypatch.setattr(approx, "SLICE", rows)
    rng = np.random.default_rng(2)
    vectors = [*rng.normal(size=(60, 6)).tolist(), None, [0.0] * 6, [0.0] * 6]
    vectors += [vectors[0]] * 30                                   # ties
    q, c = _frames(spark, vectors)
    cells = approx.build_cells(c, "did", "v", n_cells=5, subspaces=4)
    got = approx.search_cells(q, "qid", "q", cells, "did", 4, probes=5, rerank=1000)
    want = knn.knn(q, "qid", "q", c, "did", "v", 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_probes_find_clustered_neighbours(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    vectors = centre[np.arange(1000) % 20] + 0.02 * rng.normal(size=(1000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    q, c = _frames(spark, vectors)
    q = q.where("qid < 100")
    cells = approx.build_cells(c, "did", "v", n_cells=20, subspaces=8)
    found = approx.search_cells(q, "qid", "q", cells, "did", 5, probes=3)
    share = approx.recall(found, knn.knn(q, "qid", "q", c, "did", "v", 5), "qid", "did").first()
    assert share["recall"] >= 0.95
    own = approx.Lookup(vectors[:100], cells.centres, cells.books, 3, 100)
    for row in cells.codes.collect():
        own.add(row.cell, np.array(row.ids), np.frombuffer(
            b"".join(map(bytes, row.code)), np.uint8).reshape(len(row.ids), -1))
    assert own.looked < 0.25 * 100 * 1000


def test_empty_sides(spark):
    q, c = _frames(spark, [[1.0, 2.0], [2.0, 1.0]])
    assert approx.search_cells(q, "qid", "q", approx.build_cells(c.limit(0), "did", "v"), "did",
                               3).isEmpty()
    cells = approx.build_cells(c, "did", "v")
    assert approx.search_cells(q.limit(0), "qid", "q", cells, "did", 3).isEmpty()
    assert approx.search_cells(q, "qid", "q", cells, "did", 3, probes=1).count() >= 2


def test_chunks_hold_whole_cells_and_questions_share_a_product(spark, monkeypatch):
    """A cell is cut only when it is larger than a chunk, and a shortlist crosses no shuffle
    row by row."""
    monkeypatch.setattr(approx, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(9)
    q, c = _frames(spark, rng.normal(size=(300, 6)))
    cells = approx.build_cells(c, "did", "v", n_cells=10, subspaces=3)
    sizes = {}
    for row in cells.codes.collect():
        sizes.setdefault(row.cell, []).append(len(row.ids))
    assert all(len(s) <= -(-sum(s) // 50) for s in sizes.values())
    found = approx.search_cells(q, "qid", "q", cells, "did", 4, probes=10, rerank=300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1                 # the merge by question
    want = knn.knn(q, "qid", "q", c, "did", "v", 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
