import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import knn, retrieval


def _vecs(spark, n, d, seed, name):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], f"{name} long, v array<double>"), m


def test_blocked_knn_equals_brute_force(spark):
    q, qm = _vecs(spark, 37, 8, 1, "qid")
    c, cm = _vecs(spark, 300, 8, 2, "did")
    got = knn.knn(q, "qid", "v", c, "did", "v", 5, block_rows=10, chunk_rows=64).collect()
    s = np.round(qm @ cm.T, 9)
    for r in got:
        order = sorted(range(300), key=lambda j: (-s[r.qid, j], j))
        assert order[r.rank - 1] == r.did
    assert len(got) == 37 * 5


def test_knn_self_rank_and_small_corpus(spark):
    c, _ = _vecs(spark, 3, 4, 3, "did")
    q = c.select(F.col("did").alias("qid"), "v")
    got = knn.knn(q, "qid", "v", c, "did", "v", 5).collect()
    assert len(got) == 9                                        # fewer than k
    assert all(r.did == r.qid for r in got if r.rank == 1)


def test_depth_sweep_nested(spark):
    hits = spark.createDataFrame([(1, r, 10 + r, 1.0 / r) for r in range(1, 6)],
                                 "question_id long, rank int, row_id long, score double")
    sw = retrieval.depth_sweep(hits).collect()
    by_k = {k: {r.row_id for r in sw if r.k == k} for k in (1, 3, 5)}
    assert by_k[1] < by_k[3] < by_k[5] and len(by_k[5]) == 5


def test_ivf_knn_is_exact_and_prunes(spark):
    from ledgerlens.operators import ivf
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    pts = centres[rng.integers(0, 12, 900)] + 0.15 * rng.normal(size=(900, 16))
    pts /= np.linalg.norm(pts, axis=1, keepdims=True)
    c = spark.createDataFrame([(i, pts[i].tolist()) for i in range(900)], "did long, v array<double>")
    qm = pts[:60] + 0.05 * rng.normal(size=(60, 16))
    q = spark.createDataFrame([(i, qm[i].tolist()) for i in range(60)], "qid long, v array<double>")
    stats = {}
    got = ivf.knn_ivf(q, "qid", "v", c, "did", "v", 5, n_cells=12, n_probe=1,
                      block_rows=16, chunk_rows=32, stats=stats).collect()
    s = np.round(qm @ pts.T, 9)
    assert len(got) == 60 * 5
    for r in got:
        order = sorted(range(900), key=lambda j: (-s[r.qid, j], j))
        assert order[r.rank - 1] == r.did
    # the bound leaves most (query, cell) pairs unsearched
    assert stats["pairs_pass1"] + stats["pairs_pass2"] < 0.5 * 60 * 12


def test_ivf_knn_small_corpus_and_random_vectors(spark):
    from ledgerlens.operators import ivf
    c, cm = _vecs(spark, 3, 4, 3, "did")
    q = c.select(F.col("did").alias("qid"), "v")
    got = ivf.knn_ivf(q, "qid", "v", c, "did", "v", 5).collect()
    assert len(got) == 9 and all(r.did == r.qid for r in got if r.rank == 1)
    q2, qm = _vecs(spark, 25, 8, 11, "qid")
    c2, cm2 = _vecs(spark, 400, 8, 12, "did")
    got = ivf.knn_ivf(q2, "qid", "v", c2, "did", "v", 3, n_cells=9, n_probe=1).collect()
    s = np.round(qm @ cm2.T, 9)
    assert len(got) == 25 * 3
    for r in got:
        order = sorted(range(400), key=lambda j: (-s[r.qid, j], j))
        assert order[r.rank - 1] == r.did


def test_ivf_of_one_document(spark):
    from ledgerlens.operators import ivf
    c, _ = _vecs(spark, 1, 4, 3, "did")
    got = ivf.knn_ivf(c.select(F.col("did").alias("qid"), "v"), "qid", "v", c, "did", "v", 3)
    assert [(r.qid, r.did, r.rank) for r in got.collect()] == [(0, 0, 1)]


def test_knn_copies_no_side_in_a_shuffle(spark, monkeypatch):
    from ledgerlens.operators import blocks
    monkeypatch.setattr(blocks, "PAIRS", 50)
    c, cm = _vecs(spark, 120, 8, 5, "did")
    q, qm = _vecs(spark, 40, 8, 6, "qid")
    hits = knn.knn(q, "qid", "v", c, "did", "v", 5, block_rows=7, chunk_rows=9)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1                 # the merge by query
    s = np.round(qm @ cm.T, 9)
    want = [(i, j) for i in range(40) for j in sorted(range(120), key=lambda j: (-s[i, j], j))[:5]]
    assert sorted((r.qid, r.did) for r in hits.collect()) == sorted(want)


def test_best_products_are_those_of_double_products():
    from ledgerlens.operators.blocks import Best, best_products
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e-6, 1e18):               # beyond the range of single products as well
        d = rng.normal(size=(200, 6)) * scale
        d[50:90] = d[0]                           # ties
        d[90:140] = d[1] + 1e-9 * scale * rng.normal(size=(50, 6))     # near ties
        q = d[::7] / scale
        best = Best(len(q), 4)
        for at in range(0, 200, 64):
            best_products(best, q, d[at:at + 64], np.arange(at, min(at + 64, 200)))
        rows, ids, scores = best.settle()
        s = np.round(q @ d.T, 9)
        for i in range(len(q)):
            top = sorted(s[i], reverse=True)[:4]
            assert np.allclose(scores[rows == i], top, rtol=1e-12, atol=2e-9)
            if scale == 1.0:
                assert ids[rows == i].tolist() == sorted(range(200), key=lambda j: (-s[i, j], j))[:4]


def test_ivf_makes_no_rows_of_query_and_cell(spark):
    """The second pass pairs packs; rows with a copy of a vector for each (query, cell) pair
    would pass through an exchange."""
    from ledgerlens.operators import ivf
    c, _ = _vecs(spark, 500, 8, 21, "did")
    q, _ = _vecs(spark, 60, 8, 22, "qid")
    hits = ivf.knn_ivf(q, "qid", "v", c, "did", "v", 5, n_cells=20, n_probe=1, chunk_rows=16)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1                 # the merge by query
    exact = knn.knn(q, "qid", "v", c, "did", "v", 5)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, exact.collect()))


def test_products_of_two_packs_take_little_memory():
    """Also where all documents are alike, so that every pair ties."""
    import tracemalloc

    from ledgerlens.operators.blocks import PACK_ROWS, Best, best_products
    rng = np.random.default_rng(6)
    q = rng.normal(size=(PACK_ROWS, 16))
    for d in (rng.normal(size=(PACK_ROWS, 16)), np.ones((PACK_ROWS, 16))):
        tracemalloc.start()
        best_products(Best(len(q), 5), q, d, np.arange(len(d)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 64e6                # one matrix of 1024 by 4096 products alone takes 34 MB


def test_packs_of_questions_keep_no_batch_in_memory():
    """A task meets many batches, each with another pack of questions; what it keeps of a
    pack (ids, the best) must not be views that hold the batches they came with."""
    import io
    import tracemalloc

    import pyarrow as pa

    from ledgerlens.operators import approx, ivf
    n, dim, batches = 64, 256, 12
    rng = np.random.default_rng(8)
    ids = pa.array([list(range(n))], pa.list_(pa.int64()))
    v = pa.array([rng.normal(size=(n, dim)).tobytes()])
    pairs = {"ids": ids, "v": v}
    cells = {"cells": pa.array([[0]], pa.list_(pa.int32())),
             "starts": pa.array([[0, n]], pa.list_(pa.int32())), **pairs}
    none = {"thr": pa.array([[None] * n], pa.list_(pa.float64())),
            "probes": pa.array([[[0]] * n], pa.list_(pa.list_(pa.int32())))}
    listed = {"rows": pa.array([list(range(n))], pa.list_(pa.int32())), "docs": ids}
    centre, wide = np.zeros((1, dim)), np.full(1, 1e3)
    for run, asked, rest in (
            (knn._pack_products(5, pa.int64(), pa.int64(), 1024, 4096), {"ids": ids, "v": v}, pairs),
            (ivf._search_fn(centre, wide, 5, 1024, False, pa.int64(), pa.int64()),
             {"ids": ids, **none, "v": v}, cells),
            (approx._rerank_fn(5), {"ids": ids, "v": v, **listed}, pairs)):
        sink = io.BytesIO()
        for i in range(batches):
            columns = [pa.array([i]), *asked.values(), *rest.values()]
            batch = pa.RecordBatch.from_arrays(columns, [f"c{j}" for j in range(len(columns))])
            if not i:
                writer = pa.ipc.new_stream(sink, batch.schema)
            writer.write_batch(batch)
        writer.close()
        size = len(sink.getvalue()) / batches
        sink.seek(0)
        tracemalloc.start()
        kept, found = [], 0

        def stream():
            for one in pa.ipc.open_stream(sink):       # read to bytes, as from a worker's socket
                yield one
                kept.append(tracemalloc.get_traced_memory()[0])

        for out in run(stream()):
            found += out.num_rows
        tracemalloc.stop()
        assert found >= n * batches                    # of every pack
        assert kept[-1] - kept[1] < 3 * size           # the batch at hand, not all
