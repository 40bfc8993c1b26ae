import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import near_dups, vector_search
from ledgerlens.operators.blocks import Best


def brute_topk(rows, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(64 * x)) for x in v]
            best[i] = min(best.get(i, w), w)
    out = set()
    for i, q in best.items():
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j)
                            for j, c in best.items() if j != i and len(c) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def run_topk(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = df.select("vec_id", vector_search.whole_numbers(F.col("embedding")).alias("v"))
    return {tuple(r) for r in vector_search.top_k(v.where("vec_id % 20 = 0"), v, k).collect()}


@pytest.mark.parametrize("together", [(4096, 2048, 64), (40, 4, 3)])
def test_topk_equals_brute_force(spark, monkeypatch, together):
    for name, n in zip(("CHUNK_ROWS", "BLOCK_ROWS", "TOGETHER"), together):
        monkeypatch.setattr(vector_search, name, n)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 6] + 0.2 * rng.normal(size=16)], 0)
            for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(60)]            # ties
    rows += [(2001, None, 0), (2002, [1.0, None], 0), (2003, [float("nan")] * 16, 0),
             (2004, [float("inf")] * 16, 0), (None, rows[1][1], 0), (2020, [], 0), (2021, [], 0),
             (5, [0.0] * 16, 0), (2040, [1.0, 2.0], 0)]
    assert run_topk(spark, rows, 7) == brute_topk([r[:2] for r in rows], 7)


def test_topk_of_nothing(spark):
    assert run_topk(spark, [], 3) == set()
    assert run_topk(spark, [(20, [1.0], 0)], 3) == set()


def test_topk_copies_no_block_for_its_chunks(spark, monkeypatch):
    """Blocks copied for each chunk made a broadcast of 2.0 MiB here; no table is sent now."""
    monkeypatch.setattr(vector_search, "CHUNK_ROWS", 16)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 25)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 16) / 64], 0) for i in range(2000)]
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, str(256 << 10))
    try:
        assert run_topk(spark, rows, 5) == brute_topk([r[:2] for r in rows], 5)
    finally:
        spark.conf.unset(limit)


def test_thresholds_hold_for_the_next_chunk():
    rng = np.random.default_rng(9)
    q = np.repeat([[40] * 32 + [-40] * 32], 10, axis=0) + rng.integers(-3, 4, (10, 64))
    near, far = (s * q[rng.integers(0, 10, 200)] + rng.integers(-3, 4, (200, 64)) for s in (1, -1))
    best, ids = Best(10, 5), np.arange(10) + 1000
    assert vector_search.scan(best, ids, q, np.arange(200), near) > 0
    assert vector_search.scan(best, ids, q, np.arange(200, 400), far) == 0
    assert vector_search.scan(best, ids, q, np.arange(400, 404), 2 * q[:4]) > 0
    rows, found, scores = best.settle()
    every = q @ np.vstack([near, 2 * q[:4]]).T
    of = np.append(np.arange(200), np.arange(400, 404))
    for i in range(10):
        want = sorted(zip(-every[i], of))[:5]
        assert [(-s, c) for s, c in zip(scores[rows == i], found[rows == i])] == want


@pytest.mark.parametrize("dim", [13, 50, 64])
def test_bounds_allow_for_the_rounding_of_large_components(dim):
    sign = np.where(np.arange(dim) < dim // 2, 1, -1) * (np.arange(dim) < dim // 2 * 2)
    for seed, large in enumerate([10 ** 8, 1 << 27, 3 * 10 ** 8] * 4):
        rng = np.random.default_rng(seed)
        q, c = large * sign + rng.integers(-1, 2, (1, dim)), large + rng.integers(-1, 2, (400, dim))
        _, ids, scores, _ = vector_search.search(np.array([1000]), q, np.arange(400), c, 5)
        want = sorted(zip((-q @ c.T)[0], range(400)))[:5]
        assert sorted(zip(-scores, ids)) == want


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(20, 64)), rng.normal(size=(50, 64))
    for s in vector_search.LEVELS:
        bound = vector_search.segment_statistics(q, s) @ vector_search.segment_statistics(c, s).T
        assert (bound >= q @ c.T - 1e-9).all()


def test_pruning_leaves_out_products():
    rng = np.random.default_rng(2)
    steps = np.repeat(rng.integers(-60, 60, (8, 4)), 16, axis=1)     # coarse structure
    c = steps[rng.integers(0, 8, 2000)] + rng.integers(-2, 3, (2000, 64))
    q = np.repeat(c[:1], 64, axis=0) + rng.integers(-2, 3, (64, 64))
    *_, work = vector_search.search(np.arange(64) + 10_000, q, np.arange(2000), c, 5)
    assert work < 0.6 * 64 * 2000


def words(text):
    return tuple((text or "").encode().lower().split())


def brute_classes(rows, width, similarity):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({w[k:k + width] for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and \
                    100 * len(a & b) >= round(100 * similarity) * len(a | b):
                p, q = find(rows[i][0]), find(rows[j][0])
                parent[max(p, q)] = min(p, q)
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0]))
                   for r, s in zip(rows, sets)), key=str)


def family(rng, n, length, edits):
    base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10 ** 6))
        out.append(" ".join(w))
    return out


def test_classes_equal_brute_force(spark, make_docs):
    rng = random.Random(4)
    texts = [t for n, length, edits in ((40, 60, 3), (60, 120, 6), (30, 12, 1), (25, 5, 1))
             for t in family(rng, n, length, edits)]
    texts += ["same text of a group"] * 30 + ["Two words", "two  WORDS", "", None, " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (7, "another text under an old id")]
    got = near_dups.near_duplicates(make_docs(rows), 4, 0.8).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows, 4, 0.8)


def test_repeated_ids_keep_every_text(spark, make_docs):
    """Each text under a repeated id has a near copy of its own."""
    rng, rows = random.Random(8), []
    for i in range(10, 210, 10):
        one, two, three = (family(rng, 1, 60, 0)[0] for _ in range(3))
        rows += [(i + 5, one), (i + 5, two), (i + 5, three), (i + 9, two + " more"),
                 (i + 7, one + " more"), (i + 1, three + " more")]
    got = near_dups.near_duplicates(make_docs(rows), 4, 0.8).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == \
        sorted((i, i // 10 * 10 + 1) for i, _ in rows)


def test_keep_one_leaves_one_of_each_class(spark, make_docs, odd_docs, no_docs):
    kept = near_dups.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    ids = [i for i, _ in rows if i is not None]
    assert sorted(ids) == [0, 1, 2, 3, 4, 6, 7, 8]                  # 5 equals 4
    assert sum(i is None for i, _ in rows) == 2
    assert near_dups.keep_one(no_docs).count() == 0


def test_signature_agreement_tracks_similarity():
    rng = np.random.default_rng(5)
    for n in (5, 60, 2000):
        shared = near_dups._mixed(rng.integers(0, 1 << 62, 9 * n).astype(np.uint64))
        a, b = np.unique(shared[:8 * n]), np.unique(shared[n:])
        agree = (near_dups.signature(a) == near_dups.signature(b)).mean()
        assert abs(agree - 7 / 9) < 0.15


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50)], "a long, b long")
    found = defaultdict(set)
    for r in near_dups.components(edges).collect():
        found[r.comp].add(r.node)
    assert found == {0: set(range(41)), 50: {50, 100}}
