"""Hard negatives and centroid clustering against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives, simplex_clusters
from ledgerlens.llm.vectors import whole_numbers

SCHEMA = "vec_id long, embedding array<double>, label int, v int, rank int, key string, score double"


def table(spark, rows):
    """rows: (vec_id, embedding, label); the other columns have names the operators use."""
    full = [(*r, 1, 2, "k", 0.5) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def scaled(rows, scale, dim=None):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) \
                and (dim is None or len(v) == dim):
            out.append((i, [math.floor(scale * x) for x in v], label))
    return out


def brute_negatives(rows, every, k_pos, k_neg):
    best = {}
    for i, v, label in scaled(rows, 256):
        if i is not None and label is not None:
            best[i] = min(best.get(i, (label, v)), (label, v))
    out = set()
    for a, (label, q) in best.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v)), i, own)
                        for i, (own, v) in best.items() if i != a and len(v) == len(q))
        for minus, p, _ in [s for s in scores if s[2] == label][:k_pos]:
            far = [(-n, i) for n, i, own in scores
                   if own != label and 80 * -minus <= 100 * -n <= 100 * -minus][:k_neg]
            out |= {(a, p, r + 1, i, -minus, n) for r, (n, i) in enumerate(far)}
    return out


def mined(spark, rows, every, k_pos=5, k_neg=5):
    df = table(spark, rows).withColumn("v", whole_numbers(F.col("embedding"), 256.0))
    found = hard_negatives.mine(df, F.col("vec_id") % every == 0, k_pos, k_neg)
    return {tuple(r) for r in found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score").collect()}


def clustered(n, centres, dim, spread, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, dim))
    return [(i, (centre[i % centres] + spread * rng.normal(size=dim)).tolist(), i // 3 % 4)
            for i in range(n)]


ODD = [(901, None, 1), (902, [1.0, None], 1), (903, [math.nan] * 8, 1), (904, [math.inf] * 8, 0),
       (None, [0.1] * 8, 1), (905, [0.3] * 8, None), (906, [], 1), (910, [], 2), (920, [1.0, 2.0], 1),
       (921, [1.0, 2.0], 1), (922, [0.9, 2.0], 0), (10, [0.0] * 8, 3)]


@pytest.mark.parametrize("sizes", [(256, 4096, 16 << 20), (7, 40, 2000)])
def test_negatives_equal_brute_force(spark, monkeypatch, sizes):
    for name, n in zip(("TREE", "BLOCK", "SLICE_BYTES"), sizes):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = clustered(300, 9, 8, 0.3)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]        # ties
    assert mined(spark, rows + ODD, 10) == brute_negatives(rows + ODD, 10, 5, 5)


def test_negatives_of_few_rows(spark):
    assert mined(spark, [], 10) == set()
    assert mined(spark, [(10, [1.0], 0)], 10) == set()
    assert mined(spark, [(10, [1.0], 0), (11, [1.0], 0)], 10) == set()
    # a window needs a positive score; scores that only long or larger numbers hold stay exact
    below = [(10, [1.0, 0.0], 0), (11, [-1.0, 0.0], 0), (12, [-0.9, 0.0], 1)]
    assert mined(spark, below, 10) == set()
    large = [(10, [1e6, 1.0], 0), (11, [1e6, 3.0], 0), (12, [9e5, 2.0], 1), (13, [9e5, 2.0], 1)]
    assert mined(spark, large, 10) == brute_negatives(large, 10, 5, 5) != set()


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="fit"):
        mined(spark, [(10, [1e300], 0)], 10)


def test_tree_bounds_leave_out_scores():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 32))
    v = np.floor(256 * (centre[np.arange(2400) % 12] + 0.02 * rng.normal(size=(2400, 32))))
    v, ids, labels = v.astype(np.int64), np.arange(2400), np.arange(2400) // 12 % 5
    at = np.arange(0, 2400, 10)
    trees = [hard_negatives.Tree.over(ids[at], labels[at], v[at], np.arange(len(at)))]
    near = hard_negatives.Positives(trees, len(at), 5)
    near.block(ids, labels, v)
    windows = [[(-(-80 * s // 100), s) for s in own] for own in near.best.scores]
    far = hard_negatives.Negatives(trees, windows, 5)
    far.block(ids, labels, v)
    assert near.scored < 0.6 * near.pairs and far.scored < 0.6 * far.pairs
    scores = v[at] @ v.T
    for slot, a in enumerate(at):
        own = sorted((-scores[slot, j], j) for j in ids if labels[j] == labels[a] and j != a)[:5]
        assert [j for _, j in own] == near.best.ids[slot]


def brute_clusters(rows, k, rounds, salt, dim):
    kept = [(i, v) for i, v, _ in scaled(rows, 256, dim)]

    def key(row):
        i, v = row
        return (i is None, "" if i is None else hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(),
                -1 if i is None else i, v)

    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        for j, own in members.items():
            centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    whole = sum(d for _, _, d in found)
    of = {j: sum(d for _, c, d in found if c == j) for _, j, _ in found}
    return sorted((str(i), j, d, of[j], whole, tuple(centroids[j])) for i, j, d in found)


def run_clusters(spark, rows, k, rounds, dim, pivots=40):
    df = table(spark, rows).withColumn("v", whole_numbers(F.col("embedding"), 256.0))
    found = simplex_clusters.cluster(df, k, rounds, "2", dim, pivots)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia,
                   tuple(r.centroid)) for r in found.collect())


@pytest.mark.parametrize("pivots", [1, 3, 40])
def test_clusters_equal_brute_force(spark, pivots):
    rows = clustered(240, 11, 8, 0.5)
    rows += [(1000 + i, rows[0][1], 0) for i in range(70)] + [rows[5], rows[5]] + ODD
    assert run_clusters(spark, rows, 12, 4, 8, pivots) == brute_clusters(rows, 12, 4, "2", 8)


def test_clusters_of_few_or_equal_or_large_vectors(spark):
    assert run_clusters(spark, [], 3, 2, 2) == []
    few = [(1, [0.5, 0.25], 0), (2, [-0.1, 3.0], 0)]
    equal = [(i, [0.5, 0.25], 0) for i in range(9)]
    large = [(i, [1e6 * i, -2e6 * i], 0) for i in range(9)]
    for rows in (few, equal, large):
        assert run_clusters(spark, rows, 3, 2, 2) == brute_clusters(rows, 3, 2, "2", 2)


def test_simplex_bounds_hold_and_leave_out_distances():
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 24)) * 200
    v = np.floor(centre[np.arange(4000) % 40] + 8 * rng.normal(size=(4000, 24))).astype(np.int64)
    centroids = v[:40]
    simplex = simplex_clusters.Simplex(centroids, 8)
    a, b = simplex.apexes(v), simplex.apexes(centroids)
    true = ((v[:, None] - centroids) ** 2).sum(axis=2)
    body = ((a[:, None, :-1] - b[:, :-1]) ** 2).sum(axis=2)
    assert (body + (a[:, None, -1] - b[:, -1]) ** 2 <= true + 1e-6 * (1 + true)).all()
    assert (body + (a[:, None, -1] + b[:, -1]) ** 2 >= true - 1e-6 * (1 + true)).all()
    nearest = simplex_clusters.Nearest(simplex, centroids)
    number, square = nearest(v, a)
    assert (number == true.argmin(axis=1)).all() and (square == true.min(axis=1)).all()
    assert nearest.compared < 0.1 * true.size
