"""Hard negatives for anchors, mined with spanning-tree bounds over the anchors.

Anchors are put in an order that keeps similar ones together (by the signs of fixed
random projections) and cut into blocks. The anchors of a block are the nodes of
their minimum spanning tree (Prim). For neighbours p and a in the tree, and any
candidate c,

    score(p, c) - |a - p| * |c|  <=  score(a, c)  <=  score(p, c) + |a - p| * |c|,

so once the scores of a candidate at the parent are known, or bounded, they bound
its score at the child, down the tree. The root, and every anchor that has a child
close by, scores all candidates; any other anchor scores only the candidates whose
bounds overlap what it looks for:

* its positives: rows of its label whose upper bound reaches the least of the best
  it has so far;
* its negatives: rows of other labels whose bounds overlap the window of one of its
  positives (``low`` to ``high`` per cent of the positive's score), cut at the
  window's least of the best so far.

The candidates are written once and scanned in place; a task keeps only the best few
of each anchor and emits them at its end, so a label or a group of copies that holds
most rows costs a few rows per task. A slice of anchors whose vectors take at most
``SLICE_BYTES`` goes to the tasks as a broadcast; further slices scan the table again.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; an id is a key: of rows that repeat it, the least (label,
then vector) counts; rows are compared only with rows of as many components; ties go
to the smaller id; an anchor without positives, and a positive without negatives,
give no rows; no window is open below a positive with a score under 0; an empty
table gives no rows; a score that does not fit a long ends the query with an error;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import POSITION, ranked
from ..session import cut_lineage
from .vectors import exact, matrices

#: Anchors of one spanning tree; bytes of the vectors of a slice of anchors.
TREE, SLICE_BYTES = 256, 16 << 20
#: Candidates worked on at once, and in a task at least.
BLOCK, TASK_ROWS = 4096, 8192
#: A child nearer than this share of its parent's length counts as close by.
CLOSE = 0.25
#: Rounding of scores and bounds, as a share of the product of the lengths.
SLACK = 1e-9


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``, one row per id."""
    return (rows.where("vec_id is not null and label is not null and v is not null")
            .groupBy(F.col("vec_id").cast("long").alias("vec_id"))
            .agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "v")).alias("r"))
            .select("vec_id", "r.label", "r.v"))


def sign_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the signs of 62 fixed random projections as one number."""
    for batch in batches:
        for rows, v in matrices(batch, 2):
            planes = np.random.default_rng(v.shape[1]).normal(size=(v.shape[1], 62))
            key = ((v.astype(np.float64) @ planes) > 0) @ (1 << np.arange(62))
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.full(len(rows), v.shape[1])),
                 pa.array(key.astype(np.int64))], names=["vec_id", "label", "v", "dim", "key"])


@dataclass
class Tree:
    """Minimum spanning tree of a block of anchors, parents before children."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    slots: np.ndarray        # places of the anchors in their slice
    parent: np.ndarray       # place of the parent in this block; -1 at the root
    edge: np.ndarray         # distance to the parent
    anchors: np.ndarray      # that score all candidates (bool)
    children: np.ndarray     # number of each anchor's children

    @classmethod
    def over(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray,
             slots: np.ndarray) -> Tree:
        f = v.astype(np.float64)
        size = (f * f).sum(axis=1)
        apart = np.sqrt(np.maximum(size[:, None] + size - 2 * f @ f.T, 0))
        # what rounding may have taken off a distance is put back
        apart += 1e-7 * np.sqrt(size[:, None] + size)
        n = len(ids)
        near, to = apart[0].copy(), np.zeros(n, np.int64)
        near[0] = np.inf
        order, parent, edge = [0], [-1], [0.0]
        place = {0: 0}
        left = np.ones(n, bool)
        left[0] = False
        while left.any():
            i = int(np.where(left, near, np.inf).argmin())
            place[i] = len(order)
            order.append(i)
            parent.append(place[int(to[i])])
            edge.append(float(near[i]))
            left[i] = False
            closer = left & (apart[i] < near)
            near[closer], to[closer] = apart[i][closer], i
        parent, edge = np.array(parent), np.array(edge)
        length = np.sqrt(size)[order]
        whole = parent < 0
        close = np.flatnonzero((parent >= 0) & (edge < CLOSE * length[parent]))
        whole[parent[close]] = True
        return cls(ids[order], labels[order], v[order], slots[order], parent, edge, whole,
                   np.bincount(parent[parent >= 0], minlength=n))


class Best:
    """The best ``k`` (score, id) of each of ``n`` slots, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[list[int]] = [[] for _ in range(n)]
        self.ids: list[list[int]] = [[] for _ in range(n)]

    def floor(self, slot: int) -> float:
        """The least score that may still enter."""
        own = self.scores[slot]
        return own[-1] if len(own) == self.k else -np.inf

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            top = scores >= least
            scores, ids = scores[top], ids[top]
        both = sorted([*zip([-int(s) for s in scores], ids.tolist()),
                       *zip([-s for s in self.scores[slot]], self.ids[slot])])[:self.k]
        self.scores[slot] = [-s for s, _ in both]
        self.ids[slot] = [i for _, i in both]


class Scan:
    """One pass of candidates along the trees of a slice of anchors."""

    def __init__(self, trees: list[Tree]):
        self.trees, self.scored, self.pairs = trees, 0, 0

    def block(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        for tree in self.trees:
            if tree.v.shape[1] == v.shape[1]:
                self._walk(tree, ids, labels, v)

    def wanted(self, slot: int, label: int, ids, labels, low, high) -> np.ndarray:
        """Which candidates the anchor must score, by their bounds."""
        raise NotImplementedError

    def take(self, slot: int, label: int, ids, labels, scores) -> None:
        raise NotImplementedError

    def _walk(self, tree: Tree, ids, labels, v) -> None:
        ax, cx = exact(tree.v, v)
        length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        own = np.sqrt((tree.v.astype(np.float64) ** 2).sum(axis=1))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting = tree.children.copy()
        for a, parent in enumerate(tree.parent):
            slot, label = int(tree.slots[a]), int(tree.labels[a])
            most = own[a] * length
            most += SLACK * (1 + most)
            if parent < 0:
                low, high = -most, most
            else:
                low, high = bounds[parent]
                widen = tree.edge[a] * length + SLACK * (1 + most)
                low, high = np.maximum(low - widen, -most), np.minimum(high + widen, most)
                waiting[parent] -= 1
                if not waiting[parent]:
                    del bounds[parent]
            want = self.wanted(slot, label, ids, labels, low, high) & (ids != tree.ids[a])
            at = np.arange(len(ids)) if tree.anchors[a] else np.flatnonzero(want)
            self.scored += len(at)
            self.pairs += len(ids)
            if len(at):
                scores = cx[at] @ ax[a] if len(at) < len(ids) else cx @ ax[a]
                low, high = low.copy(), high.copy()
                low[at] = high[at] = scores.astype(np.float64)
                real = want[at]
                if real.any():
                    scores = scores[real]
                    self.take(slot, label, ids[at][real], labels[at][real],
                              scores if scores.dtype == object else scores.astype(np.int64))
            if waiting[a]:
                bounds[a] = low, high


class Positives(Scan):
    def __init__(self, trees: list[Tree], n: int, k: int):
        super().__init__(trees)
        self.best = Best(n, k)

    def wanted(self, slot, label, ids, labels, low, high):
        return (labels == label) & (high >= self.best.floor(slot))

    def take(self, slot, label, ids, labels, scores):
        self.best.add(slot, scores, ids)


class Negatives(Scan):
    """``windows``: of each slot, (least, greatest) score of each positive."""

    def __init__(self, trees: list[Tree], windows: list[list[tuple[int, int]]], k: int):
        super().__init__(trees)
        self.windows = windows
        self.first = np.cumsum([0, *map(len, windows)])
        self.best = Best(int(self.first[-1]), k)

    def _open(self, slot: int) -> Iterator[tuple[int, float, int]]:
        for i, (low, high) in enumerate(self.windows[slot], int(self.first[slot])):
            yield i, max(low, self.best.floor(i)), high

    def wanted(self, slot, label, ids, labels, low, high):
        want = np.zeros(len(ids), bool)
        for _, least, most in self._open(slot):
            want |= (high >= least) & (low <= most)
        return want & (labels != label)

    def take(self, slot, label, ids, labels, scores):
        for i, least, most in list(self._open(slot)):
            inside = (scores >= least) & (scores <= most)
            if inside.any():
                self.best.add(i, scores[inside], ids[inside])


def trees_of(rows: list) -> list[Tree]:
    """Spanning trees over the anchors of a slice, in their order, by blocks of as
    many components."""
    trees = []
    dims = np.array([r["dim"] for r in rows])
    for dim in np.unique(dims):
        places = np.flatnonzero(dims == dim)
        for at in range(0, len(places), TREE):
            slots = places[at:at + TREE]
            trees.append(Tree.over(
                np.array([rows[i]["vec_id"] for i in slots], np.int64),
                np.array([rows[i]["label"] for i in slots], np.int64),
                np.array([rows[i]["v"] for i in slots], np.int64).reshape(len(slots), dim), slots))
    return trees


def _scanned(candidates: DataFrame, kind: type[Scan], trees: list[Tree], args: tuple,
             keys: list[tuple], names: str) -> DataFrame:
    """The best of every slot that each task finds: ``names``, then id and score.
    ``keys`` has what names each slot."""
    shared = candidates.sparkSession.sparkContext.broadcast((trees, args, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_trees, own_args, keyed = shared.value
        scan = kind(shared_trees, *own_args)           # a task's own; the trees are only read
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, v in matrices(batch, 2):
                for at in range(0, len(rows), BLOCK):
                    part = rows[at:at + BLOCK]
                    scan.block(ids[part], labels[part], v[at:at + BLOCK])
        out = [(*keyed[slot], i, s) for slot in range(len(keyed))
               for s, i in zip(scan.best.scores[slot], scan.best.ids[slot])]
        for at in range(0, len(out), 100_000):
            columns = zip(*out[at:at + 100_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=fields)

    fields = [*names.split(", "), "vec_id", "score"]
    return candidates.select("vec_id", "label", "v").mapInArrow(
        run, ", ".join(f"{f} long" for f in fields))


def _best_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``:
    for each anchor (rows of ``rows(vec_id, label, v array<long>)`` that ``is_anchor``
    marks) and each of its ``positives`` best rows of its label, the ``negatives`` best
    rows of other labels with a score from ``low`` to ``high`` per cent of the
    positive's."""
    spark = rows.sparkSession
    written = cut_lineage(usable(rows))
    n_tasks = max(1, -(-written.count() // TASK_ROWS))
    candidates = cut_lineage(written.repartition(n_tasks))
    keyed = written.where(is_anchor).mapInArrow(
        sign_key, "vec_id long, label long, v array<long>, dim long, key long")
    anchors = cut_lineage(ranked(keyed, [F.col(c) for c in ("dim", "key", "vec_id")]))
    size = anchors.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    per_slice = max(TREE, SLICE_BYTES // (8 * max(size["dim"] or 1, 1)))
    found = None
    for start in range(0, size["n"], per_slice):
        got = _mine_slice(candidates, anchors.where(
            (F.col(POSITION) >= start) & (F.col(POSITION) < start + per_slice)),
            positives, negatives, low, high)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, "
                                     "negative_id long, positive_score long, negative_score long")
    return found


def _mine_slice(candidates: DataFrame, anchors: DataFrame, positives: int, negatives: int,
                low: int, high: int) -> DataFrame:
    """``mine`` for anchors that fit in ``SLICE_BYTES``."""
    rows = anchors.select("vec_id", "label", "v", "dim").orderBy(POSITION).collect()
    ids, trees = [r["vec_id"] for r in rows], trees_of(rows)
    near = _scanned(candidates, Positives, trees, (len(ids), positives), [(i,) for i in ids],
                    "anchor_id")
    alike = cut_lineage(_best_rows(near, ["anchor_id"], positives)
        .select("anchor_id", F.col("vec_id").alias("positive_id"),
                F.col("score").alias("positive_score")))
    slot = {i: at for at, i in enumerate(ids)}
    windows: list[list[tuple[int, int]]] = [[] for _ in ids]
    keys: list[list[tuple[int, int]]] = [[] for _ in ids]
    for r in sorted(alike.collect()):                  # ``positives`` rows per anchor at most
        score = r["positive_score"]
        windows[slot[r["anchor_id"]]].append((-(-low * score // 100), high * score // 100))
        keys[slot[r["anchor_id"]]].append((r["anchor_id"], r["positive_id"]))
    far = _scanned(candidates, Negatives, trees, (windows, negatives),
                   [k for own in keys for k in own], "anchor_id, positive_id")
    best = _best_rows(far, ["anchor_id", "positive_id"], negatives)
    return cut_lineage(best.join(alike, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")))
