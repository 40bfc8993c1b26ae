"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (words, A-Z lower-cased, without the ASCII signs
around them), each hashed to one of ``BUCKETS`` numbers. The machine adds a bias, a
weight per term and, for every pair of terms, the product of their factor
vectors: insult and group mention together can count for more than the sum of
both. All pairs of a text cost one pass over its terms, as half of (square of
the sum minus sum of the squares) of the factors.

It is trained by Adam on the log-likelihood over a bounded sample of labelled
rows. Terms in fewer than ``MIN_TEXTS`` of its texts keep zero weight, and so do those
that show neither an effect of their own (share of texts that differs between the
labels by ``MIN_APART`` standard errors) nor one together with another term: they would
only be learnt by heart. Effects of pairs are looked for among the ``PAIR_TERMS`` most
frequent terms: the toxic share with both, less that with either alone, plus that with
neither, is 0 where two terms merely add up; pairs whose value is ``PAIR_APART`` standard
errors off keep both terms, whatever each does alone.

Defined cases: a null or empty text has no terms and gets the bias alone; rows
that repeat are scored each; all terms of a long text count; without labelled rows
of both classes every score is the share of toxic labels (0.5 without any label); an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import PieceCache, groups, raw_texts, worker_state
from .labelled import training_sample

BUCKETS = 1 << 18
FACTORS = 4
#: Documents in the training sample; texts of it that a term must occur in; standard errors.
SAMPLE_DOCS, MIN_TEXTS, MIN_APART = 12_000, 3, 4.0
#: For pairs: most frequent terms looked at, texts in each of the four cases, standard errors.
PAIR_TERMS, PAIR_TEXTS, PAIR_APART = 1000, 20, 8.0
EPOCHS, RATE, RIDGE, FACTOR_RIDGE = 150, 0.05, 2e-5, 1e-3
CACHE_PIECES = 400_000
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def term_bucket(piece: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(piece.lower().strip(SIGNS) or piece) & (BUCKETS - 1)


class TermSets:
    """Distinct buckets of the terms of texts, of those that ``used`` marks."""

    def __init__(self, used: np.ndarray | None = None):
        def make(pieces: list[bytes]) -> list[int]:
            found = [term_bucket(p) for p in pieces]
            return found if used is None else [b if used[b] else -1 for b in found]

        self.pieces = PieceCache(make, CACHE_PIECES)

    def __call__(self, raws: list[bytes]) -> Iterator[list[int]]:
        for start, end in groups(raws):
            cuts = [list(set(raw.split())) for raw in raws[start:end]]
            for found in map(set, self.pieces.values(cuts)):
                found.discard(-1)
                yield sorted(found)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray       # (BUCKETS,) float32
    factor: np.ndarray       # (BUCKETS, FACTORS) float32
    used: np.ndarray         # (BUCKETS,) bool

    def scores(self, sets: list[list[int]]) -> np.ndarray:
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        terms = np.fromiter((t for s in sets for t in s), np.int64, int(n.sum()))
        return _sigmoid(_raw(terms, n, self.bias, self.weight, self.factor)[0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sum(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of lengths ``n`` (a run may be empty)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def _raw(terms, n, bias, weight, factor):
    own = factor[terms].astype(np.float64)
    summed = _sum(own, n)
    pairs = 0.5 * ((summed ** 2) - _sum(own ** 2, n)).sum(axis=1)
    return bias + _sum(weight[terms].astype(np.float64), n) + pairs, summed, own


def paired_terms(sets: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Terms of the pairs that count for other than the sum of both; ``held`` has the
    number of texts of each term."""
    common = np.argsort(-held, kind="stable")[:PAIR_TERMS]
    common = common[held[common] >= 2 * PAIR_TEXTS]
    place = np.full(BUCKETS, -1, np.int64)
    place[common] = np.arange(len(common))
    has = np.zeros((len(sets), len(common)), np.float32)
    for row, own in zip(has, sets):
        at = place[own]
        row[at[at >= 0]] = 1

    def cases(rows: np.ndarray) -> np.ndarray:
        """Texts with both, with the first only, the second only, neither."""
        both, one = rows.T @ rows, rows.sum(axis=0)
        return np.stack([both, one[:, None] - both, one[None] - both,
                         len(rows) - one[:, None] - one[None] + both])

    texts, toxic = cases(has), cases(has[y == 1])
    share = (toxic + 0.5) / (texts + 1)
    off = share[0] - share[1] - share[2] + share[3]
    error = np.sqrt((share * (1 - share) / (texts + 1)).sum(axis=0))
    kept = (np.abs(off) >= PAIR_APART * error) & (texts.min(axis=0) >= PAIR_TEXTS)
    np.fill_diagonal(kept, False)
    return common[kept.any(axis=1)]


def fit(sets: list[np.ndarray], y: np.ndarray) -> Machine:
    used = np.zeros(BUCKETS, bool)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(y[0])
        return Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))),
                       np.zeros(BUCKETS, np.float32),
                       np.zeros((BUCKETS, FACTORS), np.float32), used)
    everything = np.concatenate(sets).astype(np.int64)
    toxic = np.repeat(y, [len(s) for s in sets])
    held, among = np.bincount(everything, minlength=BUCKETS), y.sum()
    with_label = np.bincount(everything, toxic, BUCKETS)
    share = held / len(y)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / among + 1 / (len(y) - among)))
    apart = np.abs(with_label / among - (held - with_label) / (len(y) - among)) / spread
    used[(held >= MIN_TEXTS) & (apart >= MIN_APART)] = True
    used[paired_terms(sets, y, held)] = True
    number = np.cumsum(used) - 1
    kept = [number[s[used[s]]] for s in sets]
    n = np.fromiter(map(len, kept), np.int64, len(kept))
    terms, text = np.concatenate(kept), np.repeat(np.arange(len(kept)), n)
    m, rng = int(used.sum()), np.random.default_rng(5)
    theta = [np.array([np.log(y.mean() / (1 - y.mean()))]), np.zeros(m),
             rng.normal(0, 0.01, (m, FACTORS))]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for step in range(1, EPOCHS + 1):
        raw, summed, own = _raw(terms, n, theta[0][0], theta[1], theta[2])
        slope = (_sigmoid(raw) - y) / len(y)
        each = slope[text]
        around = each[:, None] * (summed[text] - own)
        grads = [np.array([slope.sum()]),
                 np.bincount(terms, each, m) + RIDGE * theta[1],
                 np.column_stack([np.bincount(terms, around[:, f], m)
                                  for f in range(FACTORS)]) + FACTOR_RIDGE * theta[2]]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g ** 2
            theta[i] = theta[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (
                np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-6)
    weight = np.zeros(BUCKETS, np.float32)
    factor = np.zeros((BUCKETS, FACTORS), np.float32)
    weight[used], factor[used] = theta[1], theta[2]
    return Machine(float(theta[0][0]), weight, factor, used)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column,
          sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Fits on at most ``sample_docs`` labelled documents; their term numbers, not
    their texts, come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = TermSets()
        for batch in batches:
            found = [np.array(s, "<u4").tobytes() for s in sets(raw_texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary())],
                names=["doc_id", "y", "terms"])

    sample = training_sample(docs, labels, "toxic", may_learn, sample_docs)
    rows = sorted(sample.select("doc_id", "text", "y").mapInArrow(
        run, "doc_id long, y int, terms binary").collect())
    return fit([np.frombuffer(r["terms"], "<u4").astype(np.int64) for r in rows],
               np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score double`` of every row. Narrow: no shuffle. The machine
    (5 MB, whatever the data) is broadcast once."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    name = uuid.uuid4().hex             # of this machine, for what a worker keeps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kept = worker_state("terms", name, lambda: TermSets(own.used))
        for batch in batches:
            keys, raws = batch.column(0).cast(pa.int64()), raw_texts(batch.column(1))
            sets = kept(raws)
            scores = own.scores(list(sets)) if raws else np.empty(0)
            yield pa.RecordBatch.from_arrays([keys, pa.array(scores)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")
