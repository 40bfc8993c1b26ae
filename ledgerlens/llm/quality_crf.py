"""Document quality by a linear-chain conditional random field over lines.

Every line of a text (cut at ``\\n``) gets features of its own and of the lines
before and after it: length, words, share of distinct words, word length, shares
of capitals, digits, bars, punctuation and symbols. A two-state chain labels
the lines good or bad. It is trained on documents whose lines all carry the
document's label, by gradient ascent on the exact conditional likelihood
(forward-backward over padded batches), on a bounded sample of labelled rows.

A document's score is the mean of its lines' marginals for "good", weighted by
line length, put on a probability scale by a logistic curve fitted on the
same sample.

Defined cases: a null or empty text is one empty line of weight one; repeated
rows are scored each; every line of a long text counts; without labelled rows of
both classes every score is the share of good labels (0.5 without any label);
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import groups, raw_texts, worker_state
from .labelled import training_sample

#: Documents in the training sample, and lines of all of them together.
SAMPLE_DOCS, SAMPLE_LINES = 6000, 300_000
EPOCHS, RATE, RIDGE = 60, 0.08, 1e-4
#: Texts of this many bytes are worked on at once.
BLOCK_BYTES = 4 << 20

_CLASS = np.full(256, 1, np.uint8)                       # 1: letters, also beyond ASCII
for _k, _chars in ((0, b" \t\r\x0b\x0c"), (2, bytes(range(65, 91))), (3, b"0123456789"),
                   (4, b"|"), (5, b".,;:'\"?()-"), (7, b"!")):
    _CLASS[list(_chars)] = _k
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 1 and not chr(b).isalpha()]] = 6
_CLASS[10] = 0
N_OWN = 16


@dataclass
class Lines:
    """Features of all lines of some texts, line after line."""

    own: np.ndarray          # (lines, N_OWN)
    size: np.ndarray         # bytes of each line, one at least
    first: np.ndarray        # first line of each text; one more at the end

    def full(self) -> np.ndarray:
        """Own features, those of the line before and of the line after."""
        before, after = np.zeros_like(self.own), np.zeros_like(self.own)
        before[1:], after[:-1] = self.own[:-1], self.own[1:]
        before[self.first[:-1]] = 0
        after[self.first[1:] - 1] = 0
        return np.hstack([self.own, before, after])


def lines_of(raws: list[bytes]) -> Lines:
    blob = b"\n".join(raws)
    codes = np.frombuffer(blob, np.uint8)
    cuts = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], cuts + 1]).astype(np.int64)
    ends = np.concatenate([cuts, [len(codes)]]).astype(np.int64)
    classes = _CLASS[codes]
    counts = np.empty((len(starts), 8))
    for k in range(8):
        sums = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(classes == k, out=sums[1:])
        counts[:, k] = sums[ends] - sums[starts]
    words = np.empty((len(starts), 2))
    for i, line in enumerate(blob.split(b"\n")):
        own = line.split()
        words[i] = len(own), len(set(own))
    n = np.maximum(ends - starts, 1).astype(float)
    share = counts / n[:, None]
    n_words = np.maximum(words[:, 0], 1)
    distinct = words[:, 1] / n_words
    long = np.log1p(n_words) / 6
    own = np.column_stack([
        np.ones(len(n)), n <= 1, np.log1p(n) / 8, long, distinct, distinct * long,
        (distinct < 0.5) * (n_words >= 6), np.minimum(n / n_words / 10, 3),
        share[:, 2] * 2, share[:, 3] * 4, share[:, 4] * 10, share[:, 5] * 5,
        share[:, 6] * 5, share[:, 7] * 10, share[:, 1],
        (share[:, 2] > 0.5) * (n_words >= 3)])
    per_text = np.fromiter((raw.count(b"\n") + 1 for raw in raws), np.int64, len(raws))
    return Lines(own.astype(np.float32), n, np.concatenate([[0], np.cumsum(per_text)]))


def messages(node: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """Forward and backward log-odds (good against bad) of padded chains;
    ``node``: log-odds of the lines alone, ``trans[i, j]``: weight of i then j."""
    t00, t01, t10, t11 = trans.ravel()
    ahead, back = node.copy(), np.zeros_like(node)
    n = mask.sum(axis=0)
    for t in range(1, node.shape[1]):
        a = ahead[:n[t], t - 1]
        ahead[:n[t], t] += np.logaddexp(a + t11, t01) - np.logaddexp(a + t10, t00)
    for t in range(node.shape[1] - 2, -1, -1):
        b = node[:n[t + 1], t + 1] + back[:n[t + 1], t + 1]
        back[:n[t + 1], t] = np.logaddexp(b + t11, t10) - np.logaddexp(b + t01, t00)
    return ahead, back


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def blocks(first: np.ndarray, lines: int = 50_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose padded tables stay small."""
    start = 0
    while start < len(first) - 1:
        end = max(start + 1, int(np.searchsorted(first, first[start] + lines, "right")) - 1)
        yield start, min(end, len(first) - 1)
        start = end


@dataclass
class Crf:
    weights: np.ndarray      # of the full features
    trans: np.ndarray        # (2, 2)
    curve: tuple[float, float]

    def chain_scores(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of each text."""
        node = lines.full() @ self.weights
        marginal = np.empty(len(node))
        for start, end in blocks(lines.first):
            own = lines.first[start:end + 1]
            for group in _alike(own):
                at, mask, _ = _padded(own, group)
                table = np.where(mask, node[at], 0)
                ahead, back = messages(table, mask, self.trans)
                marginal[at[mask]] = _sigmoid(ahead + back)[mask]
        total = np.add.reduceat(marginal * lines.size, lines.first[:-1])
        return total / np.add.reduceat(lines.size, lines.first[:-1])

    def scores(self, raws: list[bytes]) -> np.ndarray:
        if not raws:
            return np.empty(0)
        a, b = self.curve
        return _sigmoid(a * self.chain_scores(lines_of(raws)) + b)


def _alike(first: np.ndarray) -> Iterator[np.ndarray]:
    """Texts grouped by the power of two of their number of lines."""
    size = np.ceil(np.log2(np.maximum(np.diff(first), 1))).astype(int)
    for k in np.unique(size):
        yield np.flatnonzero(size == k)


def _padded(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers of the texts ``rows`` as a (texts, longest) table, the mask of
    real lines, and the texts, longest first (a column's mask is then a prefix)."""
    length = np.diff(first)[rows]
    order = np.argsort(-length, kind="stable")
    rows, length = rows[order], length[order]
    steps = np.arange(length.max(initial=0))
    mask = steps < length[:, None]
    return np.where(mask, first[rows][:, None] + steps, first[0]), mask, rows


def fit(own: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray) -> Crf:
    """Fits the field to texts given as their lines' own features."""
    n_full = 3 * N_OWN
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(y[0])
        return Crf(np.zeros(n_full), np.zeros((2, 2)),
                   (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    lines = Lines(np.vstack(own), np.concatenate(sizes), first)
    x = lines.full().astype(np.float64)
    tables = [_padded(first, g) for g in _alike(first)]
    weights, trans = np.zeros(n_full), np.zeros((2, 2))
    moment = [np.zeros(n_full + 4), np.zeros(n_full + 4)]
    for step in range(1, EPOCHS + 1):
        node = x @ weights
        slope, t_slope = np.zeros(len(node)), np.zeros((2, 2))
        for at, mask, rows in tables:
            table = np.where(mask, node[at], 0)
            ahead, back = messages(table, mask, trans)
            good = _sigmoid(ahead + back)
            slope[at[mask]] = (y[rows][:, None] - good)[mask]
            if at.shape[1] > 1:
                pair = mask[:, 1:]
                a, b = ahead[:, :-1][pair], (table + back)[:, 1:][pair]
                logit = np.stack([trans[0, 0] + 0 * a, trans[0, 1] + b,
                                  trans[1, 0] + a, trans[1, 1] + a + b])
                p = np.exp(logit - logit.max(axis=0))
                p /= p.sum(axis=0)
                t_slope -= p.sum(axis=1).reshape(2, 2)
                inner = pair.sum(axis=1)
                t_slope[0, 0] += inner[y[rows] == 0].sum()
                t_slope[1, 1] += inner[y[rows] == 1].sum()
        grad = np.concatenate([x.T @ slope, t_slope.ravel()]) / len(node)
        grad -= RIDGE * np.concatenate([weights, trans.ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad ** 2
        move = RATE * (moment[0] / (1 - 0.9 ** step)) / (
            np.sqrt(moment[1] / (1 - 0.99 ** step)) + 1e-8)
        weights, trans = weights + move[:n_full], trans + move[n_full:].reshape(2, 2)
    crf = Crf(weights, trans, (1.0, 0.0))
    return Crf(weights, trans, _curve(crf.chain_scores(lines), y))


def _curve(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the score, by Newton steps with a little ridge."""
    design, beta = np.column_stack([s, np.ones(len(s))]), np.zeros(2)
    for _ in range(30):
        p = _sigmoid(design @ beta)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta += np.linalg.solve(hess, design.T @ (y - p) - 1e-2 * beta)
    return float(beta[0]), float(beta[1])


def within(sizes: list[tuple[int, int]], most: int) -> set[int]:
    """Ids from ``sizes`` (id, lines), taken in their order as long as the lines
    taken stay within ``most``; one that does not fit is passed over."""
    taken, total = set(), 0
    for key, n in sizes:
        if total + n <= most:
            taken.add(key)
            total += n
    return taken


def train(docs: DataFrame, labels: DataFrame, may_learn: Column,
          sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Crf:
    """Fits on at most ``sample_docs`` labelled documents of at most ``sample_lines``
    lines together, each of them whole, taken in the order of a hash of the id;
    their line features, not their texts, come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = raw_texts(batch.column(1))
            if not raws:
                continue
            lines, rows = lines_of(raws), []
            for i in range(len(raws)):
                own = slice(lines.first[i], lines.first[i + 1])
                rows.append((lines.own[own].tobytes(), lines.size[own].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.binary())],
                names=["doc_id", "y", "own", "size"])

    sample = training_sample(docs, labels, "quality", may_learn, sample_docs)
    sizes = sample.groupBy("doc_id").agg(
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n"))
    ordered = sorted(sizes.select(F.xxhash64("doc_id"), "doc_id", F.coalesce("n", F.lit(1)))
                     .collect())                       # sample_docs rows
    taken = within([(key, n) for _, key, n in ordered], sample_lines)
    if len(taken) < len(ordered):
        sample = sample.where(F.col("doc_id").isin(taken))
    rows = sorted(sample.select("doc_id", "text", "y").mapInArrow(
        run, "doc_id long, y int, own binary, size binary").collect())
    return fit([np.frombuffer(r["own"], np.float32).reshape(-1, N_OWN) for r in rows],
               [np.frombuffer(r["size"], np.float64) for r in rows],
               np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, crf: Crf) -> DataFrame:
    """``doc_id, score double`` of every row. Narrow: no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = batch.column(0).cast(pa.int64()), raw_texts(batch.column(1))
            for start, end in groups(raws, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [keys[start:end], pa.array(crf.scores(raws[start:end]))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")


def keep_good(docs: DataFrame, crf: Crf) -> DataFrame:
    """The rows of ``docs`` that the field takes for good, with all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality", None, bool)            # drops what other stages keep
        for batch in batches:
            raws = raw_texts(batch.column(at))
            for start, end in groups(raws, BLOCK_BYTES):
                good = crf.scores(raws[start:end]) >= 0.5
                yield batch.slice(start, end - start).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
