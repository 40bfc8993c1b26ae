"""ROUGE-L F-measure of a prediction against a reference.

Cleaning collapses newlines, so the summary-level variant sees a single
sentence and equals plain ROUGE-L: F = 2PR/(P+R) with P = LCS/|pred|,
R = LCS/|ref| over tokens. Tokens: lower-case, every run outside [a-z0-9]
is a separator; optionally Porter-stemmed when longer than 3 characters.
Either text empty (after cleaning) or token-less → 0.0.

LCS length uses the bit-parallel recurrence on Python integers (one
machine-word operation per 64 positions), so a pair costs O(|b|·|a|/64).
The per-pair work runs in an Arrow-batched pandas UDF: the pairs are a
narrow map, nothing is shuffled or broadcast. A worker stems a token once while its
bounded dictionary holds it, and a text that stands in several pairs of a batch (the
reference of several answers) is cut, stemmed and counted once (``PairScorer``).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem as porter_stem

#: Distinct tokens whose stems a worker remembers.
MAX_STEMS = 200_000
_STEMS: dict[str, str] = {}
_SEP = re.compile(r"[^a-z0-9]+")
_WS = re.compile(r"\s+")


def clean_py(s) -> str:
    """Python twin of ``text.clean`` for use inside workers."""
    if not isinstance(s, str):
        return ""
    return _WS.sub(" ", s.strip())


def _stemmed(token: str) -> str:
    known = _STEMS.get(token)
    if known is None:
        if len(_STEMS) >= MAX_STEMS:
            _STEMS.clear()
        known = _STEMS[token] = porter_stem(token)
    return known


def tokens(text: str, stem: bool) -> list[str]:
    toks = _SEP.sub(" ", text.lower()).split()
    if stem:
        toks = [_stemmed(t) if len(t) > 3 else t for t in toks]
    return toks


def _places(words: list[str]) -> dict[str, int]:
    """Of each word, a bit for every place where it stands."""
    masks: dict[str, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | (1 << i)
    return masks


def _common(n: int, masks: dict[str, int], words: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel) of ``words`` and
    ``n`` words whose places are given."""
    v = full = (1 << n) - 1
    for word in words:
        u = v & masks.get(word, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    return _common(len(a), _places(a), b)


class PairScorer:
    """Scores the pairs of one batch; what depends on one text alone is kept for the
    batch, so its memory is bounded by the batch."""

    def __init__(self, stem: bool, dim: int = 0):
        self.stem, self.dim = stem, dim
        self.words: dict = {}
        self.places: dict = {}
        self.vectors: dict = {}
        self.buckets: dict[str, int] = {}

    def words_of(self, text) -> list[str]:
        known = self.words.get(text)
        if known is None:
            known = self.words[text] = tokens(clean_py(text), self.stem)
        return known

    def rouge(self, pred, ref) -> float:
        tp, tr = self.words_of(pred), self.words_of(ref)
        if not tp or not tr:
            return 0.0
        if ref not in self.places:
            self.places[ref] = _places(tr)
        lcs = _common(len(tr), self.places[ref], tp)
        if lcs == 0:
            return 0.0
        p, r = lcs / len(tp), lcs / len(tr)
        return 2 * p * r / (p + r)

    def vector_of(self, text) -> tuple[dict[int, int], float]:
        """Counts by bucket of the hashing embedder, and their length."""
        from .embed import _bucket

        if text not in self.vectors:
            counts: dict[int, int] = {}
            for token in tokens(clean_py(text), False):
                b = self.buckets.get(token)
                if b is None:
                    b = self.buckets[token] = _bucket(token, self.dim)
                counts[b] = counts.get(b, 0) + 1
            self.vectors[text] = counts, sum(v * v for v in counts.values()) ** 0.5
        return self.vectors[text]

    def cosine(self, pred, ref) -> float:
        """Cosine of the hashing embedder's vectors, 0 when either has no token."""
        (cp, np_), (cr, nr) = self.vector_of(pred), self.vector_of(ref)
        if not cp or not cr:
            return 0.0
        return round(sum((v / np_) * (cr[b] / nr) for b, v in cp.items() if b in cr), 9)


def rouge_l(pred, ref, stem: bool = True) -> float:
    return PairScorer(stem).rouge(pred, ref)


def _make_udf(stem: bool):
    @F.pandas_udf(T.DoubleType())
    def score(pred: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series(list(map(PairScorer(stem).rouge, pred, ref)), dtype="float64")
    return score


_ROUGE_STEM = None
_ROUGE_PLAIN = None


def rouge_l_col(pred: Column, ref: Column, stem: bool = True) -> Column:
    global _ROUGE_STEM, _ROUGE_PLAIN
    if stem:
        _ROUGE_STEM = _ROUGE_STEM or _make_udf(True)
        return _ROUGE_STEM(pred, ref)
    _ROUGE_PLAIN = _ROUGE_PLAIN or _make_udf(False)
    return _ROUGE_PLAIN(pred, ref)


# ---- ROUGE-L and the hashing-embedder cosine in one Arrow pass -----------------
PAIR_SCORES = T.StructType([T.StructField("rougeL", T.DoubleType()),
                            T.StructField("cosine", T.DoubleType())])
_PAIR_UDFS: dict = {}


def pair_scores_col(pred: Column, ref: Column, stem: bool, dim: int) -> Column:
    """struct(rougeL, cosine) for cleaned texts: one Python pass computes
    both, so the pair crosses the JVM/Python boundary once."""
    key = (stem, dim)
    if key not in _PAIR_UDFS:
        @F.pandas_udf(PAIR_SCORES)
        def scores(p: pd.Series, r: pd.Series) -> pd.DataFrame:
            scorer = PairScorer(stem, dim)
            rows = [(scorer.rouge(a, b), scorer.cosine(a, b)) for a, b in zip(p, r)]
            return pd.DataFrame(rows, columns=["rougeL", "cosine"], dtype="float64")
        _PAIR_UDFS[key] = scores
    return _PAIR_UDFS[key](pred, ref)
