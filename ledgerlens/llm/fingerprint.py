"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for a text of code points c and a base B, the prefix sums
P[i] = sum of c[j] * B**j for j < i, modulo a prime. The span [i, i+n) has the
hash (P[i+n] - P[i]) * B**-i, so any two spans are compared in constant time,
and the longest common extension of two places is found by binary search on
the length.

The fingerprint of a text is the hash of the whole text under two primes, the
length, and sketches: the hashes of all spans of a width, spread over ``BINS``
bins by value, the least of each bin. Every text has a sketch of its spans of
``SHORT_SPAN`` code points (a text under that is one span); texts of ``LONG`` code
points or more also have one of their spans of ``SPAN``. Two fingerprints are
compared by sketches of one width: ``SPAN`` if both have it, else ``SHORT_SPAN``.
Their likeness is the Dice coefficient of these span sets as estimated from the
share J of equal bins among those filled in either, 2J / (1 + J); fingerprints
of equal texts are equal and have likeness 1.

Every document is also compared with the next one by id and with a text edited
from both. Documents are range-partitioned by id and sorted once; the texts
move in that one shuffle. A task compares neighbours as they come; the first and
last document of every partition are handed on to a second step that joins
them across the cuts (two texts per partition, whatever the size of the data).

Defined cases: a null text is empty; an empty text has likeness 1 to an empty
one and 0 to any other; a null id sorts first; repeated ids are neighbours,
ordered by text; a single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions
from .batches import Emitter

# Two Mersenne-range primes and a base for each.
PRIME, PRIME2 = (1 << 31) - 1, (1 << 31) - 19
BASE, BASE2 = 911382323, 972663749
SPAN, SHORT_SPAN, BINS = 16, 4, 64
LONG = 4 * SPAN
MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY_BIN = 0xFFFF


class _Powers:
    """Powers of a base and of its inverse modulo a prime, grown on demand."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime = base, prime
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            k, p = len(self.up), np.uint64(self.prime)
            self.up = np.concatenate([self.up, self.up * np.uint64(
                pow(self.base, k, self.prime)) % p])
            self.down = np.concatenate([self.down, self.down * np.uint64(
                pow(self.base, -k, self.prime)) % p])


_FIRST, _SECOND = _Powers(BASE, PRIME), _Powers(BASE2, PRIME2)


class PrefixHash:
    """Prefix hashes of one text given as an array of code points."""

    def __init__(self, codes: np.ndarray):
        self.n, p = len(codes), np.uint64(PRIME)
        _FIRST.upto(self.n + 1)
        terms = (codes.astype(np.uint64) + np.uint64(1)) * _FIRST.up[:self.n] % p
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.sums %= p

    def spans(self, starts, width: int) -> np.ndarray:
        """Hashes of the spans of ``width`` code points at ``starts``."""
        p, starts = np.uint64(PRIME), np.asarray(starts)
        if len(starts) == self.n + 1 - width:      # every span
            gap = self.sums[width:] + p - self.sums[:len(starts)]
            return gap % p * _FIRST.down[:len(starts)] % p
        return (self.sums[starts + width] + p - self.sums[starts]) % p * _FIRST.down[starts] % p

    def same(self, i: int, other: PrefixHash, j: int, width: int) -> bool:
        return bool(self.spans(np.array([i]), width)[0] == other.spans(np.array([j]), width)[0])

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common run that starts at ``i`` here and at
        ``j`` there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i, other, j, middle) else (low, middle - 1)
        return low


def sketch(prefix: PrefixHash, width: int) -> np.ndarray:
    """The least hash of each bin over all spans of ``width`` code points."""
    bins = np.full(BINS, EMPTY_BIN, np.uint16)
    if not prefix.n:
        return bins
    mixed = prefix.spans(np.arange(prefix.n + 1 - width), width) * MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    high = np.sort(mixed >> np.uint64(40))     # 6 bits of bin, 18 of value
    at = (high >> np.uint64(18)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    # a bin's least value, re-mixed to 16 bits so that small values spread
    least = high[first] * MIX
    bins[at[first]] = (least >> np.uint64(48)) % np.uint64(EMPTY_BIN)
    return bins


class Fingerprint:
    """Whole-text hashes, length and sketches of one text."""

    def __init__(self, codes: np.ndarray):
        self.prefix = PrefixHash(codes)
        n = len(codes)
        _SECOND.upto(n + 1)
        second = ((codes.astype(np.uint64) + np.uint64(1)) * _SECOND.up[:n]
                  % np.uint64(PRIME2)).sum() % np.uint64(PRIME2)
        self.short = sketch(self.prefix, min(n, SHORT_SPAN))
        self.wide = sketch(self.prefix, SPAN) if n >= LONG else None
        self.head = f"{n:x}-{int(self.prefix.sums[-1]):08x}{int(second):08x}-"
        parts = [self.short] if self.wide is None else [self.wide, self.short]
        self.bins = np.concatenate(parts).astype(">u2").tobytes()

    @property
    def text(self) -> str:
        return self.head + self.bins.hex()

    def likeness(self, other: Fingerprint) -> float:
        if (self.head, self.bins) == (other.head, other.bins):
            return 1.0
        both = self.wide is not None and other.wide is not None
        mine, theirs = (self.wide, other.wide) if both else (self.short, other.short)
        filled = (mine != EMPTY_BIN) | (theirs != EMPTY_BIN)
        if not filled.any():
            return 0.0
        j = float(((mine == theirs) & filled).sum() / filled.sum())
        return 2 * j / (1 + j)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the next one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()),
           ("head", pa.string()), ("bins", pa.binary()),
           ("edited_head", pa.string()), ("edited_bins", pa.binary()),
           ("near_edited", pa.float64()), ("near_next", pa.float64()),
           ("common_prefix", pa.int64())]
_SQL = ("doc_id long, n_chars long, edited_text string, head string, bins binary, "
        "edited_head string, edited_bins binary, near_edited double, near_next double, "
        "common_prefix long")


def compared(key, text: str, mine: Fingerprint, following: str, theirs: Fingerprint) -> tuple:
    new = edited(text, following)
    third = Fingerprint(code_points(new))
    return (key, len(text), new, mine.head, mine.bins, third.head, third.bins,
            mine.likeness(third), mine.likeness(theirs),
            mine.prefix.common_extension(0, third.prefix, 0))


def spelled(head: str, bins: str) -> Column:
    """The fingerprint as text; tables between the steps hold its bins as bytes."""
    return F.concat(F.col(head), F.lower(F.hex(bins)))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """For every row: its fingerprint, the text edited with the next row's
    start, that text's sha-256 and fingerprint, the likeness of the first to the
    second and to the next row's, and how many code points text and edited text
    have in common at the start."""
    spark = docs.sparkSession
    schema = pa.schema([*_RESULT, ("part", pa.int32()), ("side", pa.string()),
                        ("side_text", pa.string())])
    nothing = (None,) * (len(_RESULT) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, last = TaskContext.get().partitionId(), Emitter(schema), None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                mark = Fingerprint(code_points(text))
                if last is None:
                    yield from out.add((None, *nothing, part, "first", text), len(text))
                else:
                    row = compared(*last, text, mark)
                    yield from out.add((*row, part, None, None), len(row[2]) + 800)
                last = (key, text, mark)
        if last is not None:
            yield from out.add((last[0], *nothing, part, "last", last[1]), len(last[1]))
        yield from out.flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    done = cut_lineage(
        rows.repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, _SQL + ", part int, side string, side_text string")
        .withColumn("edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256))
        .drop("edited_text"))

    # across the cuts: two rows per partition that has rows; the last is followed by the first
    firsts = done.where("side = 'first'").select("part", F.col("side_text").alias("following"))
    lasts = done.where("side = 'last'").select("part", "doc_id", F.col("side_text").alias("text"))
    order = Window.orderBy("part")
    parts = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding,
                                           Window.unboundedFollowing))).alias("next_part"))
    pairs = (lasts.join(parts, "part")
             .join(firsts.withColumnRenamed("part", "next_part"), "next_part")
             .select("doc_id", "text", "following"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(pa.schema(_RESULT))
        for batch in batches:
            for key, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                row = compared(key, text, Fingerprint(code_points(text)), following,
                               Fingerprint(code_points(following)))
                yield from out.add(row, len(row[2]) + 800)
        yield from out.flush()

    columns = ["doc_id", "n_chars", "edited_sha256",
               spelled("head", "bins").alias("fingerprint"),
               spelled("edited_head", "edited_bins").alias("edited_fingerprint"),
               "near_edited", "near_next", "common_prefix"]
    rest = pairs.mapInArrow(across, _SQL).withColumn(
        "edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256))
    return done.where("side is null").select(columns).unionByName(rest.select(columns))
