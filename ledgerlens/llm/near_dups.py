"""Near-duplicate classes: one-permutation MinHash, banded buckets, star edges.

A document's set holds the 64-bit hashes of its distinct ``width``-word shingles
(words: A-Z lower-cased, runs of anything but ASCII white space); a text with
fewer words is one shingle, a text without words has the empty set.

* **One-permutation hashing.** The hash range is cut into ``BINS`` bins and the
  signature is the least hash of each. An empty bin borrows from the filled bin
  that comes first in an order of its own (optimal densification), so two sets
  agree in a bin with a probability near their Jaccard similarity, however few
  shingles they have.
* **Banded buckets.** ``BANDS`` bands of ``BINS / BANDS`` bins. At similarity 0.8
  a pair shares no bucket with probability (1 - 0.8**5)**48, about 5e-9.
* **Equal sets** are one node from the start (grouped by a 128-bit hash). Nodes are
  numbered in the order of their least id, then of their hash, so that sets
  under one id are nodes of their own.
* **Star edges.** In every bucket the least node is the centre.
  First each node is compared with its least centre, then with the centres
  that are still in another component. Only for buckets that then still hold
  several components are pairs across components compared. Nothing within a
  component is compared again, so a group of thousands of copies costs a few edges
  per member; no link between components is passed over, and there is no cap.
  These pairs meet once (in the least bucket they share) and only if their
  sketches agree as they do at the similarity asked for, less ``MARGIN`` deviations
  (a chance of about 3e-7 to pass over a pair that is just similar enough).
* Every edge is confirmed on the full sets, built anew from the whole texts of
  the nodes that share a bucket.
* **Components** by label propagation with pointer jumping over written tables.

Defined cases: a null or empty text has the empty set and is linked with nothing;
a null id takes no part in linking (its class is null, kept is null); rows that
repeat an id are one node if their sets are equal, else a node for each set, tied
together by that id; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, shuffle_partitions
from .batches import PieceCache, groups, raw_texts, worker_state

BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
CACHE_WORDS = 150_000
#: Longs of one-bit hashes in a sketch; deviations allowed below the expected agreement.
SKETCH, MARGIN = 40, 5.0
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX2
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * MIX + np.uint64(seed)) | np.uint64(1)


#: Least hash of each bin, and for each bin the order in which it looks for a filled one.
EDGES = np.array([-(-(i << 64) // BINS) for i in range(BINS)], dtype=np.uint64)
RANK = np.argsort(np.argsort(_constants(BINS * BINS, 7).reshape(BINS, BINS), axis=1), axis=1)
SKETCH_FACTORS = _constants(64 * SKETCH, 17)
BAND_FACTORS, BAND_SALTS = _constants(ROWS, 11), _constants(BANDS, 13)


class Shingler:
    """Sets of shingle hashes of texts."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.factors = width, _constants(width, 3)
        digest = xxhash.xxh3_64_intdigest
        self.words = PieceCache(lambda words: map(digest, words), CACHE_WORDS)

    def sets(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of each text."""
        for start, end in groups(raws):
            cuts = [raw.lower().split() for raw in raws[start:end]]
            for found in self.words.values(cuts):
                words = np.array(found, np.uint64)
                width = min(self.width, len(words))
                if not width:
                    yield words
                    continue
                n = len(words) - width + 1
                total = np.full(n, width, np.uint64)
                for i in range(width):
                    total = total + words[i:i + n] * self.factors[i]
                yield np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation signature of a non-empty sorted set."""
    at = np.searchsorted(hashes, EDGES)
    filled = np.flatnonzero(np.diff(at, append=len(hashes)))
    out = np.empty(BINS, np.uint64)
    out[filled] = hashes[at[filled]]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        out[empty] = out[filled[RANK[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def buckets(sig: np.ndarray) -> np.ndarray:
    bands = (_mixed(sig.reshape(BANDS, ROWS) * BAND_FACTORS).sum(axis=1) + BAND_SALTS)
    return _mixed(bands).astype(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of the least of each of ``64 * SKETCH`` hashes of a set's members."""
    least = np.full(len(SKETCH_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 64):
        np.minimum(least, (hashes[at:at + 64, None] * SKETCH_FACTORS).min(axis=0), out=least)
    bits = (_mixed(least) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def shingler(width: int) -> Shingler:
    """One shingler for each Python worker, built on first use."""
    return worker_state("shingles", width, lambda: Shingler(width))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_hi, set_lo, buckets`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                        ("set_hi", pa.int64()), ("set_lo", pa.int64()),
                        ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, hi, lo, found = batch.column(0).cast(pa.int64()), [], [], [], []
            for hashes in shingler(width).sets(raw_texts(batch.column(1))):
                n.append(len(hashes))
                high, low = set_hash(hashes)
                hi.append(high)
                lo.append(low)
                found.append(buckets(signature(hashes)) if len(hashes)
                             else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, set_hi long, set_lo long, buckets array<long>")


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set as two signed longs."""
    import xxhash

    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return (int.from_bytes(digest[:8], "big", signed=True),
            int.from_bytes(digest[8:], "big", signed=True))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``n_shingles, set_hi, set_lo, set array<long>`` (whole sets, as signed hashes)."""
    schema = pa.schema([("n_shingles", pa.int64()), ("set_hi", pa.int64()),
                        ("set_lo", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = raw_texts(batch.column(0))
            for start, end in groups(raws, 1 << 20):
                sets = list(shingler(width).sets(raws[start:end]))
                sizes = list(map(len, sets))
                hi, lo = zip(*map(set_hash, sets))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *sizes]), pa.int32()),
                    pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()),
                     pa.array(lo, pa.int64()), lists], schema=schema)

    return docs.select("text").mapInArrow(
        run, "n_shingles long, set_hi long, set_lo long, set array<long>")


def sketches(sets: DataFrame) -> DataFrame:
    """``node, s0, s1, ...`` of ``sets(node, set)``."""
    names = [f"s{i}" for i in range(SKETCH)]
    schema = pa.schema([("node", pa.int64()), *[(n, pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, SKETCH), np.int64)
            for i, own in enumerate(batch.column(1)):
                found[i] = sketch(own.values.to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(found[:, i].copy()) for i in range(SKETCH)]],
                schema=schema)

    return sets.mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def _sketches_agree(similarity: float, x: str, y: str):
    n, p = 64 * SKETCH, (1 + similarity) / 2
    least = n * p - MARGIN * (n * p * (1 - p)) ** 0.5
    differ = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}")))
                  for i in range(SKETCH)), F.lit(0))
    return differ <= int(n - least)


def _similar(similarity: float, common, a, b):
    """Jaccard similarity of at least ``similarity``, in whole hundredths."""
    per_cent = round(100 * similarity)
    return 100 * common >= per_cent * (a + b - common)


def _sizes_fit(similarity: float, a, b):
    return 100 * F.least(a, b) >= round(100 * similarity) * F.greatest(a, b)


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node of ``edges(a, b)``; comp is the least node
    reachable. Each round takes the least label among neighbours and then the
    label of that label, over tables written to the shared folder."""
    both = cut_lineage(edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("comp")))
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a")
                .agg(F.min("comp").alias("near")))
        lower = (labels.join(near, labels.node == near.a)
                 .select("node", "comp", F.least("comp", "near").alias("low")))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = cut_lineage(lower.join(jump, "low", "left")
                          .select("node", F.coalesce(F.least("low", "far"), "low").alias("comp"),
                                  (F.coalesce(F.least("low", "far"), "low") != F.col("comp"))
                                  .alias("moved")))
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            return labels


class _Confirmer:
    """Confirms candidate edges on full sets."""

    def __init__(self, sets: DataFrame, similarity: float):
        self.sets, self.similarity = sets, similarity

    def __call__(self, pairs: DataFrame) -> DataFrame:
        left = self.sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
        right = self.sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        return cut_lineage(
            pairs.select("a", "b").join(left, "a").join(right, "b")
            .where(_similar(self.similarity, common, F.size("set_a"), F.size("set_b")))
            .select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; see the module docstring."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = cut_lineage(signatures(docs, width))
    usable = signed.where("doc_id is not null and n_shingles > 0")
    by_set = ["n_shingles", "set_hi", "set_lo"]
    order = ["least", "set_hi", "set_lo", "n_shingles"]
    nodes = cut_lineage(usable.groupBy(*by_set).agg(F.min("doc_id").alias("least"),
                                                    F.first("buckets").alias("buckets"))
                        .repartitionByRange(shuffle_partitions(spark), *order)
                        .sortWithinPartitions(*order)
                        .withColumn("node", F.monotonically_increasing_id()))
    held = nodes.select("node", F.col("n_shingles").alias("n"),
                        F.explode("buckets").alias("bucket"))
    centres = (held.groupBy("bucket")
               .agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("last"))
               .where("c.node != last")
               .select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")))
    members = cut_lineage(held.join(centres, "bucket"))
    asked = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        *by_set, "node", "least")
    # the rows of an asked id may hold other sets as well: the hash tells them apart
    texts = docs.join(asked.select(F.col("least").alias("doc_id")).distinct(), "doc_id",
                      "left_semi")
    sets = cut_lineage(full_sets(texts, width).dropDuplicates(by_set)
                       .join(asked.drop("least"), by_set).select("node", "set"))
    confirm = _Confirmer(sets, similarity)

    star = members.where((F.col("node") != F.col("centre"))
                         & _sizes_fit(similarity, F.col("n"), F.col("centre_n")))
    # each node with its least centre
    first = cut_lineage(star.groupBy(F.col("node").alias("a")).agg(F.min("centre").alias("b")))
    links = confirm(first)
    comps = components(links)
    # centres that are still elsewhere
    more = _apart(star.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(),
                  comps).join(first, ["a", "b"], "left_anti")
    links = cut_lineage(links.unionByName(confirm(more)))
    comps = components(links)
    # what is left in buckets that hold several components
    placed = (members.join(comps, "node", "left")
              .withColumn("comp", F.coalesce("comp", "node"))
              .select("bucket", "centre", "node", "n", "comp"))
    mixed = (placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
             .where("low != high").select("bucket"))
    open_ = placed.join(mixed, "bucket").where("node != centre").drop("centre")
    asked = cut_lineage(open_.select("node").distinct())
    drawn = cut_lineage(sketches(sets.join(asked, "node", "left_semi")))
    open_ = cut_lineage(open_.join(drawn, "node").join(nodes.select("node", "buckets"), "node"))
    x, y = open_.alias("x"), open_.alias("y")
    rest = (x.join(y, (F.col("x.bucket") == F.col("y.bucket"))
                   & (F.col("x.comp") < F.col("y.comp"))
                   & _sizes_fit(similarity, F.col("x.n"), F.col("y.n"))
                   & _sketches_agree(similarity, "x", "y")
                   & (F.col("x.bucket") == F.array_min(F.array_intersect("x.buckets",
                                                                         "y.buckets"))))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    links = links.unionByName(confirm(rest))
    # ids that are repeated with different sets tie their sets together
    of_id = usable.join(nodes.select(*by_set, "node"), by_set).select("doc_id", "node")
    return _classes(signed, nodes, links, of_id, by_set)


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a = comps.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    b = comps.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"))


def _classes(signed, nodes, links, of_id, by_set) -> DataFrame:
    split = (of_id.distinct().groupBy("doc_id").agg(F.min("node").alias("a"),
                                                    F.max("node").alias("z"))
             .where("a != z").select("doc_id", "a"))
    ties = (of_id.join(split, "doc_id").where("node != a")
            .select("a", F.col("node").alias("b")).distinct())
    comps = components(links.unionByName(ties))
    # nodes are numbered by their least id, so a class's least node has its least id
    named = comps.join(nodes.select(F.col("node").alias("comp"), F.col("least").alias("class")),
                       "comp").select("node", "class")
    keyed = nodes.select(*by_set, "node", "least").join(named, "node", "left").select(
        *by_set, F.coalesce("class", "least").alias("class"))
    rows = signed.select("doc_id", *by_set)
    in_sets = rows.where("doc_id is not null and n_shingles > 0").join(keyed, by_set).select(
        "doc_id", "n_shingles", F.col("class").alias("component_id"))
    alone = rows.where("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return in_sets.unionByName(alone)


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, with all its columns, of one document of each class: the one with
    the least id. Of rows that repeat that id the least row stays (by the columns
    that can be ordered, in their order). Rows without an id stay."""
    found = near_duplicates(docs, width, similarity)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    order = [F.col(f"`{f.name}`") for f in docs.schema
             if f.name != "doc_id" and not _has_map(f.dataType)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = (known.groupBy("doc_id").agg(F.min_by(row, F.struct(*order)).alias("row"))
           .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
    return one.unionByName(docs.where("doc_id is null").select(
        *[F.col(f"`{c}`") for c in docs.columns]))


def _has_map(kind: T.DataType) -> bool:
    """Whether values of a type cannot be ordered."""
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))
