"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule: a line from ``start`` to ``end`` weight over
training time t in [0, 1]. The area under it is its weight in the targets. Targets
share ``BUDGET`` times all words by weight; a source stops at ``REPEAT`` times its
own words, and the excess is shared again by weight until none is above.

A source with target T demands its words along its schedule: D(t) = T * (share of
the schedule's area up to t). Its documents follow one another in an order given by
a hash, pass after pass, up to T words; the word at which a document begins, x, is
assigned the training position D^-1(x) (a quadratic, solved in closed form).
Documents of all sources are then range-sorted by position.

Running sums within a source never gather a source in one task: documents sit in a
trie of their 64-bit order hash, 1024 ways at each of two levels, and a window only
spans the siblings of one node (1024 rows) or the documents of one leaf. Targets
are found by repeated aggregation over the table of sources; one row at a time
comes to the driver.

Defined cases: only doc_id, text and source are read, further columns, whatever their
names, are carried through by ``mixed_documents``; a null text has size 0; a null source is a source, the last; rows that
repeat are documents of their own; documents without words are taken with 0 words;
sources without words have target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import POSITION, ranked
from ..session import cut_lineage, shuffle_partitions
from .batches import WORD

BUDGET, REPEAT = 1.5, 2.0
#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Schedules by weight: the share of the weight at the start; the rest of the
#: area follows from it (start + end = 2 * weight). Even places fade, odd ones grow.
FADE = 1.25


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def schedules(sizes: DataFrame) -> DataFrame:
    """``source, words, start, end, weight`` of ``sizes(source, size)``: weights
    repeat 3, 1, 2 in code-point order of the sources, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    placed = ranked(sources, [F.col("source").asc_nulls_last()])
    k = F.col(POSITION)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          (k % len(WEIGHTS) + 1).cast("int"))
    start = F.when(k % 2 == 0, F.lit(FADE)).otherwise(F.lit(2 - FADE)) * weight
    return cut_lineage(placed.select("source", "words", start.alias("start"),
                                     (2 * weight - start).alias("end"), weight.alias("weight")))


def targets(sources: DataFrame, budget: float = BUDGET, repeat: float = REPEAT) -> DataFrame:
    """``sources`` with ``target``. A source stops when its share of what is left
    passes ``repeat`` times its words; each round is one aggregate of one row."""
    cap = F.col("words") * F.lit(repeat)
    weight = F.col("weight")
    rate, stopped = None, -1
    while True:
        full = F.lit(False) if rate is None else cap <= rate * weight
        got = sources.agg(
            F.sum("words").alias("all"), F.sum(F.when(full, 1).otherwise(0)).alias("stopped"),
            F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(weight)).alias("open")).first()
        if not got["open"] or got["stopped"] == stopped:
            break
        stopped, rate = got["stopped"], (budget * got["all"] - got["held"]) / got["open"]
    share = cap if rate is None else F.least(cap, rate * weight)
    return sources.withColumn("target", share.cast("double"))


def offsets(sized: DataFrame) -> DataFrame:
    """``sized(source, size, order, ...)`` with ``before``: words of the source's
    documents that come earlier in the order, by sums over trie nodes."""
    top, mid = F.shiftrightunsigned("order", 54), F.shiftrightunsigned("order", 44)
    rows = sized.withColumn("_top", top).withColumn("_mid", mid)
    # the null source is a key like any other
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    leaves = rows.groupBy("_key", "_top", "_mid").agg(F.sum("size").alias("_w"))
    nodes = leaves.groupBy("_key", "_top").agg(F.sum("_w").alias("_w"))

    def earlier(df: DataFrame, keys: list[str], by: list[str], total: str, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(total).over(w), F.lit(0)))

    at_top = earlier(nodes, ["_key"], ["_top"], "_w", "_b1").drop("_w")
    at_mid = earlier(leaves, ["_key", "_top"], ["_mid"], "_w", "_b2").drop("_w")
    starts = at_mid.join(at_top, ["_key", "_top"]).select(
        "_key", "_mid", (F.col("_b1") + F.col("_b2")).alias("_b"))
    inner = earlier(rows, ["_key", "_mid"], ["order", "doc_id", "size"], "size", "_in")
    return (inner.join(starts, ["_key", "_mid"])
            .withColumn("before", F.col("_b") + F.col("_in"))
            .drop("_top", "_mid", "_key", "_b", "_in"))


def position(word: Column, target: Column, start: Column, end: Column) -> Column:
    """Training time at which a source's demand reaches ``word``: with the
    share z = word / target of the area a*t + (b - a)*t*t/2, (a + b)/2 in all,
    t solves the quadratic; written so that it also holds for a = b."""
    z = F.when(target > 0, F.least(F.lit(1.0), word / target)).otherwise(F.lit(0.0))
    root = F.sqrt(start * start + (end - start) * (start + end) * z)
    return z * (start + end) / (start + root)


def taken_words(before: Column, size: Column, words: Column, target: Column,
                turn: Column) -> Column:
    """Words that pass ``turn`` (0, 1, ...) of the source takes of a document."""
    left = F.floor(target) - turn * words - before
    return F.greatest(F.lit(0), F.least(size, left)).cast("long")


def mixture(docs: DataFrame, budget: float = BUDGET, repeat: float = REPEAT) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, turns array<struct<turn,
    words, at>>, start_at`` of every row: what each pass over its source takes of
    the document and the training position at which that begins; start_at is the
    position of the first pass, whether or not it takes words."""
    sized = cut_lineage(docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        word_count(F.col("text").cast("string")).alias("size"))
        .withColumn("order", F.xxhash64("doc_id", F.lit(20))))
    plan = cut_lineage(targets(schedules(sized), budget, repeat))
    placed = offsets(sized).alias("d").join(
        plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    passes = F.sequence(F.lit(0), F.lit(int(-(-repeat // 1)) - 1))
    c = F.col

    def of_turn(turn: Column) -> Column:
        words = taken_words(c("before"), c("size"), c("words"), c("target"), turn)
        at = position(turn * c("words") + c("before"), c("target"), c("start"), c("end"))
        return F.struct(turn.alias("turn"), words.alias("words"), at.alias("at"))

    turns = F.filter(F.transform(passes, of_turn), lambda t: t["words"] > 0)
    return placed.withColumn("turns", turns).select(
        "doc_id", "source", "size", c("words").alias("source_size"), "target",
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["words"]).alias("taken"),
        "turns", of_turn(F.lit(0))["at"].alias("start_at"))


def training_order(mixed: DataFrame, *carried: str) -> DataFrame:
    """One row per taken pass of a document, range-sorted by training position:
    ``doc_id, source, turn, words, at, rank`` (0-based place in training) and the
    ``carried`` columns of ``mixed``, by which passes that tie are ordered."""
    passes = (mixed.select("doc_id", "source", F.explode("turns").alias("t"), *carried)
              .select("doc_id", "source", "t.turn", "t.words", "t.at", *carried))
    return ranked(passes, [F.col(k) for k in ("at", "doc_id", "turn", *carried)]
                  ).withColumnRenamed(POSITION, "rank")


def mixed_documents(docs: DataFrame, budget: float = BUDGET, repeat: float = REPEAT) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in the columns of
    ``docs``, range-sorted by training position. The document at which a
    source's budget ends is delivered whole. Ids should be unique: rows that
    repeat an id are each delivered as often as the most taken of them; rows
    without an id are delivered as often as the most taken of those. Documents
    without words cost no budget and are delivered once, where the first pass
    over their source comes to them."""
    spark = docs.sparkSession
    ats = F.when(F.col("size") == 0, F.array("start_at")).otherwise(F.col("turns.at"))
    turns = mixture(docs, budget, repeat).select("doc_id", ats.alias("ats")).groupBy("doc_id").agg(
        F.max(F.struct(F.size("ats"), "ats")).alias("m")).select(
        "doc_id", "m.ats").where(F.size("ats") > 0)
    # a row travels as one struct, so no column of the documents meets one of ours
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    known = whole.where("doc_id is not null").join(turns, "doc_id")
    nameless = whole.where("doc_id is null").join(
        F.broadcast(turns.where("doc_id is null").select("ats")), F.lit(True))    # one row at most
    rows = known.unionByName(nameless).select("doc_id", "row", F.explode("ats").alias("at"))
    return (rows.repartitionByRange(shuffle_partitions(spark), "at", "doc_id")
            .sortWithinPartitions("at", "doc_id")
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
