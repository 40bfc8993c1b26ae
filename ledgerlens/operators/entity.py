"""Substring containment joins without a nested loop.

``contains(lower(text), lower(pattern))`` between two large tables would be a
broadcast nested-loop join (every text × every pattern). Instead, decided by the
measured bytes of the patterns:

* **Patterns of at most ``MAX_AUTOMATON_BYTES``** are broadcast and made into one
  Aho-Corasick automaton per Python worker, and one Arrow pass walks each text once. The texts are not
  shuffled and not copied; the cost is linear in their length.
* **More patterns**: every pattern of length ≥ g is keyed by its *rarest*
  g-gram (counted over all patterns), shorter ones by themselves; every text
  emits its distinct g-grams (and substrings of the short lengths present) as
  (id, gram) rows without the text; an equi-join on the key yields candidates,
  which are verified with ``contains`` after the text is joined back by id. A
  text is cut into characters once, so this is linear as well.

A pattern occurring in a text implies all of its g-grams occur in it, so the
candidate set is complete: both ways are exact. The key fields of a pattern travel
with it, so nothing is joined on a pattern's name afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

GRAM = 4
#: UTF-8 bytes of all patterns that one automaton may hold (checked before use).
MAX_AUTOMATON_BYTES = 2 << 20


def _substrings(chars: Column, n: int) -> Column:
    """Distinct substrings of length n of an array of characters."""
    def at(_, i: Column) -> Column:
        return F.concat(*[F.get(chars, i + j) for j in range(n)])

    # past the end the concatenation is null
    return F.array_distinct(F.filter(F.transform(chars, at), lambda s: s.isNotNull()))


def _keys(df: DataFrame, text_col: str, lengths: list[int], *keep: str) -> DataFrame:
    """``keep`` columns and ``_key``: one row per distinct substring of the lengths."""
    chars = df.select(*keep, F.split(text_col, "").alias("_chars"))
    arrays = [_substrings(F.col("_chars"), n) for n in sorted(set(lengths))]
    return chars.select(*keep, F.explode(F.concat(*arrays)).alias("_key"))


def _pattern_keys(patterns: DataFrame, gram: int) -> DataFrame:
    """``_lpat, _key`` of distinct patterns: the rarest g-gram of long ones, the
    pattern itself of short ones."""
    distinct = patterns.select("_lpat").distinct()
    grams = _keys(distinct.where(F.length("_lpat") >= gram), "_lpat", [gram], "_lpat")
    freq = grams.groupBy("_key").agg(F.count(F.lit(1)).alias("_f"))
    rare = (grams.join(freq, "_key").groupBy("_lpat")
                 .agg(F.min(F.struct("_f", "_key")).getField("_key").alias("_key")))
    short = distinct.where(F.length("_lpat") < gram).select("_lpat", F.col("_lpat").alias("_key"))
    return rare.unionByName(short)


_BUILT: dict = {}       # of a Python worker: the automaton it used last, by name


def _automaton(name: str, shared: Broadcast):
    if name not in _BUILT:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, places in shared.value.items():
            automaton.add_word(text, places)
        automaton.make_automaton()
        _BUILT.clear()
        _BUILT[name] = automaton
    return _BUILT[name]


def _automaton_pass(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``_tid, _at``: which of the collected patterns (by place) each text holds."""
    by_text: dict[str, list[int]] = {}
    for at, row in enumerate(patterns):
        by_text.setdefault(row["_lpat"], []).append(at)
    shared = texts.sparkSession.sparkContext.broadcast(by_text)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared)
        for batch in batches:
            rows, places = [], []
            for row, text in enumerate(batch.column(1)):
                found: set[int] = set()
                for _, hit in automaton.iter(text.as_py() or ""):
                    found.update(hit)
                rows += [row] * len(found)
                places += sorted(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())],
                names=["_tid", "_at"])

    schema = T.StructType([texts.schema["_tid"], T.StructField("_at", T.LongType())])
    return texts.select("_tid", "_ltext").mapInArrow(run, schema)


def substring_matches(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame,
                      pat_keys: str | list[str], pat_col: str, gram: int = GRAM,
                      max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """(text id, pattern key columns) of all lower(pattern) ⊂ lower(text).
    Empty and null patterns never match; a null text holds none."""
    keys = [pat_keys] if isinstance(pat_keys, str) else list(pat_keys)
    pats = (patterns.where(F.col(pat_col).isNotNull() & (F.length(pat_col) > 0))
                    .select(F.struct(*keys).alias("_pkey"), F.lower(pat_col).alias("_lpat")))
    probe = pats.agg(F.coalesce(F.sum(F.octet_length("_lpat")), F.lit(0)).alias("bytes"),
                     F.collect_set(F.when(F.length("_lpat") < gram, F.length("_lpat")))
                     .alias("short")).first()
    lowered = texts.select(F.col(id_col).alias("_tid"), F.lower(text_col).alias("_ltext"))
    if 0 < probe["bytes"] <= max_bytes:
        rows = pats.collect()        # their bytes are checked above
        spark = texts.sparkSession
        key_type = T.StructType([T.StructField("_at", T.LongType()), pats.schema["_pkey"]])
        placed = spark.createDataFrame([(i, r["_pkey"]) for i, r in enumerate(rows)], key_type)
        hits = _automaton_pass(spread(lowered), rows).join(F.broadcast(placed), "_at")
    else:
        tkeys = _keys(lowered, "_ltext", [gram, *probe["short"]], "_tid")
        # one key per pattern and distinct keys per text: pairs are already unique
        hits = (tkeys.join(_pattern_keys(pats, gram), "_key").select("_tid", "_lpat")
                .join(lowered, "_tid").where(F.col("_ltext").contains(F.col("_lpat")))
                .select("_tid", "_lpat").join(pats, "_lpat"))
    return hits.select(F.col("_tid").alias(id_col), "_pkey.*")


def first_seen_names(df: DataFrame, name_col: str = "company_name",
                     order_col: str = "row_id") -> DataFrame:
    """Distinct non-null names with their first position."""
    return (df.where(F.col(name_col).isNotNull())
              .groupBy(F.col(name_col).alias("name"))
              .agg(F.min(order_col).alias("first_row")))


def detect_company(questions: DataFrame, companies: DataFrame,
                   qid: str = "question_id", qtext: str = "question") -> DataFrame:
    """Per question the first company (table order) whose name occurs in
    the question, case-insensitively; null when none does."""
    names = first_seen_names(companies)
    hits = substring_matches(questions, qid, qtext, names, ["name", "first_row"], "name")
    best = hits.groupBy(qid).agg(F.min_by("name", "first_row").alias("company"))
    return questions.select(qid).join(best, qid, "left")
