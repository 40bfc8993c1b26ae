"""Q4 evaluation report: S3 sheet aliases · S4 guard · U2 unpivot · F1 clean ·
F9/F10 scoring · U1 union by name · A1 cohort × k means.

Input: one long frame with a ``sheet`` column (one source partition per
sheet, see ``sources/sheets.py``): sheet, row_id, query, expected_company,
gold, pred_k1, pred_k3, pred_k5 (absent columns behave as '').

Everything is a narrow projection except the final aggregate, whose
partial (map-side) step makes a dominant cohort harmless. Only ROUGE-L
runs in Python (Arrow batches), and only on Known/Inferred rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ALIASES_INFERRED, ALIASES_KNOWN, ALIASES_OUT_OF_KB, COHORT_INFERRED,
                         COHORT_KNOWN, COHORT_OUT_OF_KB, K_VALUES, METRIC_COLUMNS)
from ..functions.embed import DEFAULT_DIM, hashing_embed
from ..functions.rouge import pair_scores_col, rouge_l_col
from ..functions.text import clean, looks_like_refusal, norm_label
from ..session import cut_lineage
from ..sources.embeddings import EmbeddingStore, text_hash

ALIASES = [(COHORT_KNOWN, ALIASES_KNOWN), (COHORT_INFERRED, ALIASES_INFERRED),
           (COHORT_OUT_OF_KB, ALIASES_OUT_OF_KB)]
BASE_COLUMNS = ["query", "expected_company", "gold"]
PRED_COLUMNS = {k: f"pred_k{k}" for k in K_VALUES}
PER_QUERY_COLUMNS = ["rougeL", "semantic_cosine", "good_refusal", "hallucination_rate",
                     "cohort", "row_id", "k", "query", "expected_company", "gold", "pred"]


def alias_table(spark) -> DataFrame:
    rows = [(cohort, i, alias) for cohort, aliases in ALIASES for i, alias in enumerate(aliases)]
    df = spark.createDataFrame(rows, "cohort string, alias_order int, alias string")
    return df.withColumn("norm", norm_label("alias"))


def resolve_sheets(sheets: DataFrame) -> DataFrame:
    """S3: (sheet, cohort). Both sides are normalised; per cohort the first
    alias that matches wins; if several sheet names normalise alike, the
    sheet seen last (largest first row_id, then name) wins."""
    present = (sheets.groupBy("sheet").agg(F.min("row_id").alias("_first"))
                     .withColumn("norm", norm_label("sheet")))
    latest = (present.groupBy("norm")
                     .agg(F.max(F.struct("_first", "sheet")).getField("sheet").alias("sheet")))
    aliases = alias_table(sheets.sparkSession)
    matched = aliases.join(latest, "norm")
    return (matched.groupBy("cohort")
                   .agg(F.min_by("sheet", "alias_order").alias("sheet"))
                   .select("sheet", "cohort"))


def require_sheets(sheets: DataFrame, resolved: DataFrame) -> None:
    """Fail, listing the available names, when nothing is recognised."""
    if resolved.isEmpty():
        names = [r[0] for r in sheets.select("sheet").distinct().collect()]
        raise RuntimeError("no sheet name fits a cohort. Available: "
                           + ", ".join(sorted(n for n in names if n is not None)))


def _text(df: DataFrame, c: str) -> Column:
    """An absent column behaves as ''."""
    return F.col(c) if c in df.columns else F.lit("")


def unpivot_answers(df: DataFrame) -> DataFrame:
    """Three rows per input row (k = 1, 3, 5), null answers kept."""
    preds = [F.struct(F.lit(k).alias("k"), _text(df, c).cast("string").alias("pred"))
             for k, c in PRED_COLUMNS.items()]
    keep = [c for c in df.columns if c not in PRED_COLUMNS.values()]
    return (df.select(*keep, F.explode(F.array(*preds)).alias("_p"))
              .select(*keep, F.col("_p.k").cast("int").alias("k"), F.col("_p.pred").alias("pred")))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length arrays, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def with_text_cosine(df: DataFrame, a: str, b: str, out: str,
                     embed: Callable = hashing_embed,
                     store: EmbeddingStore | None = None) -> DataFrame:
    """F8 with any embedder: cosine of the unit vectors of two text columns (a null
    text counts as empty). Each distinct text is embedded once, and with a
    ``store`` only if no earlier run has embedded it. Texts are joined by hash."""
    pairs = df.withColumn("_a", text_hash(F.col(a))).withColumn("_b", text_hash(F.col(b)))
    texts = df.select(F.coalesce(a, F.lit("")).alias("_t")).union(
        df.select(F.coalesce(b, F.lit("")))).distinct()
    if store is None:
        vectors = cut_lineage(embed(texts, "_t", "_e").select(
            text_hash(F.col("_t")).alias("_h"), "_e"))
    else:
        vectors = store.vectors(cut_lineage(texts), "_t", embed).toDF("_h", "_e")
    both = (pairs.join(vectors.select(F.col("_h").alias("_a"), F.col("_e").alias("_ea")), "_a")
            .join(vectors.select(F.col("_h").alias("_b"), F.col("_e").alias("_eb")), "_b"))
    return both.select(*df.columns, F.round(dot(F.col("_ea"), F.col("_eb")), 9).alias(out))


def score_known_inferred(df: DataFrame, cohort: str | None = None,
                         stem: bool = True, dim: int = DEFAULT_DIM,
                         embed: Callable | None = None,
                         store: EmbeddingStore | None = None) -> DataFrame:
    """F9 on unpivoted rows: ROUGE-L and cosine; reliability metrics null.
    The cohort label comes from ``cohort`` or else the ``cohort`` column.
    Without ``embed`` the cosine is that of the hashing embedder and both scores come
    from one Arrow pass (``pair_scores_col``); with it, from ``with_text_cosine``, over
    ``store`` if given."""
    gold, pred = clean("gold"), clean("pred")
    out = df.select(
        (F.lit(cohort) if cohort else F.col("cohort")).alias("cohort"),
        F.col("row_id").cast("long").alias("row_id"), "k",
        clean(_text(df, "query")).alias("query"),
        clean(_text(df, "expected_company")).alias("expected_company"),
        gold.alias("gold"), pred.alias("pred"))
    empty = (F.col("gold") == "") | (F.col("pred") == "")
    if embed is None:
        scored = out.withColumn("_s", F.when(~empty, pair_scores_col(
            F.col("pred"), F.col("gold"), stem, dim)))
    else:
        both = with_text_cosine(out, "pred", "gold", "_c", embed, store)
        scored = both.withColumn("_s", F.when(~empty, F.struct(
            rouge_l_col(F.col("pred"), F.col("gold"), stem).alias("rougeL"),
            F.col("_c").alias("cosine"))))
    return scored.select(
        F.coalesce(F.col("_s.rougeL"), F.lit(0.0)).alias("rougeL"),
        F.coalesce(F.col("_s.cosine"), F.lit(0.0)).alias("semantic_cosine"),
        F.lit(None).cast("double").alias("good_refusal"),
        F.lit(None).cast("double").alias("hallucination_rate"),
        "cohort", "row_id", "k", "query", "expected_company", "gold", "pred")


def score_out_of_kb(df: DataFrame) -> DataFrame:
    """good_refusal = abstains; hallucination = non-empty and does not
    abstain (an empty answer scores 0 / 0). Query, expected company and gold
    are blanked."""
    refusal = looks_like_refusal(F.col("pred"))
    nonempty = clean("pred") != ""
    return df.select(
        F.lit(None).cast("double").alias("rougeL"),
        F.lit(None).cast("double").alias("semantic_cosine"),
        refusal.cast("double").alias("good_refusal"),
        (nonempty & ~refusal).cast("double").alias("hallucination_rate"),
        F.lit(COHORT_OUT_OF_KB).alias("cohort"),
        F.col("row_id").cast("long").alias("row_id"), "k",
        F.lit("").alias("query"), F.lit("").alias("expected_company"), F.lit("").alias("gold"),
        clean("pred").alias("pred"))


def union_cohorts(frames: list[DataFrame]) -> DataFrame:
    """By column name, duplicates kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*PER_QUERY_COLUMNS)


def per_query_metrics(sheets: DataFrame, stem: bool = True, embed: Callable | None = None,
                      store: EmbeddingStore | None = None) -> DataFrame:
    """S3 → S4 → U2 → F9/F10 → U1: the per-query metrics frame; ``embed`` and
    ``store`` as in ``score_known_inferred``."""
    # the (sheet, cohort) map feeds the guard and the join: written once
    resolved = cut_lineage(resolve_sheets(sheets))
    require_sheets(sheets, resolved)
    tagged = sheets.join(F.broadcast(resolved), "sheet")  # ≤ 3 rows
    return metrics_of_cohorts(tagged, stem, embed, store)


def metrics_of_cohorts(tagged: DataFrame, stem: bool = True, embed: Callable | None = None,
                       store: EmbeddingStore | None = None) -> DataFrame:
    """U2 → F9/F10 → U1 of rows that carry their ``cohort``."""
    long = unpivot_answers(tagged)
    # Known and Inferred share one scoring pass (same metrics)
    frames = [
        score_known_inferred(long.where(F.col("cohort").isin(COHORT_KNOWN, COHORT_INFERRED)),
                             stem=stem, embed=embed, store=store),
        score_out_of_kb(long.where(F.col("cohort") == COHORT_OUT_OF_KB)),
    ]
    return union_cohorts(frames)


def metrics_by_cohort(per_query: DataFrame) -> DataFrame:
    """A1: means by (cohort, k); nulls skipped, all-null → null, null keys kept."""
    return (per_query.groupBy("cohort", "k")
                     .agg(*[F.avg(m).alias(m) for m in METRIC_COLUMNS])
                     .orderBy("cohort", "k"))
