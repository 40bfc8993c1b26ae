"""Inputs of the application re-derived from the given tables.

The application reads a company spreadsheet, user questions and evaluation
sheets that are not available; these functions build frames with the same
schemas from the testdata tables, with Spark, so that every query's work
grows with the tables. The same derivations are written in SQL in
``plans/oracles.py``.

- companies: one row per supplier; figures from ``lineitem`` (R1);
  labels 2025/2024 stand for the data years 2000/1999.
- questions: user turns of ``conversations`` with a routing suffix.
- evaluation sheets: user turn → following assistant turn pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.financials import (COMPANY_COLUMNS, finish_financials, fiscal_periods,
                                    period_aggregates)
from ..session import shuffle_partitions
from .tables import Tables

# heading label → data year on the synthetic facts (1995–2001)
YEAR_MAP = {2025: 2000, 2024: 1999}
PERIODS = fiscal_periods(YEAR_MAP)
# spreads conversations over all suppliers, whose names are put into text
NAME_STEP = 7919

# Test-fixture phrases injected into the Out-of-KB sheet so that each
# abstention pattern (and one near miss with a curly apostrophe) occurs.
REFUSAL_PHRASES = [
    "I don't know the answer to that.",
    "That is not in the knowledge base.",
    "Sorry, I cannot find that company.",
    "No information available for this request.",
    "There is insufficient context to answer.",
    "This question is out-of-kb.",
    "I cannot answer this question.",
    "I have no record of this.",
    "I don’t know.",
]


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    # read from files, so Spark knows their size and broadcasts them only below its threshold
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    region = t.region.select("r_regionkey", "r_name")
    dim = (t.supplier
           .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
           .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    facts = period_aggregates(t.lineitem, "l_suppkey", "l_shipdate",
                              "l_extendedprice", "l_discount", PERIODS)
    joined = dim.join(facts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    base = joined.select(
        F.col("s_suppkey").alias("row_id"),
        F.col("s_name").alias("company_name"),
        F.col("s_suppkey").cast("string").alias("company_code"),
        F.col("n_name").alias("industry"),
        F.concat(F.lit("Supplier based in "), F.col("n_name"), F.lit(", "),
                 F.col("r_name")).alias("description"),
        F.concat(F.lit("Region: "), F.col("r_name")).alias("additional_info"),
        F.concat(F.lit("www."),
                 F.lower(F.regexp_replace(F.col("s_name"), "[^A-Za-z0-9]", "")),
                 F.lit(".com.au")).alias("website"),
        F.lit(None).cast("string").alias("asx_page"),
        F.col("s_acctbal").alias("equity"),
        (F.lit(1) + F.col("s_suppkey") % 50).cast("double").alias("shares_mn"),
        *[F.col(c) for c in facts.columns if c.startswith("_")],
    )
    return finish_financials(base, PERIODS).select(*COMPANY_COLUMNS)


def _with_supplier(t: Tables, df: DataFrame, key: Column) -> DataFrame:
    """``df`` with ``s_name`` of the supplier ``key`` modulo their number."""
    n = t.supplier.count()
    names = t.supplier.select(F.col("s_suppkey").alias("_s"), "s_name")
    return df.withColumn("_k", key % max(n, 1)).join(names, F.col("_k") == F.col("_s"), "left")


def turn_id() -> Column:
    """One long per (conversation, turn), for turns below 2**32."""
    return F.shiftleft(F.col("conv_id"), 32) + F.col("turn")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, session_id, turn, question) from user turns.

    Suffix by ``conv_id % 6``: chart with 2024 / plain plot / chart of one
    company for 2025 / nothing / a company name / chart of one company for
    both years. The company is the supplier ``(conv_id * 7919 + turn)`` modulo
    the number of suppliers, looked up in the whole ``supplier`` table."""
    t = Tables(spark, sf_dir)
    conv = _with_supplier(t, t.conversations.where(F.col("role") == "user"),
                          F.col("conv_id") * NAME_STEP + F.col("turn"))
    name = F.coalesce(F.col("s_name"), F.lit(""))
    sel = F.col("conv_id") % 6
    suffix = (F.when(sel == 0, F.lit(" chart revenue 2024"))
              .when(sel == 1, F.lit(" plot"))
              .when(sel == 2, F.concat(F.lit(" visualize "), name, F.lit(" 2025")))
              .when(sel == 3, F.lit(""))
              .when(sel == 4, F.concat(F.lit(" "), name))
              .otherwise(F.concat(F.lit(" graph 2024 and 2025 for "), name)))
    return conv.select(
        turn_id().alias("question_id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn"),
        F.concat(F.col("text"), suffix).alias("question"),
    )


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn followed by an assistant turn in the same conversation.
    The window is per conversation (a handful of turns), never global. Its
    shuffle is stated as an explicit ``repartition(n, conv_id)`` (the window
    reuses it, no extra exchange): AQE would otherwise coalesce a small
    shuffle into one task, and the scoring downstream is CPU-heavy Python."""
    t = Tables(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    conv = t.conversations.repartition(shuffle_partitions(spark), "conv_id").select(
        "conv_id", "turn", "role", "text",
        F.lead("role").over(w).alias("next_role"),
        F.lead("text").over(w).alias("next_text"),
        F.lead("turn").over(w).alias("next_turn"),
    )
    return conv.where((F.col("role") == "user") & (F.col("next_role") == "assistant")
                      & (F.col("next_turn") == F.col("turn") + 1)).select(
        "conv_id", "turn", F.col("text").alias("query"), F.col("next_text").alias("gold"))


def eval_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long frame of the three evaluation sheets with a ``sheet`` column:
    sheet, row_id, query, expected_company, gold, pred_k1, pred_k3, pred_k5.

    Sheet by ``conv_id % 3`` under names as people type them ("Known",
    "Infered", "Out-of-KB"). Known/Inferred answers: k=1 echoes the question
    (null every 13th conversation), k=3 is the gold answer followed by the
    question, k=5 is the gold answer. Out-of-KB answers: empty every 7th
    conversation, an abstention phrase when (conv_id + k) % 4 = 0, null for
    k=3 every 11th conversation, otherwise the assistant text."""
    pairs = _with_supplier(Tables(spark, sf_dir), qa_pairs(spark, sf_dir),
                           F.col("conv_id") * NAME_STEP)
    c = F.col("conv_id")
    sheet = (F.when(c % 3 == 0, F.lit("Known"))
             .when(c % 3 == 1, F.lit("Infered"))
             .otherwise(F.lit("Out-of-KB")))
    phrases = F.array(*[F.lit(p) for p in REFUSAL_PHRASES])

    def outkb(k: int) -> Column:
        pick = F.get(phrases, ((c + F.col("turn") + k) % len(REFUSAL_PHRASES)).cast("int"))
        out = (F.when(c % 7 == 0, F.lit(""))
               .when((c + k) % 4 == 0, pick))
        if k == 3:
            out = out.when(c % 11 == 0, F.lit(None).cast("string"))
        return out.otherwise(F.col("gold"))

    is_outkb = c % 3 == 2
    k1 = F.when(c % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("query"))
    k3 = F.concat(F.col("gold"), F.lit(" "), F.col("query"))
    k5 = F.col("gold")
    return pairs.select(
        sheet.alias("sheet"),
        turn_id().alias("row_id"),
        F.col("query"),
        F.col("s_name").alias("expected_company"),
        F.col("gold"),
        F.when(is_outkb, outkb(1)).otherwise(k1).alias("pred_k1"),
        F.when(is_outkb, outkb(3)).otherwise(k3).alias("pred_k3"),
        F.when(is_outkb, outkb(5)).otherwise(k5).alias("pred_k5"),
    )


def directory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory sheet with repeated companies: one row per order, carrying
    the ordering customer. Descriptions differ between a customer's rows
    (so keep-first matters) and are empty for pending orders."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "inner").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("c_name").alias("company_name"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("company_code"),
        F.col("c_mktsegment").alias("industry"),
        F.when(F.col("o_orderstatus") == "P", F.lit(""))
         .otherwise(F.concat(F.lit("Customer with order status "), F.col("o_orderstatus"),
                             F.lit(", priority "), F.col("o_orderpriority")))
         .alias("description"),
    )


def directory_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short descriptions for customers in debit (company_code → text)."""
    t = Tables(spark, sf_dir)
    return t.customer.where(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("company_code"),
        F.concat(F.lit("Account in debit ("), F.col("c_mktsegment"), F.lit(")"))
         .alias("short_description"),
    )
