"""Chart answers (Q2 full-year top-5, Q3 half-year) for a batch of questions.

The series a chart shows depends only on (company filter, years), not on the
question. So the plan computes each distinct chart once and joins questions
to it — it never copies the company table per question:

* no company named → one of three global top-5 tables (≤ 15 rows, a bound
  fixed by the parameters, so broadcasting it is safe);
* company named → companies whose name contains it (P4, via the n-gram
  substring join), top-5 per (company, years) with a partial
  ``WindowGroupLimit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (CHART_FAIL_MESSAGE, CHART_OK_MESSAGE, SERIES_FY, SERIES_H1,
                         TOP_COMPANIES)
from ..functions.text import is_chart_question, year_flags
from ..session import bounded_broadcast, cut_lineage
from .entity import detect_company, substring_matches
from .topk import row_max, top_n

MODES = ("2024", "2025", "both")


def _mode(show24, show25):
    return (F.when(show24 & show25, F.lit("both"))
             .when(show25, F.lit("2025"))
             .otherwise(F.lit("2024")))


def _rank_key():
    return (F.when(F.col("mode") == "2025", F.col("rev_fy_2025"))
             .when(F.col("mode") == "2024", F.col("rev_fy_2024"))
             .otherwise(row_max("rev_fy_2024", "rev_fy_2025")))


def route(questions: DataFrame) -> DataFrame:
    """F4 + F5 per question: is_chart, show_2024, show_2025, mode."""
    s24, s25 = year_flags(F.col("question"))
    return questions.select(
        "question_id", "question",
        is_chart_question(F.col("question")).alias("is_chart"),
        s24.alias("show_2024"), s25.alias("show_2025"),
        _mode(s24, s25).alias("mode"))


def chart_requests(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """Chart questions with detected company (J1) and year flags."""
    routed = route(questions).where(F.col("is_chart"))
    found = detect_company(routed.select("question_id", "question"), companies)
    return routed.join(found, "question_id", "left").select(
        "question_id", "company", "show_2024", "show_2025", "mode")


def _company_matches(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """(company, row_id) for every company row whose name contains a
    requested company name (case-insensitive, literal)."""
    wanted = requests.where(F.col("company").isNotNull()).select("company").distinct()
    hits = substring_matches(companies.select("row_id", "company_name"), "row_id",
                             "company_name", wanted, "company", "company")
    return hits


def filter_by_name(companies: DataFrame, company: str | None, regex: bool = False,
                   name_col: str = "company_name") -> DataFrame:
    """P4 for one name: rows whose name contains it, whatever the case; a null name
    never matches, no name keeps every row. With ``regex`` it is a Java regular
    expression searched for anywhere in the name."""
    if not company:
        return companies
    name = F.col(name_col)
    if regex:
        return companies.where(name.rlike("(?iu)" + company))
    return companies.where(F.lower(name).contains(F.lower(F.lit(company))))


def filter_companies(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """P4 for a set of requested names: (company, row_id, company_name) of
    every company row whose name contains a requested name."""
    return (_company_matches(requests, companies)
            .join(companies.select("row_id", "company_name"), "row_id")
            .select("company", "row_id", "company_name"))


def _bars(companies: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """Top-n companies per distinct chart spec (company or none, mode)."""
    cols = ["row_id", "company_name", "rev_fy_2024", "rev_fy_2025"]
    comp = companies.select(*cols)
    # specs without a company: global top-n for each of the three modes
    modes = F.array(*[F.lit(m) for m in MODES])
    global_top = top_n(comp.withColumn("mode", F.explode(modes)).withColumn("_k", _rank_key()),
                       "_k", n, partition_by=["mode"])
    global_top = global_top.withColumn("company", F.lit(None).cast("string"))
    # specs with a company: matching rows only, top-n per (company, mode)
    specs = requests.where(F.col("company").isNotNull()).select("company", "mode").distinct()
    matched = (_company_matches(requests, companies)
               .join(specs, "company")
               .join(comp, "row_id")
               .withColumn("_k", _rank_key()))
    named_top = top_n(matched, "_k", n, partition_by=["company", "mode"])
    keep = ["company", "mode", "rank", *cols]
    return global_top.select(*keep).unionByName(named_top.select(*keep))


def chart_answers(questions: DataFrame, companies: DataFrame,
                  n: int = TOP_COMPANIES) -> tuple[DataFrame, DataFrame]:
    """Q2: (answers, series).

    answers: question_id, company, show_2024, show_2025, status, message,
    n_bars — status 'no_data' when a named company matches nothing (P5).
    series: question_id, rank, row_id, company_name, series, value (P18)."""
    # requests feed the company match, the bars and the answers: store once
    req = cut_lineage(chart_requests(questions, companies))
    # bars are counted for the broadcast check and then joined: write once
    bars = cut_lineage(_bars(companies, req, n))
    # null-safe spec key: (company or '', mode)
    spec = lambda c: F.concat_ws("\u0001", F.coalesce(F.col(c), F.lit("")), F.col("mode"))
    bars = bars.withColumn("_spec", spec("company")).drop("company", "mode")
    req = req.withColumn("_spec", spec("company"))
    # bars: ≤ 3·n rows for unnamed specs + n per named company; size-checked
    per_q = req.join(bounded_broadcast(bars), "_spec", "left")
    counts = per_q.groupBy("question_id").agg(F.count("row_id").alias("n_bars"))
    answers = (req.join(counts, "question_id").select(
        "question_id", "company", "show_2024", "show_2025",
        F.when(F.col("n_bars") > 0, F.lit("ok")).otherwise(F.lit("no_data")).alias("status"),
        F.when(F.col("n_bars") > 0, F.lit(CHART_OK_MESSAGE))
         .otherwise(F.lit(CHART_FAIL_MESSAGE)).alias("message"),
        F.col("n_bars").cast("long").alias("n_bars")))
    series = _series(per_q.where(F.col("row_id").isNotNull()), "fy",
                     ["question_id", "rank", "row_id", "company_name"])
    return answers, series


def _series(df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """One row per (bar, shown year): series label and value."""
    labels = SERIES_FY if kind == "fy" else SERIES_H1
    col = "rev_fy_{}" if kind == "fy" else "rev_h1_{}"
    long = df.select(*keys, "show_2024", "show_2025", F.explode(F.array(
        F.struct(F.lit(2024).alias("year"), F.lit(labels[2024]).alias("series"),
                 F.col(col.format(2024)).alias("value")),
        F.struct(F.lit(2025).alias("year"), F.lit(labels[2025]).alias("series"),
                 F.col(col.format(2025)).alias("value")))).alias("_s"))
    shown = ((F.col("_s.year") == 2024) & F.col("show_2024")) | \
            ((F.col("_s.year") == 2025) & F.col("show_2025"))
    return long.where(shown).select(*keys, "_s.series", "_s.value")


def half_year_answers(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """Q3 by question: ``question_id, company, show_2024, show_2025, n_companies, status,
    message`` of every chart question, where (company, show_2024, show_2025) names its
    chart in ``half_year_charts``. Companies are counted once per distinct name, not
    per question."""
    req = cut_lineage(chart_requests(questions, companies))
    named = _company_matches(req, companies).groupBy("company").agg(F.count("*").alias("n"))
    every = companies.agg(F.count("row_id").alias("all")).select("all")
    counted = (req.join(named, "company", "left").join(F.broadcast(every), F.lit(True))
               .withColumn("n_companies", F.when(F.col("company").isNull(), F.col("all"))
                           .otherwise(F.coalesce("n", F.lit(0)))))
    some = F.col("n_companies") > 0
    return counted.select(
        "question_id", "company", "show_2024", "show_2025",
        F.col("n_companies").cast("long").alias("n_companies"),
        F.when(some, F.lit("ok")).otherwise(F.lit("no_data")).alias("status"),
        F.when(some, F.lit(CHART_OK_MESSAGE)).otherwise(F.lit(CHART_FAIL_MESSAGE))
         .alias("message"))


def half_year_charts(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """Q3: half-year revenue of every matching company in table order (no
    top-n). One chart per distinct (company, years) spec; questions refer to
    a spec through ``chart_requests``.
    Output: company, show_2024, show_2025, row_id, company_name, series, value."""
    req = cut_lineage(chart_requests(questions, companies))
    specs = req.select("company", "show_2024", "show_2025").distinct()
    comp = companies.select("row_id", "company_name", "rev_h1_2024", "rev_h1_2025")
    named = (_company_matches(req, companies)
             .join(specs.where(F.col("company").isNotNull()), "company")
             .join(comp, "row_id"))
    # unnamed specs: at most the three year combinations; explode them on the
    # company rows and keep those some question asked for (≤ 3-row semi join)
    combos = F.array(*[F.struct(F.lit(a).alias("show_2024"), F.lit(b).alias("show_2025"))
                       for a, b in ((True, True), (True, False), (False, True))])
    asked = specs.where(F.col("company").isNull()).select("show_2024", "show_2025")
    unnamed = (comp.select("*", F.explode(combos).alias("_c"))
                   .select("*", "_c.show_2024", "_c.show_2025").drop("_c")
                   .join(F.broadcast(asked), ["show_2024", "show_2025"], "left_semi")
                   .withColumn("company", F.lit(None).cast("string")))
    both = named.unionByName(unnamed)
    return _series(both, "h1", ["company", "show_2024", "show_2025", "row_id", "company_name"])
