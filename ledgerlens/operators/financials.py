"""Half-year / full-year company figures and ratios derived from facts.

One pass over the fact table: a filter on the fact timestamp that reaches the
parquet scan (the union of all periods), then a single ``groupBy(key)`` with
conditional sums. The partial (map-side) aggregate reduces every key to one
row per input partition before the shuffle, so a key holding a third of the
facts costs no more shuffle than any other key.

Money is summed exactly (integer units on longs, see ``SPLIT_BITS``),
rounded to cents and only then turned into DOUBLE; ratios are plain IEEE divisions of those
doubles. The result is therefore bit-identical whatever the partitioning.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Period:
    name: str           # e.g. "h1_2025"
    start: dt.datetime  # inclusive
    end: dt.datetime    # exclusive


def fiscal_periods(label_to_year: dict[int, int]) -> list[Period]:
    """H1 = January–June of the year; FY = the twelve months ending June.

    ``label_to_year`` maps the label printed in headings (2025) to the data
    year it stands for (e.g. 2000 on the synthetic facts)."""
    out = []
    for label, year in sorted(label_to_year.items(), reverse=True):
        out.append(Period(f"h1_{label}", dt.datetime(year, 1, 1), dt.datetime(year, 7, 1)))
        out.append(Period(f"fy_{label}", dt.datetime(year - 1, 7, 1), dt.datetime(year, 7, 1)))
    return out


def _in_period(ts: Column, p: Period) -> Column:
    return (ts >= F.lit(p.start)) & (ts < F.lit(p.end))


# Exact money sums on longs: every amount is an integer count of small units
# (cents × ten-thousandths …), split into parts of 24 bits and a highest one that are
# summed separately. At prices of up to a million each part stays far below 2**63 for
# ~10**13 rows in one group, so a key holding a third of the facts cannot overflow (an
# overflow would be an error, never a wrong sum), and long sums run several times
# faster than DECIMAL sums.
SPLIT_BITS = 24
_LOW_MASK = (1 << SPLIT_BITS) - 1
#: Decimals of a price and of a discount that count.
PRICE_DECIMALS, DISCOUNT_DECIMALS = 2, 4


def _ts_lit(t: dt.datetime) -> str:
    return f"TIMESTAMP_NTZ'{t.isoformat(sep=' ')}'"


def _join_sql(parts: list[str], decimals: int) -> str:
    """The parts, lowest first, as one exact decimal with so many decimals."""
    whole = " + ".join(f"CAST({part} AS DECIMAL(38,0)) * {1 << SPLIT_BITS * i}"
                       for i, part in enumerate(parts))
    unit = f"0.{1:0{decimals}d}"
    return (f"CAST({whole} AS DECIMAL({37 - decimals},0))"
            f" * CAST('{unit}' AS DECIMAL({decimals},{decimals}))")


def period_aggregates(facts: DataFrame, key: str, ts: str, price: str, discount: str,
                      periods: list[Period]) -> DataFrame:
    """Per key: revenue and profit for each period, plus price statistics
    over the union of periods.

    revenue = price × (1 − discount); profit = revenue × discount (a proxy;
    the facts carry no cost column). Prices are taken to the nearest cent
    and discounts to the nearest ten-thousandth (``round(x·10000)``, a compiled
    ``Math.round``), so the sums are exact.

    The period boundaries cut the time line into disjoint slices; each fact
    falls in at most one, so the first aggregate needs only a few long sums
    per row, keyed by (key, slice) and combined map-side. The second
    aggregate folds the few slices of each key into the periods.

    The many similar expressions are written as SQL expression strings: one
    parse call each instead of a dozen driver round trips."""
    lo = min(p.start for p in periods)
    hi = max(p.end for p in periods)
    cuts = sorted({p.start for p in periods} | {p.end for p in periods})
    slice_sql = "CASE " + " ".join(f"WHEN {ts} < {_ts_lit(cuts[i])} THEN {i - 1}"
                                   for i in range(1, len(cuts) - 1)) + f" ELSE {len(cuts) - 2} END"
    one = 10 ** DISCOUNT_DECIMALS
    price_u = f"CAST(round({price} * {10 ** PRICE_DECIMALS}D) AS BIGINT)"
    disc_u = f"CAST(round({discount} * {one}D) AS BIGINT)"
    revenue = f"({price_u} * ({one} - {disc_u}))"
    low, high = f"({revenue} & {_LOW_MASK})", f"shiftright({revenue}, {SPLIT_BITS})"
    # revenue × discount may not fit a long: each part times the discount, with its carry
    carried = f"({high} * {disc_u} + shiftright({low} * {disc_u}, {SPLIT_BITS}))"
    split = {"_r_0": low, "_r_1": high,
             "_p_0": f"({low} * {disc_u}) & {_LOW_MASK}", "_p_1": f"{carried} & {_LOW_MASK}",
             "_p_2": f"shiftright({carried}, {SPLIT_BITS})",
             "_x_0": f"{price_u} & {_LOW_MASK}", "_x_1": f"shiftright({price_u}, {SPLIT_BITS})"}
    revenue_parts, profit_parts, price_parts = (
        [c for c in split if c.startswith(name)] for name in ("_r", "_p", "_x"))
    per_slice = (
        facts
        .where(f"{ts} >= {_ts_lit(lo)} AND {ts} < {_ts_lit(hi)}")
        .selectExpr(key, f"{slice_sql} AS _slice", *[f"{e} AS {c}" for c, e in split.items()])
        .groupBy(key, "_slice")
        .agg(*[F.expr(f"sum({c}) AS {c}") for c in split], F.expr("count(1) AS _n"))
    )
    aggs = []
    for p in periods:
        members = ", ".join(str(i) for i in range(len(cuts) - 1)
                            if cuts[i] >= p.start and cuts[i + 1] <= p.end)
        for c in revenue_parts + profit_parts:
            aggs.append(F.expr(f"sum(CASE WHEN _slice IN ({members}) THEN {c} END) AS {c}_{p.name}"))
    aggs += [F.expr(f"sum({c}) AS {c}") for c in price_parts] + [F.expr("sum(_n) AS _price_n")]
    out = per_slice.groupBy(key).agg(*aggs)
    sums = []
    places = PRICE_DECIMALS + DISCOUNT_DECIMALS
    for p in periods:
        rev, profit = ([f"{c}_{p.name}" for c in parts] for parts in (revenue_parts, profit_parts))
        sums.append(f"{_join_sql(rev, places)} AS _rev_{p.name}")
        sums.append(f"{_join_sql(profit, places + DISCOUNT_DECIMALS)} AS _profit_{p.name}")
    sums.append(f"{_join_sql(price_parts, PRICE_DECIMALS)} AS _price_sum")
    return out.selectExpr(key, *sums, "_price_n")


def money(c: Column) -> Column:
    """Round an exact decimal to cents, then DOUBLE."""
    return F.round(c, 2).cast("double")


def pct_change(new: Column, old: Column) -> Column:
    return F.try_divide(new - old, old) * F.lit(100.0)


def finish_financials(df: DataFrame, periods: list[Period]) -> DataFrame:
    """Turn the raw period sums into the canonical company columns and
    the derived ratios (EPS, P/E, BVPS, P/B and % changes). Expects
    ``equity`` and ``shares_mn`` columns next to the aggregates.
    Two projections (money columns, then ratios over them) instead of a
    chain of ``withColumn`` calls, each of which re-analyses the plan."""
    names = sorted({p.name for p in periods})
    money_cols = []
    for name in names:
        kind, label = name.split("_")
        money_cols.append(money(F.col(f"_rev_{name}")).alias(f"rev_{kind}_{label}"))
        money_cols.append(money(F.col(f"_profit_{name}")).alias(f"profit_{kind}_{label}"))
    money_cols.append((F.try_divide(F.col("_price_sum").cast("double"),
                                    F.col("_price_n").cast("double")) / F.lit(1000.0))
                      .alias("market_price"))
    kept = [c for c in df.columns if not c.startswith("_")]
    base = df.select(*kept, *money_cols)
    c = F.col
    eps25 = F.try_divide(c("profit_h1_2025"), c("shares_mn"))
    bvps = F.try_divide(c("equity"), c("shares_mn"))
    ratios = []
    for kind in ("h1", "fy"):
        ratios.append(pct_change(c(f"rev_{kind}_2025"), c(f"rev_{kind}_2024"))
                      .alias(f"rev_{kind}_change"))
        ratios.append(pct_change(c(f"profit_{kind}_2025"), c(f"profit_{kind}_2024"))
                      .alias(f"profit_{kind}_change"))
    ratios += [eps25.alias("eps_h1_2025"),
               F.try_divide(c("profit_h1_2024"), c("shares_mn")).alias("eps_h1_2024"),
               F.try_divide(c("market_price"), eps25).alias("pe"),
               bvps.alias("bvps"),
               F.try_divide(c("market_price"), bvps).alias("pb")]
    return base.select("*", *ratios)


COMPANY_COLUMNS = [
    "row_id", "company_name", "company_code", "industry", "description",
    "additional_info", "website", "asx_page",
    "rev_h1_2025", "rev_h1_2024", "rev_h1_change",
    "profit_h1_2025", "profit_h1_2024", "profit_h1_change",
    "rev_fy_2025", "rev_fy_2024", "rev_fy_change",
    "profit_fy_2025", "profit_fy_2024", "profit_fy_change",
    "equity", "shares_mn", "market_price",
    "eps_h1_2025", "eps_h1_2024", "pe", "bvps", "pb",
]
