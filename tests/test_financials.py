import datetime as dt
from decimal import Decimal

from hypothesis import given, settings, strategies as st

from ledgerlens.operators import financials as fin

PERIODS = fin.fiscal_periods({2025: 2000, 2024: 1999})
SCHEMA = "k long, ts timestamp_ntz, price double, disc double"


def _expected(rows):
    out = {}
    for k, ts, price, disc in rows:
        for p in PERIODS:
            if p.start <= ts < p.end:
                pc, dc = Decimal(f"{price:.2f}"), Decimal(f"{disc:.4f}")
                rev = pc * (1 - dc)
                r = out.setdefault((k, p.name), [Decimal(0), Decimal(0)])
                r[0] += rev
                r[1] += rev * dc
    return out


money = st.decimals(min_value=0, max_value=Decimal("9999999999.99"), places=2)
rates = st.decimals(min_value=0, max_value=Decimal("1.00"), places=4)
days = st.integers(min_value=0, max_value=900)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), days, money, rates), min_size=1, max_size=40))
def test_split_long_sums_are_exact(spark, rows):
    base = dt.datetime(1998, 6, 1)
    data = [(k, base + dt.timedelta(days=d), float(p), float(r)) for k, d, p, r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["k"]: r for r in fin.period_aggregates(df, "k", "ts", "price", "disc", PERIODS)
           .collect()}
    exp = _expected(data)
    for (k, name), (rev, profit) in exp.items():
        assert got[k][f"_rev_{name}"] == rev
        assert got[k][f"_profit_{name}"] == profit


def test_large_group_does_not_overflow(spark):
    # 200k facts near the largest TPC-H price in one key and one period
    df = (spark.range(200_000)
          .selectExpr("0L AS k", "TIMESTAMP_NTZ'2000-02-01 00:00:00' AS ts",
                      "104949.50D AS price", "0.10D AS disc"))
    r = fin.period_aggregates(df, "k", "ts", "price", "disc", PERIODS).collect()[0]
    assert r["_rev_h1_2025"] == Decimal("104949.50") * Decimal("0.90") * 200_000
    assert r["_profit_h1_2025"] == Decimal("104949.50") * Decimal("0.90") * Decimal("0.10") * 200_000


def test_discount_of_more_than_two_decimals(spark):
    df = spark.sql("SELECT 1L AS k, TIMESTAMP_NTZ'2000-02-01 00:00:00' AS ts, "
                   "200.0D AS price, 0.055D AS disc")
    r = fin.period_aggregates(df, "k", "ts", "price", "disc", PERIODS).collect()[0]
    assert r["_rev_h1_2025"] == Decimal("189.00")
    assert r["_profit_h1_2025"] == Decimal("10.395")
    assert r["_rev_h1_2024"] is None
