"""Golden vectors and oracle comparisons of the analytics engine."""

import datetime as dt

import duckdb
import numpy as np
import pytest

from tidemark.functions import text as tx
from tidemark.operators import performance as px, statements as fr, technical as ta
from tidemark.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def bars(spark, closes, symbol="A"):
    day = dt.datetime(2024, 1, 1)
    rows = [(symbol, day + dt.timedelta(days=i), float(c), float(c), float(c), float(c), 100) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def test_rsi_golden(spark):
    up = ta.exponential(bars(spark, range(1, 40))).toPandas()["rsi"]
    assert up.iloc[-1] == 100 and up.iloc[:13].isna().all()
    assert ta.exponential(bars(spark, [10.0] * 40)).toPandas()["rsi"].iloc[-1] == 50


def test_screener_golden(spark):
    df = spark.createDataFrame([("A", 8.0, 20.0), ("B", 25.0, 10.0), ("C", -5.0, 30.0)], "symbol string, pe double, roe double")
    kept = df.where(px.conjunction(df, [("pe", "<=", 15), ("roe", ">=", 15)]))
    assert {r.symbol for r in kept.collect()} == {"A", "C"}
    assert not df.where(px.conjunction(df, [("missing", ">", 0)])).count()
    assert {r.symbol: r.score for r in px.composite_rank(df, {"pe": 1, "roe": 1}).collect()} == {"A": 83.3, "C": 50.0, "B": 41.7}


def test_ttm_golden(spark):
    q = spark.createDataFrame([("A", k, float(v)) for v, k in enumerate((20244, 20251, 20252, 20253, 20254), 1)], "symbol string, period_key int, x double")
    from pyspark.sql import functions as F

    got = {r.period_key: r.t for r in fr.with_quarters(q).withColumn("t", fr.ttm(F.col("x"))).collect()}
    assert got[20252] is None and got[20253] == 10 and got[20254] == 14


def test_periods_and_accents(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("2024-Q3", "Đường phố"), ("Q1/2025", "é"), ("2023", "x"), ("none", None)], "a string, b string")
    got = r.select(tx.period_key(F.col("a")).alias("k"), tx.strip_accents(F.col("b")).alias("s")).collect()
    assert [x.k for x in got] == [20243, 20251, 20230, None] and got[0].s == "Duong pho"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, db, name):
    a, b = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    key = [c for c in cols if not np.issubdtype(a[c].dtype, np.floating)] or cols
    a, b = (x[cols].sort_values(key + [c for c in cols if c not in key], ignore_index=True) for x in (a, b))
    for c in cols:
        if np.issubdtype(a[c].dtype, np.number):
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=1e-4, equal_nan=True), c


HAND = {
    "revenue": (1000, 1200), "cogs": (-600, -700), "gross_profit": (400, 500), "operating_profit": (150, 200), "profit_before_tax": (140, 190), "interest_expense": (-10, -10), "income_tax": (28, 38), "net_income": (112, 152),
    "net_income_parent": (100, 140), "depreciation": (50, 60), "cfo": (130, 180), "capex": (-40, -60), "dividends_paid": (-30, -50), "total_assets": (2000, 2400), "equity": (1000, 1200), "total_liabilities": (1000, 1200),
    "current_assets": (800, 1000), "current_liabilities": (500, 550), "inventory": (200, 240), "receivables": (150, 180), "payables": (100, 120), "cash": (100, 150), "short_term_debt": (200, 220), "long_term_debt": (300, 280),
    "minority_interest": (50, 60), "retained_earnings": (300, 380), "shares_outstanding": (10, 10),
}


def hand(spark, symbol="A", keys=(20240, 20250), **other):
    items = {**HAND, **other}
    rows = [(symbol, k, *[None if v[i] is None else float(v[i]) for v in items.values()]) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "symbol string, period_key int, " + ", ".join(f"{x} double" for x in items))


def test_ratios_and_valuation_of_hand_data(spark):
    r = fr.ratios(hand(spark)).where("period_key = 20250").first()
    want = {"roe": 140 / 1045 * 100, "roa": 152 / 2200 * 100, "gross_margin": 500 / 1200 * 100, "interest_cover": 20, "current_ratio": 1000 / 550, "debt_equity": 500 / 1200, "revenue_growth": 20, "eps": 14, "bvps": 114, "fcf": 120}
    assert all(r[k] == pytest.approx(v) for k, v in want.items())
    v = fr.valuation(hand(spark), spark.createDataFrame([("A", 200.0)], "symbol string, price double")).first()
    assert (v.pe, v.pb, v.enterprise_value) == pytest.approx((200 / 14, 200 / 114, 2000 + 500 - 150 + 60))


def test_z_score_of_hand_data(spark):
    base = 3.25 + 6.56 * 450 / 2400 + 6.72 * 200 / 2400
    z = fr.z_score(hand(spark)).first()
    assert z.z == pytest.approx(base + 3.26 * 380 / 2400 + 1.05) and z.zone == "safe"
    assert fr.z_score(hand(spark, total_liabilities=(0, 800))).first().z == pytest.approx(base + 3.26 * 380 / 2400 + 1.05 * 1.5)
    for other in ({"retained_earnings": (300, None)}, {"customer_deposits": (5, None)}, {"total_assets": (2000, 0)}):
        assert fr.z_score(hand(spark, **other)).first().z is None
    assert fr.z_score(hand(spark, keys=(20251, 20252))).first().period_key == 20252


def test_f_score_of_hand_data(spark):
    get = lambda **other: fr.f_score(hand(spark, **other)).first()[2:4]
    assert get() == (8, 9)  # turnover stays at 0.5
    assert get(keys=(20241, 20250)) == (None, 0)
    assert get(gross_profit=(None, None)) == (8, 9) and get(customer_deposits=(1, 1)) == (7, 8)
    assert get(shares_outstanding=(None, None), charter_capital=(100_000, 200_000)) == (7, 9) and get(cfo=(130, None)) == (6, 7)


def test_growth_over_years_by_row(spark):
    rows = [("A", 20200, 8.0), ("A", 20210, None), ("A", 20214, 1.0), ("A", 20220, 20.0), ("A", 20230, 30.0), ("A", 20240, 64.0), ("A", 20250, None), ("B", 20240, 3.0), ("C", 20190, -1.0), ("C", 20200, 1.0), ("C", 20210, 1.0), ("C", 20220, 8.0)]
    got = {r.symbol: r.cagr for r in fr.cagr(spark.createDataFrame(rows, "symbol string, period_key int, x double"), "x").collect()}
    assert got["A"] == pytest.approx(100) and got["B"] is None and got["C"] is None


def test_warnings_of_canonical_rows(spark):
    get = lambda **other: fr.warnings(hand(spark, **other)).first()
    assert get().warnings == "" and get().revenue_growth == pytest.approx(20) and get().net_income_growth == pytest.approx(40)
    assert get(net_income_parent=(100, 80)).warnings == "profit falls" and get(net_income_parent=(None, None), net_income=(100, 80)).warnings == "profit falls"
    assert get(net_income=(112, -50), net_income_parent=(100, -40)).warnings == "profit falls"  # a loss with cash coming in is no outflow
    assert get(cfo=(130, -1)).warnings == "cash outflow" and get(cfo=(-130, None)).warnings == "cash outflow"
    assert get(short_term_debt=(None, None), long_term_debt=(None, None), total_liabilities=(1000, 2500)).warnings == "high debt"


def test_growth_goldens(spark):
    q = lambda rows: fr.growth_vs_prior(spark.createDataFrame([("A", k, float(v)) for k, v in rows], "symbol string, period_key int, x double"), "x").first()
    assert (lambda r: (r.period_key, r.growth, r.basis))(q([(20242, 100), (20243, 110), (20244, 120), (20251, 125), (20252, 130)])) == (20252, pytest.approx(30), "year")
    assert q([(20244, 200), (20251, 110), (20241, 90)]).growth == pytest.approx((110 - 90) / 90 * 100)
