"""Averages over chunks of a symbol against those of one grouped pass."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import technical as ta

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def bars(n, seed, flat=()):
    rng, price, day, rows = random.Random(seed), 100.0, dt.datetime(2000, 1, 1), []
    for i in range(n):
        if i not in flat:
            price *= 1 + rng.uniform(-0.03, 0.0303)
        spread = 0.0 if i in flat else rng.uniform(0, 2)
        rows.append((f"S{seed}", day + dt.timedelta(days=i), price, price + spread, price - spread, price, 100))
    return rows


def close_to(got, want):
    for n in ta.RECURSIVE:
        a, b = got[n].to_numpy(dtype=float), want[n].to_numpy(dtype=float)
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), n


@pytest.mark.parametrize("days", [7, 64])
def test_same_as_one_pass(spark, days):
    rows = bars(700, 1) + bars(450, 2, range(100, 330)) + bars(400, 3, range(0, 150)) + bars(20, 4) + bars(29, 5) + bars(1, 6) + bars(14, 7)
    df = spark.createDataFrame(rows, BAR)
    chunk = F.floor(F.datediff("ts", F.lit("2000-01-01")) / days)
    order = lambda d: d.orderBy("symbol", "ts").toPandas()
    close_to(order(ta.exponential_by_chunk(df, chunk=chunk)), order(ta.exponential(df)))


def test_columns_by_name_and_no_bars(spark):
    df = spark.createDataFrame(bars(90, 1), BAR)
    got = ta.exponential_by_chunk(df, ("rsi", "macd_hist"))
    assert got.columns == [*df.columns, "rsi", "macd_hist"]
    assert ta.exponential_by_chunk(df.where("false")).count() == 0


def test_least_bars(spark):
    get = lambda n: ta.exponential(spark.createDataFrame(bars(n, 1), BAR)).orderBy("ts").toPandas().iloc[-1]
    known = lambda n: {c for c in ta.RECURSIVE if get(n)[c] == get(n)[c] and get(n)[c] is not None}
    assert known(20) == {"rsi", "atr"} and known(28) == {"rsi", "atr", "plus_di", "minus_di", "adx"}
    assert known(34) == {"rsi", "atr", "plus_di", "minus_di", "adx", "ema_12", "ema_26"} and known(35) == set(ta.RECURSIVE)
