"""Symbols that share a bucket: averages and alerts as in batch, over restarts, with a row of state a bucket, not a symbol."""

import random

import pytest
from pyspark.sql import functions as F

from test_stateful import QUOTE, quotes, run, stream_of
from tidemark.operators import technical as ta
from tidemark.streaming import stateful as st

SYMBOLS = [f"s{k}" for k in range(40)]


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(st, "BUCKETS", 3, raising=False)


def test_averages_of_many_symbols(spark, tmp_path):
    rows = [r for r in quotes(40, SYMBOLS) if r[1] >= 8 * len(SYMBOLS) or r[0] != "s7"]  # one comes later than the others
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    run(st.running(stream_of(spark, src, QUOTE, rows[:500], 2)()), out, check)
    stream_of(spark, src, QUOTE, rows[500:] + rows[300:340], 2)
    df = st.running(spark.readStream.schema(QUOTE).option("maxFilesPerTrigger", 1).parquet(src))
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 3
    got = spark.read.parquet(out).orderBy("event_id").toPandas()
    assert got["event_id"].tolist() == sorted(r[1] for r in rows)
    bars = spark.createDataFrame(rows, QUOTE).withColumns({"high": F.col("close"), "low": F.col("close")})
    want = ta.exponential(bars, ("ema_12", "ema_26", "rsi")).orderBy("event_id").toPandas()
    for c in ("ema_12", "ema_26", "rsi"):
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, nan_ok=True)


def test_alerts_of_many_symbols(spark, tmp_path):
    rows, rng, alerts = quotes(30, SYMBOLS), random.Random(2), []
    for i in range(300):
        c = rng.choice(list(st.CONDITIONS))
        t = {"price": rng.uniform(85, 115), "change": rng.uniform(-4.4, 4.4), "rsi": rng.uniform(20, 80)}[c.split("_")[0]]
        alerts.append(("add", i, rng.choice(SYMBOLS), c, t, i))
    names = "kind string, alert_id long, symbol string, condition string, threshold double, event_id long"
    src, com, out, check = (str(tmp_path / x) for x in ("in", "com", "out", "check"))
    commands = stream_of(spark, com, names, alerts, 1)
    run(st.alerts_on_stream(stream_of(spark, src, QUOTE, rows[:700], 2)(), commands()), out, check)
    stream_of(spark, com, names, [("add", i, s, c, t, 500 + i) for _, i, s, c, t, _ in alerts[:150]], 1)  # those that have fired stay so
    got = run(st.alerts_on_stream(stream_of(spark, src, QUOTE, rows[700:], 1)(), commands()), out, check)
    want = st.alerts_in_batch(spark.createDataFrame(rows, QUOTE), spark.createDataFrame(alerts, names))
    key = lambda r: (r.alert_id, r.symbol, r.condition, r.fired_at, r.price)
    got, want = sorted(map(key, got.collect())), sorted(map(key, want.collect()))
    assert got == want and 100 < len(want) < 300
