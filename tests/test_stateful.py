"""Running averages and alerts on a stream, in micro-batches and over restarts, against the same in batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import technical as ta
from tidemark.streaming import stateful as st

QUOTE = "symbol string, event_id long, ts timestamp, close double"


def quotes(n=90, symbols="AB"):
    rng, day = random.Random(6), dt.datetime(2024, 1, 1)
    price = dict.fromkeys(symbols, 100.0)
    rows = []
    for i in range(n):
        for s in symbols:
            price[s] = round(price[s] * (1 + rng.uniform(-0.04, 0.042)), 2)
            rows.append((s, len(rows), day + dt.timedelta(hours=i), price[s]))
    return rows


def stream_of(spark, path, schema, rows, parts):
    """Writes rows as so many files, one a micro-batch, and gives a function that reads those there as a stream."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, at, check):
    q = df.writeStream.format("parquet").option("path", at).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(at)


def test_running_averages_over_restarts(spark, tmp_path):
    rows = quotes()
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    half = len(rows) // 2
    run(st.running(stream_of(spark, src, QUOTE, rows[:half], 3)()), out, check)
    late = [("A", -5, rows[0][2], 1e6)]
    got = run(st.running(stream_of(spark, src, QUOTE, rows[half:] + late + rows[-2:], 2)()), out, check).orderBy("event_id").toPandas()
    assert got["event_id"].tolist() == list(range(len(rows)))  # late and repeated rows change nothing
    bars = spark.createDataFrame(rows, QUOTE).withColumns({"high": F.col("close"), "low": F.col("close")})
    want = ta.exponential(bars, ("ema_12", "ema_26", "rsi")).orderBy("event_id").toPandas()
    for c in ("ema_12", "ema_26", "rsi"):
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, nan_ok=True)


def test_alerts_fire_once(spark, tmp_path):
    rows = quotes()
    rng, alerts = random.Random(1), []
    for i in range(120):
        c = rng.choice(list(st.CONDITIONS))
        t = {"price": rng.uniform(80, 125), "change": rng.uniform(-4.4, 4.4), "rsi": rng.uniform(20, 80)}[c.split("_")[0]]
        alerts.append(("add", i, rng.choice("AB"), c, t, i))
    names = "kind string, alert_id long, symbol string, condition string, threshold double, event_id long"
    src, com, out, check = (str(tmp_path / x) for x in ("in", "com", "out", "check"))
    commands = stream_of(spark, com, names, alerts, 1)
    run(st.alerts_on_stream(stream_of(spark, src, QUOTE, rows[:100], 3)(), commands()), out, check)
    stream_of(spark, com, names, [("add", i, s, c, t, 500 + i) for _, i, s, c, t, _ in alerts[:60]], 1)  # those that have fired stay so
    got = run(st.alerts_on_stream(stream_of(spark, src, QUOTE, rows[100:] + rows[40:60], 2)(), commands()), out, check)
    want = st.alerts_in_batch(spark.createDataFrame(rows, QUOTE), spark.createDataFrame(alerts, names))
    key = lambda r: (r.alert_id, r.symbol, r.condition, r.fired_at, r.price)
    got, want = sorted(map(key, got.collect())), sorted(map(key, want.collect()))
    assert got == want and 40 < len(want) < 120


def test_alert_goldens(spark):
    names = "alert_id long, symbol string, condition string, threshold double"
    alerts = spark.createDataFrame([(1, "F", "price_above", 1000.0), (2, "F", "price_below", 1.0), (3, "F", "rsi_below", 99.0), (4, "F", "change_above", 0.0), (5, "X", "price_above", 0.0)], names)
    q = spark.createDataFrame([("F", 1, dt.datetime(2024, 1, 1), 105_000.0)], QUOTE)
    fired = st.alerts_in_batch(q, alerts).collect()
    assert [(r.alert_id, r.price, r.rsi) for r in fired] == [(1, 105_000.0, None)]  # neither a change nor an RSI to evaluate yet


def test_deleted_alert(spark, tmp_path):
    names = "kind string, alert_id long, symbol string, condition string, threshold double, event_id long"
    com = spark.createDataFrame([("add", 1, "A", "price_above", 1.0, 1), ("add", 2, "A", "price_above", 1.0, 2), ("delete", 1, "A", None, None, 3), ("add", 3, "A", "nonsense", 1.0, 4)], names)
    com.coalesce(1).write.parquet(str(tmp_path / "com"))
    src = stream_of(spark, str(tmp_path / "in"), QUOTE, quotes(4, "A"), 1)
    got = run(st.alerts_on_stream(src(), spark.readStream.schema(names).parquet(str(tmp_path / "com"))), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [r.alert_id for r in got.collect()] == [2]
