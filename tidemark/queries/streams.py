"""The event-time operators over the events table, in batch, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.bars import table
from tidemark.streaming import jobs
from tidemark.streaming.stateful import CONDITIONS, alerts_in_batch, alerts_on_stream, running


def events(s, d):
    return table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value", "user_id")


def quotes(e):
    """A quote of a user for each event."""
    return e.select(F.col("user_id").cast("string").alias("symbol"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"))


def alerts(customers):
    """An alert for each customer, of one of the six conditions by its key, on the user of the same number, or of its last two digits."""
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in CONDITIONS])
    condition = F.element_at(kinds, (k % len(CONDITIONS) + 1).cast("int"))
    return customers.select(k.alias("alert_id"), F.when(k % 2 == 0, k).otherwise(k % 100).cast("string").alias("symbol"), condition.alias("condition"), F.expr(THRESHOLD.format(k="c_custkey", d="D")).alias("threshold"))


THRESHOLD = "case {k} % 6 when 0 then 40.0{d} + 3 * ({k} % 60) when 1 then 3.0{d} - ({k} % 30) / 10.0{d} when 2 then 500.0{d} + 40 * ({k} % 50) when 3 then -50.0{d} - {k} % 48 when 4 then 55.0{d} + {k} % 35 else 45.0{d} - {k} % 35 end"
KINDS = ("click", "view", "purchase")
NTZ = "timestamp_ntz"


def shown(fired):
    return fired.select("alert_id", F.col("fired_at").cast(NTZ).alias("fired_at"), *[F.round(F.nanvl(c, F.lit(None)), 4).alias(c) for c in ("price", "change", "rsi")])


QUERIES = {
    "SS_02_sliding_snapshots": lambda s, d: jobs.sliding_snapshots(events(s, d)).select("symbol", F.col("start").cast(NTZ).alias("start"), "high", "low", F.round("total", 4).alias("total"), "n"),
    "SS_03_sessions": lambda s, d: jobs.sessions(events(s, d).withColumn("symbol", F.col("user_id"))).select("symbol", F.col("start").cast(NTZ).alias("start"), "n", F.round("total", 4).alias("total")),
    "SS_04_alerts": lambda s, d: shown(alerts_in_batch(quotes(events(s, d)), alerts(table(s, d, "customer")))),
    "SS_04_alerts_on_stream": lambda s, d: shown(jobs.drained(alerts_on_stream(quotes(jobs.stream_of(s, d, "events")), alerts(jobs.stream_of(s, d, "customer")).withColumns({"kind": F.lit("add"), "event_id": F.col("alert_id")})), "alerts")),
    "SS_08_running_averages": lambda s, d: jobs.drained(running(quotes(jobs.stream_of(s, d, "events"))), "running").select("symbol", "event_id", *[F.round(F.nanvl(c, F.lit(None)), 4).alias(c) for c in ("change", "ema_12", "ema_26", "rsi")]),
    "SS_05_first_by_id": lambda s, d: jobs.first_by_id(events(s, d), "user_id").select("user_id", "event_id", F.col("ts").cast(NTZ).alias("ts")),
    "SS_06_no_future": lambda s, d: jobs.split_future(events(s, d), F.lit("2024-01-20 00:00:00").cast("timestamp"))[0].groupBy("symbol").agg(F.count("*").alias("n")),
}
RUNNING_SQL = """WITH RECURSIVE q AS (SELECT user_id::VARCHAR AS symbol, event_id, ts, value AS close, lag(value) OVER w AS before, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT symbol, event_id, ts, rn, close, before, close AS ema_12, close AS ema_26, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM q WHERE rn = 1
 UNION ALL SELECT q.symbol, q.event_id, q.ts, q.rn, q.close, q.before, e.ema_12*11.0::DOUBLE/13+q.close*2.0::DOUBLE/13, e.ema_26*25.0::DOUBLE/27+q.close*2.0::DOUBLE/27,
 CASE WHEN q.rn = 2 THEN greatest(q.close-q.before,0) ELSE e.g*13.0::DOUBLE/14+greatest(q.close-q.before,0)/14 END, CASE WHEN q.rn = 2 THEN greatest(q.before-q.close,0) ELSE e.l*13.0::DOUBLE/14+greatest(q.before-q.close,0)/14 END
 FROM e JOIN q ON q.symbol=e.symbol AND q.rn=e.rn+1),
r AS (SELECT symbol, event_id, ts, close, (close/nullif(before,0)-1)*100 AS change, ema_12, ema_26, CASE WHEN rn<15 THEN NULL WHEN l=0 AND g>0 THEN 100.0::DOUBLE WHEN l=0 THEN 50.0::DOUBLE ELSE 100-100/(1+g/l) END AS rsi FROM e)"""
ALERTS_SQL = f"""{RUNNING_SQL}, a AS (SELECT c_custkey AS alert_id, (CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey % 100 END)::VARCHAR AS symbol, {list(CONDITIONS)}[c_custkey % 6 + 1] AS condition, {THRESHOLD.format(k="c_custkey", d="::DOUBLE")} AS threshold FROM customer),
h AS (SELECT *, CASE split_part(condition, '_', 1) WHEN 'price' THEN close WHEN 'change' THEN change ELSE rsi END AS m FROM a JOIN r USING (symbol))
SELECT alert_id, ts AS fired_at, round(close, 4) AS price, round(change, 4) AS change, round(rsi, 4) AS rsi FROM h WHERE CASE WHEN condition LIKE '%above' THEN m >= threshold ELSE m <= threshold END QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY ts, event_id) = 1"""
ORACLE = {
    "SS_02_sliding_snapshots": "WITH e AS (SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS day, value FROM events), x AS (SELECT symbol, day - n * INTERVAL 1 DAY AS start, value FROM e, (SELECT unnest(range(20)) AS n)) SELECT symbol, start, max(value) AS high, min(value) AS low, round(sum(value), 4) AS total, count(*) AS n FROM x GROUP BY ALL",
    "SS_03_sessions": "WITH a AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id AS symbol, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY user_id, g",
    "SS_04_alerts": ALERTS_SQL,
    "SS_04_alerts_on_stream": ALERTS_SQL,
    "SS_08_running_averages": f"{RUNNING_SQL} SELECT symbol, event_id, round(change, 4) AS change, round(ema_12, 4) AS ema_12, round(ema_26, 4) AS ema_26, round(rsi, 4) AS rsi FROM r",
    "SS_05_first_by_id": "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "SS_06_no_future": "SELECT event_type AS symbol, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY ALL",
}
