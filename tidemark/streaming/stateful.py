"""Operators with a state of their own: running averages of a symbol, and alerts that fire once.

The state of a symbol is a few numbers, kept by Spark's state store (RocksDB) and restored from the query's checkpoint; a stream that is
stopped and started again goes on where it was. Rows of a symbol that come behind one already seen are late and change nothing.
A call and the state that it reads and writes cost much more than a row, so symbols are dealt into buckets, which have their symbols' numbers in columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.technical import by_ts, exponential

#: What an alert may ask, by the quote's column.
CONDITIONS = {"price_above": "close", "price_below": "close", "change_above": "change", "change_below": "change", "rsi_above": "rsi", "rsi_below": "rsi"}
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RSI, FAST, SLOW = 14, 12, 26
#: Fixed value: buckets that symbols are dealt into. A stream that goes on from a checkpoint must keep it.
BUCKETS = 4096
RUNNING = "symbol string, event_id long, ts timestamp, close double, change double, ema_12 double, ema_26 double, rsi double"
FIRED = "alert_id long, symbol string, condition string, threshold double, fired_at timestamp, price double, change double, rsi double"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that these operators need."""
    spark.conf.set(*STORE)
    return spark


def averaged(x: np.ndarray, group: np.ndarray, before: np.ndarray, alpha: float) -> np.ndarray:
    """The exponential average up to each x of its group, going on from what it was before the group's first (NaN: from nothing); rows of a group lie together."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    first = first[~np.isnan(before[first])]
    own = np.insert(np.ones(len(x), dtype=bool), first, False)
    whole = pd.DataFrame({"group": np.insert(group, first, group[first]), "x": np.insert(x, first, before[first])})
    return whole.groupby("group", sort=False)["x"].ewm(alpha=alpha, adjust=False).mean().to_numpy()[own]


class Averages:
    """What the symbols of a bucket remember: their last row, the number of moves so far, and the averages."""

    NUMBERS = {"ts": np.int64, "event_id": np.int64, "close": float, "moves": np.int64, "gain": float, "loss": float, "fast": float, "slow": float}
    FIELDS = "symbol array<string>, " + ", ".join(f"{k} array<{'double' if v is float else 'long'}>" for k, v in NUMBERS.items())

    def __init__(self, handle: StatefulProcessorHandle):
        self.state = handle.getValueState("averages", self.FIELDS)

    def advance(self, rows: pd.DataFrame) -> pd.DataFrame:
        """rows (symbol, event_id, ts, close), those that are not late, with change, ema_12, ema_26 and rsi, a symbol's together in order; the state moves on to the last of them."""
        rows = rows.dropna(subset=["close", "ts"]).drop_duplicates(["symbol", "ts", "event_id"])
        if not len(rows):
            return rows.assign(change=0.0, ema_12=0.0, ema_26=0.0, rsi=0.0)
        code, names = pd.factorize(rows["symbol"].to_numpy(dtype=object), use_na_sentinel=False)
        rows = rows.assign(code=code).sort_values(["code", "ts", "event_id"], ignore_index=True)
        held = self.state.get()
        place = {} if held is None else {symbol: i for i, symbol in enumerate(held[0])}
        old = {k: np.array([] if held is None else held[i], dtype) for i, (k, dtype) in enumerate(self.NUMBERS.items(), 1)}
        # each row's place in the state, the one behind all of them for a symbol that is new
        at = np.array([place.get(None if symbol != symbol else symbol, len(place)) for symbol in names])[rows["code"]]
        was = {k: np.append(v, v.dtype.type(0 if k == "moves" else np.nan if v.dtype == float else np.iinfo(v.dtype).min))[at] for k, v in old.items()}
        ts = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        on = (ts > was["ts"]) | ((ts == was["ts"]) & (rows["event_id"].to_numpy() > was["event_id"]))
        rows, ts, at, was = rows[on].reset_index(drop=True), ts[on], at[on], {k: v[on] for k, v in was.items()}
        if not len(rows):
            return rows.drop(columns="code").assign(change=0.0, ema_12=0.0, ema_26=0.0, rsi=0.0)

        code, close = rows["code"].to_numpy(), rows["close"].to_numpy(dtype=float)
        first = np.diff(code, prepend=-1) != 0
        nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        before = np.where(first, was["close"], np.concatenate([[np.nan], close[:-1]]))
        moved = ~first | (at < len(place))  # the very first row of a symbol has no move
        count = was["moves"] + nth + (at < len(place))
        gain, loss = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            move = (close - before)[moved]
            for out, x, k in ((gain, move, "gain"), (loss, -move, "loss")):
                out[moved] = averaged(np.where(x < 0, 0.0, x), code[moved], np.where(was["moves"] > 0, was[k], np.nan)[moved], 1 / RSI)
            rsi = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100 - 100 / (1 + gain / loss))
            change = np.where(before == 0, np.nan, (close / np.where(before == 0, 1, before) - 1) * 100)
        rsi[count < RSI] = np.nan
        fast, slow = averaged(close, code, was["fast"], 2 / (FAST + 1)), averaged(close, code, was["slow"], 2 / (SLOW + 1))

        last = np.append(first[1:], True)
        known = lambda x: np.where(np.isfinite(x), x, 0.0)
        now = {"ts": ts, "event_id": rows["event_id"].to_numpy(), "close": close, "moves": count, "gain": known(gain), "loss": known(loss), "fast": fast, "slow": slow}
        rest = np.ones(len(place), dtype=bool)
        rest[at[at < len(place)]] = False
        symbols = [symbol for symbol, i in place.items() if rest[i]] + [None if names[k] != names[k] else names[k] for k in code[last]]
        self.state.update((symbols, *(np.concatenate([old[k][rest], now[k][last].astype(dtype)]).tolist() for k, dtype in self.NUMBERS.items())))
        return rows.drop(columns="code").assign(change=change, ema_12=fast, ema_26=slow, rsi=rsi)


class Running(StatefulProcessor):
    """Every quote of a bucket's symbols with its running averages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.averages = Averages(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield self.averages.advance(pd.concat(list(rows)))[[f.split()[0] for f in RUNNING.split(", ")]]

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """The alerts of a bucket's symbols: active ones wait in the state, and go from it when a quote fires them or a row deletes them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.averages = Averages(handle)
        self.active = handle.getValueState("active", "symbol array<string>, alert_id array<long>, condition array<string>, threshold array<double>")
        self.done = handle.getListState("done", "symbol array<string>, alert_id array<long>, ts array<long>, price array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        held = self.active.get()
        active = {} if held is None else {(symbol, alert): asked for symbol, alert, *asked in zip(*held)}
        commands = rows.loc[rows["kind"] != "quote", ["event_id", "kind", "symbol", "alert_id", "condition", "threshold"]].sort_values("event_id")
        if len(commands):
            done = {of for some in self.done.get() for of in zip(some[0], some[1])}
            for _, kind, symbol, alert, condition, threshold in commands.itertuples(index=False):
                of = (symbol, int(alert))
                if kind == "delete":
                    active.pop(of, None)
                elif kind == "add" and condition in CONDITIONS and threshold == threshold and of not in done:
                    active[of] = [condition, float(threshold)]
        quotes = self.averages.advance(rows.loc[rows["kind"] == "quote", ["symbol", "event_id", "ts", "close"]])
        fired = self.fired(active, quotes) if active and len(quotes) else None
        if fired is not None:
            for of in zip(fired["symbol"], fired["alert_id"]):
                del active[of]
            times = fired["fired_at"].to_numpy().astype("datetime64[us]").astype(np.int64)
            self.done.appendValue((fired["symbol"].tolist(), fired["alert_id"].tolist(), times.tolist(), fired["price"].tolist()))
        if fired is not None or len(commands):
            self.active.update(([s for s, _ in active], [a for _, a in active], [c for c, _ in active.values()], [t for _, t in active.values()]))
        if fired is not None:
            yield fired

    def fired(self, active: dict[tuple, list], quotes: pd.DataFrame) -> pd.DataFrame | None:
        """The active alerts that a quote fires, each with its first one."""
        waiting: dict[Any, dict[str, list]] = {}
        for (symbol, alert), (condition, threshold) in active.items():
            waiting.setdefault(symbol, {}).setdefault(condition, []).append((alert, threshold))
        symbols = quotes["symbol"].tolist()
        edges = [0, *(i for i in range(1, len(symbols)) if symbols[i] != symbols[i - 1]), len(symbols)]
        measures = {c: quotes[c].to_numpy(dtype=float) for c in ("close", "change", "rsi")}
        parts = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            for condition, asked in waiting.get(symbols[lo], {}).items():
                # the furthest that the measure has got up to each quote: an alert's first quote is found by binary search
                sign = 1 if condition.endswith("above") else -1
                v = sign * measures[CONDITIONS[condition]][lo:hi]
                reach = np.maximum.accumulate(np.where(np.isnan(v), -np.inf, v))
                alerts, thresholds = (np.array(x) for x in zip(*asked))
                at = np.searchsorted(reach, sign * thresholds, "left")
                hit = at < hi - lo
                if hit.any():
                    parts.append(pd.DataFrame({"alert_id": alerts[hit], "condition": condition, "threshold": thresholds[hit], "at": lo + at[hit]}))
        if not parts:
            return None
        hits = pd.concat(parts, ignore_index=True)
        first = quotes.iloc[hits["at"]].reset_index(drop=True).rename(columns={"ts": "fired_at", "close": "price"})
        return pd.concat([hits.drop(columns="at"), first], axis=1)[[f.split()[0] for f in FIRED.split(", ")]]

    def close(self) -> None:
        pass


def bucketed(rows: DataFrame):
    """Rows by the bucket of their symbol."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int")).groupBy("bucket")


def running(quotes: DataFrame) -> DataFrame:
    """A stream of quotes (symbol, event_id, ts, close) with change against the quote before, in percent, EMA 12 and 26, and RSI 14 from the fourteenth move on."""
    with_state_store(quotes.sparkSession)
    cols = quotes.select("symbol", "event_id", F.col("ts").cast("timestamp").alias("ts"), "close")
    return bucketed(cols).transformWithStateInPandas(Running(), RUNNING, "Append", "None")


def alerts_on_stream(quotes: DataFrame, commands: DataFrame) -> DataFrame:
    """Alerts as they fire. commands is a stream too, of (kind, alert_id, symbol, condition, threshold, event_id).

    kind is add or delete. An alert that has fired is not active again, whatever is added under its id. What a quote does not tell (no change before
    the second, no RSI before the fourteenth move) is not evaluated. Commands count for all quotes of their micro-batch, in the order of their event_id.
    """
    with_state_store(quotes.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    a = quotes.select("symbol", "event_id", F.lit("quote").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "close", none("long").alias("alert_id"), none("string").alias("condition"), none("double").alias("threshold"))
    b = commands.select("symbol", "event_id", "kind", none("timestamp").alias("ts"), none("double").alias("close"), "alert_id", "condition", "threshold")
    return bucketed(a.unionByName(b)).transformWithStateInPandas(Alerts(), FIRED, "Append", "None")


def alerts_in_batch(quotes: DataFrame, alerts: DataFrame) -> DataFrame:
    """The same alerts as alerts_on_stream() over all quotes at once: each with the first quote that fires it.

    Only quotes that go beyond all before them in one of the measures can be a first one; alerts meet those alone.
    """
    bars = quotes.select("symbol", "event_id", F.col("ts").cast("timestamp").alias("ts"), "close")
    bars = exponential(bars.withColumns({"high": F.col("close"), "low": F.col("close")}), ("rsi",)).drop("high", "low")
    before = F.lag("close").over(by_ts())
    bars = bars.withColumn("change", (F.try_divide(F.col("close"), before) - 1) * 100)
    w = by_ts().rowsBetween(Window.unboundedPreceding, -1)
    ways = []
    for condition, c in CONDITIONS.items():
        v = F.when(~F.isnan(c), F.col(c))
        further = v > F.max(v).over(w) if condition.endswith("above") else v < F.min(v).over(w)
        ways.append(F.when(v.isNotNull() & F.coalesce(further, F.lit(True)), F.struct(F.lit(condition).alias("condition"), v.alias("measure"))))
    records = bars.withColumn("ways", F.array_compact(F.array(*ways))).select("*", F.explode("ways").alias("r")).select("*", "r.condition", "r.measure")
    hit = F.when(F.col("condition").endswith("above"), F.col("measure") >= F.col("threshold")).otherwise(F.col("measure") <= F.col("threshold"))
    met = records.join(alerts.select("alert_id", "symbol", "condition", "threshold"), ["symbol", "condition"]).where(hit)
    first = met.groupBy("alert_id", "symbol", "condition", "threshold").agg(F.min(F.struct("ts", "event_id", "close", "change", F.when(~F.isnan("rsi"), F.col("rsi")).alias("rsi"))).alias("q"))
    return first.select("alert_id", "symbol", "condition", "threshold", F.col("q.ts").alias("fired_at"), F.col("q.close").alias("price"), F.col("q.change").alias("change"), F.col("q.rsi").alias("rsi"))
