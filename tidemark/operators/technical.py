"""Technical indicators over all symbols at once. Bars have symbol, ts, open, high, low, close and volume."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.store import kept


def by_ts():
    return Window.partitionBy("symbol").orderBy("ts")


def by_symbol():
    return Window.partitionBy("symbol")


def last(n: int):
    return by_ts().rowsBetween(-(n - 1), 0)


def full(value: Column, of: str, n: int) -> Column:
    """value where the last n rows all have `of`, else null."""
    return F.when(F.count(of).over(last(n)) == n, value)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def sma(bars: DataFrame, periods=(10, 20, 50, 100, 200), least: int = 30) -> DataFrame:
    """sma_<p>: null until p observations, and for symbols shorter than `least` bars."""
    enough = F.count("*").over(by_symbol()) >= least
    return bars.withColumns({f"sma_{p}": F.when(enough, full(F.avg("close").over(last(p)), "close", p)) for p in periods})


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    m, s = F.avg("close").over(last(n)), F.stddev_samp("close").over(last(n))
    out = bars.withColumns({"bb_middle": full(m, "close", n), "bb_upper": full(m + k * s, "close", n), "bb_lower": full(m - k * s, "close", n)})
    return out.withColumn("bb_width", ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle")))


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index; null where there is no negative flow, and before n comparisons."""
    b = bars.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumns({"prev_tp": F.lag("tp").over(by_ts()), "flow": F.col("tp") * F.col("volume")})
    b = b.withColumns({"up": F.when(F.col("tp") > F.col("prev_tp"), F.col("flow")).otherwise(0.0), "down": F.when(F.col("tp") < F.col("prev_tp"), F.col("flow")).otherwise(0.0)})
    up, down = F.sum("up").over(last(n)), F.sum("down").over(last(n))
    return b.withColumn("mfi", full(100 - 100 / (1 + ratio(up, down)), "tp", n)).drop("tp", "prev_tp", "flow", "up", "down")


def obv(bars: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_ts())) * F.col("volume"), F.lit(0.0))
    return bars.withColumn("step", step).withColumn("obv", F.sum("step").over(by_ts().rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def cmf(bars: DataFrame, n: int = 20) -> DataFrame:
    span = F.col("high") - F.col("low")
    m = F.when(span == 0, 0.0).otherwise(ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), span)) * F.col("volume")
    b = bars.withColumn("mfv", m)
    return b.withColumn("cmf", full(ratio(F.sum("mfv").over(last(n)), F.sum("volume").over(last(n))), "close", n)).drop("mfv")


def roc(bars: DataFrame, n: int = 10) -> DataFrame:
    return bars.withColumn("roc", ratio(F.col("close") - F.lag("close", n).over(by_ts()), F.lag("close", n).over(by_ts())) * 100)


def relative_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume over the mean of the last n bars, this one included."""
    return bars.withColumn("rel_volume", full(ratio(F.col("volume"), F.avg("volume").over(last(n))), "volume", n))


#: The recursive indicators, and the bars that a symbol needs to have any of them.
RECURSIVE = ("ema_12", "ema_26", "rsi", "macd", "macd_signal", "macd_hist", "atr", "plus_di", "minus_di", "adx")
NEEDED = {"ema_12": 30, "ema_26": 30, "rsi": 15, "macd": 35, "macd_signal": 35, "macd_hist": 35, "atr": 14, "plus_di": 28, "minus_di": 28, "adx": 28}


def exponential(bars: DataFrame, names: tuple[str, ...] = RECURSIVE) -> DataFrame:
    """Recursive indicators in one grouped pass, those named: EMA 12/26, RSI 14, MACD 12/26/9, ATR 14, ADX 14; null for symbols that are too short (NEEDED).

    A symbol's history is one group; of daily bars it is bounded by the calendar (a few hundred bars a year). For ticks, or where few symbols
    have long histories, exponential_by_chunk() gives the same over many tasks a symbol.
    """
    wants = set(names)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", ignore_index=True)
        c, h, low = g["close"], g["high"], g["low"]
        span = lambda s, n: s.ewm(span=n, adjust=False).mean()
        wilder = lambda s, n=14: s.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
        out = {}
        if wants & {"ema_12", "ema_26", "macd", "macd_signal", "macd_hist"}:
            out["ema_12"], out["ema_26"] = span(c, 12), span(c, 26)
            out["macd"] = out["ema_12"] - out["ema_26"]
            out["macd_signal"] = span(out["macd"], 9)
            out["macd_hist"] = out["macd"] - out["macd_signal"]
        if "rsi" in wants:
            move = c.diff()
            gain, loss = wilder(move.clip(lower=0)), wilder(-move.clip(upper=0))
            rsi = 100 - 100 / (1 + gain / loss.where(loss != 0))
            out["rsi"] = rsi.mask((loss == 0) & (gain > 0), 100.0).mask((loss == 0) & (gain == 0), 50.0)
        if wants & {"atr", "plus_di", "minus_di", "adx"}:
            before = c.shift()
            true_range = pd.concat([h - low, (h - before).abs(), (low - before).abs()], axis=1).max(axis=1)
            out["atr"] = wilder(true_range)
            atr = out["atr"].where(out["atr"] != 0)
        if wants & {"plus_di", "minus_di", "adx"}:
            up, down = h.diff(), -low.diff()
            plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
            out["plus_di"], out["minus_di"] = 100 * wilder(plus) / atr, 100 * wilder(minus) / atr
            total = out["plus_di"] + out["minus_di"]
            out["adx"] = wilder(100 * (out["plus_di"] - out["minus_di"]).abs() / total.where(total != 0))
        return g.assign(**{n: out[n] if len(g) >= NEEDED[n] else None for n in names})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema)
    return bars.groupBy("symbol").applyInPandas(one, fields + "".join(f", {n} double" for n in names))


def _in_chunk():
    return Window.partitionBy("symbol", "_chunk").orderBy("ts")


def _by_chunk():
    return Window.partitionBy("symbol").orderBy("_chunk")


def smoothed(df: DataFrame, series: dict[str, tuple[str, float, int]]) -> DataFrame:
    """df with an exponential average a name: series has (column, weight of the newest value, least number of values).

    df has symbol, ts and _chunk, which rises with ts. A row takes the average before it to c * average + d; such maps compose to maps of the
    same form. Within a chunk they compose by a running sum; a chunk is one map, two numbers an average, and only
    these are gathered by symbol, to be applied in order. So no task holds more bars than those of a chunk at a time. A gap of k nulls lets the average before it count as
    often decayed as rows went by; the first value starts the average.
    """
    c, w = F.col, _in_chunk()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumn("_rn", F.row_number().over(w))
    # what came before each chunk: its rows, and of each column the values and the place of the last one
    columns = sorted({x for x, _, _ in series.values()})
    ends = d.groupBy("symbol", "_chunk").agg(F.count("*").alias("_rows"), *[F.count(x).alias(f"_n_{x}") for x in columns], *[F.max(F.when(c(x).isNotNull(), c("_rn"))).alias(f"_at_{x}") for x in columns])
    past = _by_chunk().rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_base", F.coalesce(F.sum("_rows").over(past), F.lit(0)))
    ends = ends.select("symbol", "_chunk", "_base", *[F.coalesce(F.sum(f"_n_{x}").over(past), F.lit(0)).alias(f"_n_{x}") for x in columns], *[F.last(c("_base") + c(f"_at_{x}"), ignorenulls=True).over(past).alias(f"_at_{x}") for x in columns])
    d = d.join(ends, ["symbol", "_chunk"]).withColumn("_place", c("_base") + c("_rn"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_last_{x}": F.coalesce(F.last(F.when(c(x).isNotNull(), c("_place")), ignorenulls=True).over(before), c(f"_at_{x}")) for x in columns})
    d = d.withColumns({f"_seen_{x}": c(f"_n_{x}") + F.count(x).over(upto) for x in columns})
    maps = {}
    for name, (x, weight, _) in series.items():
        decayed = F.pow(F.lit(1 - weight), c("_place") - c(f"_last_{x}"))
        maps[f"_c_{name}"] = F.when(c(x).isNotNull() & c(f"_last_{x}").isNotNull(), decayed / (decayed + weight)).otherwise(1.0)
        maps[f"_d_{name}"] = F.when(c(x).isNull(), 0.0).when(c(f"_last_{x}").isNull(), c(x)).otherwise(weight * c(x) / (decayed + weight))
    d = d.withColumns(maps)
    d = d.withColumns({f"_p_{n}": F.exp(F.sum(F.ln(f"_c_{n}")).over(upto)) for n in series})
    d = d.withColumns({f"_y_{n}": c(f"_p_{n}") * F.sum(c(f"_d_{n}") / c(f"_p_{n}")).over(upto) for n in series})
    columns = [x for x in df.columns if x not in ("symbol", "_chunk")]
    d = kept(d.select("symbol", "_chunk", *columns, *[f"_{k}_{n}" for n in series for k in "py"], *[f"_seen_{x}" for x in {x for x, _, _ in series.values()}]), "smoothed")
    # the maps of whole chunks, applied one after the other: what each chunk starts from
    tail = F.max_by(F.struct(*[c(f"_{k}_{n}") for n in series for k in "py"]), "ts").alias("_tail")
    tails = d.groupBy("symbol", "_chunk").agg(tail).select("symbol", "_chunk", "_tail.*")
    names = list(series)

    def join_chunks(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_chunk", ignore_index=True)
        p, y = (g[[f"_{k}_{n}" for n in names]].to_numpy(dtype=float) for k in "py")
        into = np.zeros_like(y)
        for k in range(1, len(g)):
            into[k] = p[k - 1] * into[k - 1] + y[k - 1]
        return pd.concat([g[["symbol", "_chunk"]], pd.DataFrame(into, columns=[f"_in_{n}" for n in names])], axis=1)

    kinds = dict(tails.dtypes)
    tails = tails.groupBy("symbol").applyInPandas(join_chunks, f"symbol {kinds['symbol']}, _chunk {kinds['_chunk']}, " + ", ".join(f"_in_{n} double" for n in names))
    d = d.join(tails, ["symbol", "_chunk"])
    return d.select(*df.columns, *[F.when(c(f"_seen_{x}") >= F.greatest(F.lit(least), F.lit(1)), c(f"_p_{n}") * c(f"_in_{n}") + c(f"_y_{n}")).alias(n) for n, (x, _, least) in series.items()])


def exponential_by_chunk(bars: DataFrame, names: tuple[str, ...] = RECURSIVE, chunk: Column | None = None) -> DataFrame:
    """exponential() for histories of any length: a symbol's bars are dealt to tasks by `chunk`, which rises with ts (a quarter, if not given).

    A chunk should have some dozens to some hundreds of bars. Bars have no null close, high or low.
    The bars, and the averages of each level (those of prices, and those of averages), are written once to the shared folder.
    """
    wants, c = set(names), F.col
    d = kept(bars.withColumn("_chunk", F.date_trunc("quarter", "ts") if chunk is None else chunk), "bars")
    ends = d.groupBy("symbol", "_chunk").agg(F.max_by(F.struct("close", "high", "low"), "ts").alias("_end"), F.count("*").alias("_rows"))
    ends = ends.select("symbol", "_chunk", F.lag("_end").over(_by_chunk()).alias("_end"), F.sum("_rows").over(Window.partitionBy("symbol")).alias("_bars"))
    d = d.join(ends, ["symbol", "_chunk"])
    before = {x: F.coalesce(F.lag(x).over(_in_chunk()), c(f"_end.{x}")) for x in ("close", "high", "low")}
    d = d.withColumns({f"_b_{x}": v for x, v in before.items()}).drop("_end")
    series, averages = {}, wants & {"ema_12", "ema_26", "macd", "macd_signal", "macd_hist"}
    if averages:
        series |= {"_fast": ("close", 2 / 13, 1), "_slow": ("close", 2 / 27, 1)}
    if "rsi" in wants:
        move = c("close") - c("_b_close")
        d = d.withColumns({"_up": F.greatest(move, F.lit(0.0)), "_down": F.greatest(-move, F.lit(0.0))}).withColumns({x: F.when(c("_b_close").isNotNull(), c(x)) for x in ("_up", "_down")})
        series |= {"_gain": ("_up", 1 / 14, 14), "_loss": ("_down", 1 / 14, 14)}
    directed = wants & {"plus_di", "minus_di", "adx"}
    if directed or "atr" in wants:
        d = d.withColumn("_range", F.greatest(c("high") - c("low"), F.abs(c("high") - c("_b_close")), F.abs(c("low") - c("_b_close"))))
        series["_atr"] = ("_range", 1 / 14, 14)
    if directed:
        up, down = c("high") - c("_b_high"), c("_b_low") - c("low")
        d = d.withColumns({"_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0)})
        series |= {"_pdm": ("_plus", 1 / 14, 14), "_mdm": ("_minus", 1 / 14, 14)}
    d, second = smoothed(d, series), {}
    if averages:
        d = d.withColumn("_macd", c("_fast") - c("_slow"))
        if wants & {"macd_signal", "macd_hist"}:
            second["_signal"] = ("_macd", 0.2, 1)
    if directed:
        d = d.withColumns({"_pdi": 100 * ratio(c("_pdm"), c("_atr")), "_mdi": 100 * ratio(c("_mdm"), c("_atr"))})
        if "adx" in wants:
            d = d.withColumn("_dx", 100 * ratio(F.abs(c("_pdi") - c("_mdi")), c("_pdi") + c("_mdi")))
            second["_adx"] = ("_dx", 1 / 14, 14)
    d = smoothed(d, second) if second else d
    made = {
        "ema_12": lambda: c("_fast"), "ema_26": lambda: c("_slow"), "macd": lambda: c("_macd"), "macd_signal": lambda: c("_signal"), "macd_hist": lambda: c("_macd") - c("_signal"), "atr": lambda: c("_atr"),
        "rsi": lambda: F.when(c("_loss") == 0, F.when(c("_gain") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + ratio(c("_gain"), c("_loss")))), "plus_di": lambda: c("_pdi"), "minus_di": lambda: c("_mdi"), "adx": lambda: c("_adx"),
    }
    return d.select(*bars.columns, *[F.when(c("_bars") >= NEEDED[n], made[n]()).alias(n) for n in names])


def trend(bars: DataFrame) -> DataFrame:
    """Score of the last bar against its averages, place within the last 20 closes, and a label."""
    b = sma(bars, (20, 50, 200)).withColumns({"hi20": F.max("close").over(last(20)), "lo20": F.min("close").over(last(20)), "rn": F.row_number().over(by_symbol().orderBy(F.desc("ts")))})
    b = b.where("rn = 1")
    sign = lambda a, c, p: F.when(F.col(c).isNull() | F.col(a).isNull(), 0).when(F.col(a) > F.col(c), p).otherwise(-p)
    score = sign("close", "sma_20", 1) + sign("close", "sma_50", 2) + sign("close", "sma_200", 3) + sign("sma_20", "sma_50", 1)
    label = F.when(F.col("score") >= 3, "strong_up").when(F.col("score") > 0, "up").when(F.col("score") == 0, "flat").when(F.col("score") > -3, "down").otherwise("strong_down")
    pct = lambda c: ratio(F.col("close") - F.col(c), F.col(c)) * 100
    return b.withColumn("score", score).select("symbol", "score", label.alias("label"), pct("hi20").alias("from_high"), pct("lo20").alias("from_low"))


def support_resistance(bars: DataFrame, window: int = 120) -> DataFrame:
    """The two nearest pivots below and above the last close, over the last 120 bars; pivots are extremes of 11 centred bars."""
    b = bars.withColumn("rn", F.row_number().over(by_symbol().orderBy(F.desc("ts")))).where(F.col("rn") <= window)
    mid = by_ts().rowsBetween(-5, 5)
    whole = F.count("*").over(mid) == 11
    b = b.withColumns({"top": F.when(whole & (F.col("high") == F.max("high").over(mid)), F.col("high")), "bottom": F.when(whole & (F.col("low") == F.min("low").over(mid)), F.col("low"))})
    g = b.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "ts").alias("now"), F.sort_array(F.collect_set("top")).alias("tops"), F.sort_array(F.collect_set("bottom")).alias("bottoms"))
    above, below = F.filter("tops", lambda x: x > F.col("now")), F.reverse(F.filter("bottoms", lambda x: x < F.col("now")))
    r = F.when(F.size(above) > 0, above).otherwise(F.reverse("tops"))
    s = F.when(F.size(below) > 0, below).otherwise(F.col("bottoms"))
    at = lambda a, i: F.when(F.col("n") >= 20, F.get(a, F.lit(i)))
    return g.select("symbol", at(s, 0).alias("support_1"), at(s, 1).alias("support_2"), at(r, 0).alias("resistance_1"), at(r, 1).alias("resistance_2"))


def all_indicators(bars: DataFrame) -> DataFrame:
    """Every indicator of a bar, with what the signals and the score look back at."""
    b = exponential(relative_volume(roc(cmf(obv(mfi(bollinger(sma(bars))))))))
    return b.withColumns({"prev_hist": F.lag("macd_hist").over(by_ts()), "obv_sma": full(F.avg("obv").over(last(20)), "obv", 20), "obv_5": F.lag("obv", 5).over(by_ts())})


def signals(ind: DataFrame) -> DataFrame:
    """Words for each bar's indicators (see all_indicators); null where an indicator is."""
    c = F.col
    rsi = F.when(c("rsi") >= 70, "overbought").when(c("rsi") <= 30, "oversold").when(c("rsi") > 50, "positive").when(c("rsi").isNotNull(), "negative")
    now, before = c("macd_hist"), F.coalesce("prev_hist", F.lit(0.0))
    macd = F.when(now.isNull(), None).when((now > 0) & (before <= 0), "cross up").when((now < 0) & (before >= 0), "cross down").when(now > before, "rising").otherwise("falling")
    band = F.when(c("bb_upper").isNull(), None).when(c("close") > c("bb_upper"), "above band").when(c("close") < c("bb_lower"), "below band").when(c("close") > c("bb_middle"), "upper half").otherwise("lower half")
    volume = F.when(c("rel_volume") > 2, "spike").when(c("rel_volume") > 1.5, "high").when(c("rel_volume") < 0.5, "low").when(c("rel_volume").isNotNull(), "normal")
    strength = F.when(c("adx") >= 25, "strong").when(c("adx") >= 20, "moderate").otherwise("weak")
    adx = F.when(c("adx").isNotNull(), F.concat(F.when(c("plus_di") > c("minus_di"), "up ").otherwise("down "), strength))
    position = F.bround((c("close") - c("bb_lower")) / F.greatest(c("bb_upper") - c("bb_lower"), F.lit(1.0)) * 100, 1)
    return ind.select("symbol", "ts", rsi.alias("rsi_signal"), macd.alias("macd_signal"), band.alias("band_signal"), position.alias("band_position"), volume.alias("volume_signal"), adx.alias("adx_signal"), F.when(c("cmf") > 0, "inflow").when(c("cmf").isNotNull(), "outflow").alias("flow_signal"))
