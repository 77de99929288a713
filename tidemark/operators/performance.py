"""Returns, risk, breadth and ranks over all symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.technical import by_symbol, by_ts, last, ratio
from tidemark.plans.store import kept


def latest(df: DataFrame) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(by_symbol().orderBy(F.desc("ts")))).where("rn = 1").drop("rn")


def bar_returns(bars: DataFrame, steps: dict[str, int]) -> DataFrame:
    """Percentage returns over numbers of bars, at the last bar."""
    b = bars.where("close is not null").withColumns({k: (ratio(F.col("close"), F.lag("close", n).over(by_ts())) - 1) * 100 for k, n in steps.items()})
    return latest(b).select("symbol", *steps)


def calendar_returns(bars: DataFrame) -> DataFrame:
    """Percentage returns since the last close at or before 7, 30, 91, 182, 365 days ago and the end of last year; the year's only with 360 days of history."""
    b = bars.withColumn("end", F.max("ts").over(by_symbol()))
    anchors = {"ret_7d": 7, "ret_30d": 30, "ret_91d": 91, "ret_182d": 182, "ret_365d": 365}
    since = {k: F.col("end") - F.make_dt_interval(F.lit(n)) for k, n in anchors.items()} | {"ret_ytd": F.to_timestamp_ntz(F.make_date(F.year("end") - 1, F.lit(12), F.lit(31)))}
    aggs = [F.max_by("close", F.when(F.col("ts") <= a, F.col("ts"))).alias(k) for k, a in since.items()]
    g = b.groupBy("symbol").agg(F.max_by("close", "ts").alias("now"), F.min("ts").alias("start"), F.max("ts").alias("end"), *aggs)
    change = lambda k: (ratio(F.col("now"), F.col(k)) - 1) * 100
    year = F.when(F.datediff("end", "start") >= 360, change("ret_365d"))
    return g.select("symbol", *[(year if k == "ret_365d" else change(k)).alias(k) for k in since])


def risk(bars: DataFrame) -> DataFrame:
    """Deviation of the last 30 daily returns (five at least) and the largest drawdown."""
    b = bars.withColumns({"ret": ratio(F.col("close"), F.lag("close").over(by_ts())) - 1, "peak": F.max("close").over(by_ts().rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(by_symbol().orderBy(F.desc("ts")))})
    late = F.when(F.col("rn") <= 30, F.col("ret"))
    return b.groupBy("symbol").agg(F.when(F.count(late) >= 5, F.stddev_samp(late)).alias("volatility"), F.min(ratio(F.col("close") - F.col("peak"), F.col("peak"))).alias("max_drawdown"))


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", ratio(F.col("close"), F.lag("close").over(by_ts())) - 1)


def beta(bars: DataFrame, index: DataFrame) -> DataFrame:
    """Slope of daily returns on the index's, taken before the join on ts; at least 60 pairs."""
    both = with_returns(bars).select("symbol", "ts", "ret").join(with_returns(index).select("ts", F.col("ret").alias("market")), "ts").where("ret is not null and market is not null")
    return both.groupBy("symbol").agg(F.when((F.count("*") >= 60) & (F.var_samp("market") != 0), F.regr_slope("ret", "market")).alias("beta"), F.count("*").alias("n"))


def relative_strength(bars: DataFrame, index: DataFrame, n: int = 60) -> DataFrame:
    """Return over the last n sessions common with the index, the index's, and their difference."""
    both = bars.select("symbol", "ts", "close").join(index.select("ts", F.col("close").alias("market")), "ts")
    both = both.withColumn("rn", F.row_number().over(by_symbol().orderBy(F.desc("ts")))).where(F.col("rn") <= n)
    change = lambda c: (F.max_by(c, "ts") / F.min_by(c, "ts") - 1) * 100
    g = both.groupBy("symbol").agg(change("close").alias("ret"), change("market").alias("index_ret"))
    return g.withColumns({"difference": F.col("ret") - F.col("index_ret"), "outperforms": F.col("ret") > F.col("index_ret")})


def rebased(bars: DataFrame, n: int = 126) -> DataFrame:
    """Closes of the last n bars with the first of them as 100."""
    b = bars.withColumn("rn", F.row_number().over(by_symbol().orderBy(F.desc("ts")))).where(F.col("rn") <= n)
    return b.select("symbol", "ts", (F.col("close") / F.first("close").over(by_ts()) * 100).alias("rebased"))


def snapshot(bars: DataFrame) -> DataFrame:
    """Last bar of each symbol with changes, average, and 20-bar highs and lows that leave the bar itself out; symbols over three days behind are left out."""
    before = by_ts().rowsBetween(-20, -1)
    b = bars.withColumns(
        {
            "change": (ratio(F.col("close"), F.lag("close").over(by_ts())) - 1) * 100, "ret_5": (ratio(F.col("close"), F.lag("close", 5).over(by_ts())) - 1) * 100,
            "ret_20": (ratio(F.col("close"), F.lag("close", 20).over(by_ts())) - 1) * 100, "above_ma20": F.when(F.count("close").over(last(20)) == 20, F.col("close") > F.avg("close").over(last(20))),
            "new_high": F.when(F.count("close").over(before) == 20, F.col("close") > F.max("close").over(before)), "new_low": F.when(F.count("close").over(before) == 20, F.col("close") < F.min("close").over(before)),
            "value": F.col("close") * F.col("volume"),
        }
    )
    one = latest(b)
    newest = bars.agg(F.max("ts").alias("_newest"))  # one row
    return one.join(F.broadcast(newest), F.col("ts") >= F.col("_newest") - F.make_dt_interval(F.lit(3))).drop("_newest")


def breadth(snap: DataFrame, flat: float = 0.0001) -> DataFrame:
    up, down = F.count_if(F.col("change") > flat), F.count_if(F.col("change") < -flat)
    share = F.avg(F.col("above_ma20").cast("int")) * 100
    return snap.agg(
        up.alias("advancers"), down.alias("decliners"), (F.count("change") - up - down).alias("unchanged"), ratio(up, down).alias("ad_ratio"), share.alias("pct_above_ma20"),
        F.count_if("new_high").alias("new_highs"), F.count_if("new_low").alias("new_lows"), F.sum("value").alias("total_value"), F.avg("change").alias("mean_change"),
    )


def sector_performance(snap: DataFrame) -> DataFrame:
    """Change weighted by traded value (plain where there is none), plain longer returns, value, advancers and decliners of each sector."""
    w = F.when(F.col("change").isNotNull(), F.col("value"))
    weighted = F.coalesce(ratio(F.sum(F.col("change") * F.col("value")), F.sum(w)), F.avg("change"))
    return snap.groupBy("sector").agg(
        weighted.alias("change_1d"), F.avg("ret_5").alias("ret_5"), F.avg("ret_20").alias("ret_20"), F.sum("value").alias("value"),
        F.count_if(F.col("change") > 0).alias("advancers"), F.count_if(F.col("change") < 0).alias("decliners"), F.count("*").alias("symbols"),
    )


def conjunction(df: DataFrame, rules: list[tuple[str, str, float]]) -> Column:
    """All of (column, operator, threshold); a null, or a missing column, fails."""
    ops = {">=": lambda c, t: c >= t, "<=": lambda c, t: c <= t, ">": lambda c, t: c > t, "<": lambda c, t: c < t}
    one = [F.coalesce(ops[o](F.col(c), F.lit(t)), F.lit(False)) if c in df.columns else F.lit(False) for c, o, t in rules]
    return reduce(lambda a, b: a & b, one, F.lit(True))


#: Criteria of which less is better, and of those the multiples that must be positive to count.
LOWER_IS_BETTER = ("pe", "pb", "ev_ebitda", "debt_to_equity")
MULTIPLES = ("pe", "pb", "ev_ebitda")


def composite_rank(df: DataFrame, weights: dict[str, float], ranges: int = 256) -> DataFrame:
    """score: weighted mean of percentile ranks with average ties, 0 to 100; a null criterion scores 0 with its full weight.

    Each criterion is ranked from counts by value. Values fall into ranges cut at approximate quantiles, are numbered within their range and
    take the counts of the ranges before; only the ranges' counts, as many rows as there are ranges, meet in one place. df, a row a symbol, is
    read several times for each criterion, so it is written once first.
    """
    df = kept(df, "ranked")
    value = {c: F.when(F.col(c) > 0, F.col(c)) if c in MULTIPLES else F.col(c) for c in weights}
    parts = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(*[F.percentile_approx(v.cast("double"), parts, 20 * ranges).alias(c) for c, v in value.items()]).first()
    out = df
    for c, x in value.items():
        at = F.size(F.filter(F.array(*[F.lit(q) for q in sorted(set(cuts[c] or [0.0]))]), lambda q: q <= F.col("x")))  # noqa: B023
        v = df.select(x.alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("k"))
        v = v.withColumn("range", -at if c in LOWER_IS_BETTER else at)
        whole = v.groupBy("range").agg(F.sum("k").alias("t"))  # at most `ranges` rows
        whole = whole.select("range", (F.sum("t").over(Window.orderBy("range")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy(F.lit(1))).alias("total"))
        inside = Window.partitionBy("range").orderBy(F.desc("x") if c in LOWER_IS_BETTER else F.asc("x"))
        v = v.withColumn("upto", F.sum("k").over(inside)).join(F.broadcast(whole), "range")
        v = v.select(F.col("x").alias(f"x_{c}"), ((F.col("before") + F.col("upto") - F.col("k") + (F.col("k") + 1) / 2) / F.col("total")).alias(f"p_{c}"))
        out = out.withColumn(f"y_{c}", x).join(v, F.col(f"y_{c}") == F.col(f"x_{c}"), "left").drop(f"x_{c}", f"y_{c}")
    total = sum(weights.values())
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"p_{c}"), F.lit(0.0)) * w for c, w in weights.items()]) / total * 100
    return out.withColumn("score", F.round(score, 1)).drop(*[f"p_{c}" for c in weights])
