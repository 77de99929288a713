"""Screens, market tables, news lists and small state: what a desk looks at, over all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.performance import conjunction, latest
from tidemark.operators.technical import by_symbol, by_ts, ratio

#: The named screens.
PRESETS = {
    "value": [("pe", "<=", 12), ("pb", "<=", 1.5), ("roe", ">=", 12)],
    "growth": [("revenue_growth", ">=", 15), ("net_income_growth", ">=", 15), ("roe", ">=", 15)],
    "quality": [("roe", ">=", 18), ("debt_equity", "<=", 1), ("f_score", ">=", 6)],
    "dividend": [("dividend_yield", ">=", 5), ("debt_equity", "<=", 1.5)],
    "momentum": [("change_3m", ">=", 10), ("change_1y", ">=", 20)],
}


def screen(df: DataFrame, preset: str | None = None, sliders: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """The rows that pass a named screen with a slider's operator and threshold in place of, or besides, the screen's for its column."""
    rules = [r for r in PRESETS.get(preset or "", []) if r[0] not in (sliders or {})]
    return df.where(conjunction(df, rules + [(c, o, t) for c, (o, t) in (sliders or {}).items()]))


def members(df: DataFrame, baskets: DataFrame, names: list[str]) -> DataFrame:
    """The rows of symbols in any of the named baskets; baskets has (name, ordinal, symbol)."""
    return df.join(baskets.where(F.col("name").isin(names)).select("symbol").distinct(), "symbol", "left_semi")


def sectors(symbols: DataFrame, baskets: DataFrame, skip: list[str], overrides: dict[str, str], other: str = "other") -> DataFrame:
    """symbols with `sector`: an override, else the first basket by ordinal that holds it, index baskets left out, else `other`."""
    first = baskets.where(~F.col("name").isin(skip)).groupBy("symbol").agg(F.min_by("name", "ordinal").alias("_first"))
    fixed = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]) if overrides else F.create_map(F.lit(""), F.lit(""))
    return symbols.join(first, "symbol", "left").withColumn("sector", F.coalesce(fixed[F.col("symbol")], "_first", F.lit(other))).drop("_first")


def movers(snap: DataFrame, by: str, k: int = 10, most: bool = True) -> DataFrame:
    """The k rows of largest (or smallest) `by`, nulls left out, ties by symbol."""
    return snap.where(F.col(by).isNotNull()).orderBy(F.desc(by) if most else F.asc(by), "symbol").limit(k)


def board_breadth(board: DataFrame) -> DataFrame:
    """Advancers, decliners and unchanged of a board's changes around exactly 0; the ratio is infinite without decliners."""
    up, down = F.count_if(F.col("change") > 0), F.count_if(F.col("change") < 0)
    return board.agg(up.alias("advancers"), down.alias("decliners"), F.count_if(F.col("change") == 0).alias("unchanged"), F.when(down == 0, F.lit(float("inf"))).otherwise(up / F.nullif(down, F.lit(0))).alias("ad_ratio"))


def provenance(bars: DataFrame) -> DataFrame:
    """First and last time and rows of each symbol and source."""
    return bars.groupBy("symbol", "source").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("rows"))


def sources_used(cells: DataFrame) -> DataFrame:
    """Sources of each symbol's cells, sorted and joined."""
    return cells.where("source is not null").groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def as_percent(x: Column) -> Column:
    """A share below 1 as percent; what is larger is taken as percent already."""
    return F.when(F.abs(x) < 1, x * 100).otherwise(x)


def compare(bars: DataFrame) -> DataFrame:
    """(symbol, ts, rebased): closes of all symbols on their common calendar, gaps filled with the last close, from the day on which all have begun, the first as 100.

    The calendar is the days of all bars. A bar stands for the days up to the symbol's next one, so gaps are filled bar by bar and no symbol meets the whole calendar.
    """
    c = F.col
    begun = bars.groupBy("symbol").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"))
    span = begun.agg(F.max("begin").alias("start"), F.max("end").alias("end"))  # one row
    known = bars.select("symbol", "ts", "close").join(F.broadcast(span), F.lit(True)).withColumn("at", F.greatest("ts", "start"))
    known = known.groupBy("symbol", "at", "end").agg(F.max_by("close", "ts").alias("close"))  # of the bars before the start the last one counts
    until = F.coalesce(F.date_sub(F.lead("at").over(Window.partitionBy("symbol").orderBy("at")), 1), F.to_date("end"))
    filled = known.withColumn("until", until).select("symbol", "close", F.explode(F.sequence(F.to_date("at"), "until")).alias("day"))
    days = bars.select("ts", F.to_date("ts").alias("day")).distinct()
    filled = filled.join(days, "day").select("symbol", "ts", "close")
    return filled.select("symbol", "ts", (c("close") / F.first("close").over(by_ts()) * 100).alias("rebased"))


def report_returns(bars: DataFrame) -> DataFrame:
    """Returns over 21 and 63 bars, and since the first bar where there are over 200, in percent."""
    change = lambda p: (ratio(F.col("close"), p) - 1) * 100
    b = bars.withColumns({"ret_21": change(F.lag("close", 21).over(by_ts())), "ret_63": change(F.lag("close", 63).over(by_ts())), "n": F.count("*").over(by_symbol()), "old": F.first("close").over(by_ts())})
    return latest(b).select("symbol", "ret_21", "ret_63", F.when(F.col("n") > 200, change(F.col("old"))).alias("ret_year"))


def excess_return(bars: DataFrame, index: DataFrame, n: int = 120) -> DataFrame:
    """Return over n bars less the index's over n of its own."""
    one = lambda df, name: latest(df.withColumn(name, (ratio(F.col("close"), F.lag("close", n).over(by_ts())) - 1) * 100)).select("symbol", name)
    return one(bars, "ret").join(F.broadcast(one(index, "index_ret").select("index_ret")), F.lit(True)).withColumn("excess", F.col("ret") - F.col("index_ret"))


def stop_and_upside(df: DataFrame) -> DataFrame:
    """Adds stop, two true ranges below price but not below 0, and upside, the distance of fair from price."""
    return df.withColumns({"stop": F.greatest(F.lit(0.0), F.col("price") - 2 * F.col("atr")), "upside": ratio(F.col("fair") - F.col("price"), F.col("price"))})


def newest_news(news: DataFrame, k: int = 40) -> DataFrame:
    """Each symbol's k newest items by published time, those without one last, ties by id."""
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("published_at"), "news_id")
    return news.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def feed(news: DataFrame, symbols: list[str], k: int) -> DataFrame:
    """The k newest items of some symbols by published, else fetched, time."""
    return news.where(F.col("symbol").isin(symbols)).withColumn("at", F.coalesce("published_at", "fetched_at")).orderBy(F.desc_nulls_last("at"), "news_id").limit(k)


def news_window(news: DataFrame, as_of: Column, days: int, symbols: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """News of the last days up to as_of by published, else fetched, time, newest first, ties by id; of some symbols, and the first `limit`, if asked for."""
    at = F.coalesce("published_at", "fetched_at")
    d = news.where(at.between(as_of - F.make_dt_interval(F.lit(days)), as_of))
    d = d if symbols is None else d.where(F.col("symbol").isin(symbols))
    d = d.orderBy(F.desc(at), "news_id")
    return d if limit is None else d.limit(limit)


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def distinct_in_order(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Each key once, with the least ordinal it has."""
    return df.groupBy(key).agg(F.min(ordinal).alias(ordinal))


def upsert(kept: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """kept with the rows of new put in: the last by `at` of each key, a new row before a kept one of the same time. Columns of kept alone that new lacks are null."""
    cols = [c for c in new.columns if c in kept.columns]
    both = kept.withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_of(both, keys, F.desc(at), F.desc("_new"), *[F.desc(c) for c in cols if c not in (*keys, at)]).drop("_new")


def insert_new(kept: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """kept and the rows of new with other keys, one of each; the first write of a key stays."""
    return kept.unionByName(first_of(new.join(kept, key, "left_anti"), [key], *order))


def delete(kept: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return kept.join(gone, key, "left_anti")


def price_range(bars: DataFrame, symbol: str, low, high) -> DataFrame:
    return bars.where((F.col("symbol") == symbol) & F.col("ts").between(low, high)).orderBy("ts")


def reconcile(documents: DataFrame, online: DataFrame) -> DataFrame:
    """Items of two sources at one period, with how far the first is from the second in percent."""
    both = documents.select("symbol", "period_key", "item", F.col("value").alias("document")).join(online.select("symbol", "period_key", "item", F.col("value").alias("online")), ["symbol", "period_key", "item"])
    return both.withColumn("difference", F.try_divide(F.col("document") - F.col("online"), F.abs("online")) * 100)


def resolved_multiples(df: DataFrame) -> DataFrame:
    """Adds eps, bvps, pe and pb, each by the first way that gives a positive value: given by the user, by the provider, computed, implied.

    Columns: price, shares, net_income, equity and, null where unknown, eps_given, bvps_given, eps_provider, bvps_provider, pe_provider, pb_provider. A price
    below 1000 counts in thousands, shares of at most ten million in millions. Computed values are rounded half to even, to 1 digit a share and 2 for multiples.
    """
    c = F.col
    positive = lambda x: F.when(x > 0, x)
    d = df.withColumns({"price": F.when(c("price") < 1000, c("price") * 1000).otherwise(c("price")), "shares": F.when(c("shares") <= 10e6, c("shares") * 1e6).otherwise(c("shares"))})
    each = lambda total: F.bround(F.try_divide(positive(c(total)), positive(c("shares"))), 1)
    implied = lambda m: F.bround(F.try_divide(positive(c("price")), positive(c(m))), 1)
    given = lambda x: F.nullif(c(x), F.lit(0.0))
    d = d.withColumns({
        "eps": F.coalesce(given("eps_given"), positive(c("eps_provider")), implied("pe_provider"), each("net_income")), "bvps": F.coalesce(given("bvps_given"), positive(c("bvps_provider")), implied("pb_provider"), each("equity")),
    })
    ways = lambda own, provider, each: F.coalesce(F.bround(F.try_divide(positive(c("price")), given(own)), 2), positive(c(provider)), F.bround(F.try_divide(positive(c("price")), positive(c(each))), 2))
    return d.withColumns({"pe": ways("eps_given", "pe_provider", "eps"), "pb": ways("bvps_given", "pb_provider", "bvps")})


def recommendation(score: Column, upside: Column | None = None) -> Column:
    """Advice by a total score; the strongest only without a known upside, or with one above 0."""
    rises = F.lit(True) if upside is None else F.coalesce(upside > 0, F.lit(True))
    return F.when(score.isNull(), None).when((score >= 80) & rises, "strong buy").when(score >= 65, "buy").when(score >= 50, "hold").when(score >= 35, "reduce").otherwise("sell")


def component_rows(df: DataFrame, parts: dict[str, tuple[str, float]]) -> DataFrame:
    """(symbol, component, points, most, passed): a row for each part that has points, passed with half of them; parts has a column and the most points by name."""
    rows = F.array(*[F.struct(F.lit(n).alias("component"), F.col(c).cast("double").alias("points"), F.lit(float(m)).alias("most")) for n, (c, m) in parts.items()])
    return df.select("symbol", F.inline(rows)).where("points is not null").withColumn("passed", F.try_divide("points", "most") >= 0.5)


def level(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= 65, "high").when(score >= 45, "medium").otherwise("low")
