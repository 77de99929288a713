"""Reading bars from JSON payloads, choosing between sources, stitching price series and merging statement cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PRICES = ("open", "high", "low", "close")


def chart_bars(payloads: DataFrame, zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """Daily bars of JSON columns {t, o, h, l, c, v}, t in epoch seconds; bars without a close are left out.

    `payloads` has (symbol, payload). A payload that is null or not such JSON gives no rows.
    """
    parsed = payloads.select("symbol", F.from_json("payload", "t array<long>, o array<double>, h array<double>, l array<double>, c array<double>, v array<long>").alias("j"))
    rows = parsed.select("symbol", F.inline(F.arrays_zip("j.t", "j.o", "j.h", "j.l", "j.c", "j.v"))).toDF("symbol", "t", *PRICES, "volume")
    ts = F.date_trunc("day", F.from_utc_timestamp(F.timestamp_seconds("t"), zone)).cast("timestamp_ntz")
    return rows.where("close is not null and t is not null").select("symbol", ts.alias("ts"), *PRICES, "volume")


def first_source(bars: DataFrame) -> DataFrame:
    """The rows of each symbol's first source in the order of `priority` that has rows for it."""
    return bars.withColumn("first", F.min("priority").over(Window.partitionBy("symbol"))).where("priority = first").drop("first")


def last_quote(bars: DataFrame) -> DataFrame:
    """price, reference (the last close of an earlier day), change and change in percent of each symbol's last bar."""
    last = bars.withColumn("day", F.date_trunc("day", F.max("ts").over(Window.partitionBy("symbol"))))
    q = last.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"), F.max_by("close", F.when(F.col("ts") < F.col("day"), F.col("ts"))).alias("reference"))
    return q.withColumn("change", F.col("price") - F.col("reference")).withColumn("change_pct", F.try_divide("change", "reference") * 100)


def stitch(recent: DataFrame, older: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """`recent` bars with the `older` ones from before a symbol's first recent day, on one price level.

    The level is the median of recent to older closes over the days that both have. Older prices take it if it is further than
    `tolerance` from 1; `adjusted` marks them and `factor` carries it (null where none is applied). Both sides
    have (symbol, ts, open, high, low, close, volume). A time that occurs more than once on one side keeps the row of the largest volume, then close.
    A symbol on one side only keeps that side as it is.
    """

    def unique(df):
        w = Window.partitionBy("symbol", "ts").orderBy(F.desc_nulls_last("volume"), F.desc_nulls_last("close"))
        return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("symbol", "ts", *PRICES, "volume", F.to_date("ts").alias("day"))

    new, old = unique(recent), unique(older)
    both = new.select("symbol", "day", F.col("close").alias("a")).join(old.select("symbol", "day", F.col("close").alias("b")), ["symbol", "day"])
    level = both.groupBy("symbol").agg(F.expr("percentile(try_divide(a, b), 0.5)").alias("level"))
    start = new.groupBy("symbol").agg(F.min("day").alias("start"))
    known = start.join(level, "symbol", "left").withColumn("factor", F.when(F.abs(F.col("level") - 1) > tolerance, F.col("level"))).drop("level")
    before = old.join(known, "symbol", "left").where("start is null or day < start")
    moved = before.select("symbol", "ts", *[(F.col(c) * F.coalesce("factor", F.lit(1.0))).alias(c) for c in PRICES], "volume", F.col("factor").isNotNull().alias("adjusted"), "factor")
    return moved.unionByName(new.select("symbol", "ts", *PRICES, "volume", F.lit(False).alias("adjusted"), F.lit(None).cast("double").alias("factor")))


def hybrid(near: DataFrame, far: DataFrame, start, end, recent_days: int = 365, overlap: int = 10) -> DataFrame:
    """Bars from start to end: the last `recent_days` of them from one source, what is older from another, stitched.

    The older source is asked up to `overlap` days beyond the cut, so that levels can be told; where a symbol has no recent bars, up to the end. start and
    end are days. `adjusted` and `factor` are as in stitch().
    """
    low, high = F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))
    cut = high - F.make_dt_interval(F.lit(recent_days))
    recent = near.where(F.col("ts").between(F.greatest(low, cut), high + F.make_dt_interval(F.lit(1))))
    has = recent.select("symbol").distinct().withColumn("_recent", F.lit(True))
    older = far.join(has, "symbol", "left").withColumn("_recent", F.coalesce("_recent", F.lit(False)))
    until = F.when(F.col("_recent"), F.least(cut + F.make_dt_interval(F.lit(overlap)), high)).otherwise(high)
    older = older.where((F.col("ts") >= low) & (F.col("ts") <= until) & (~F.col("_recent") | (low < cut))).drop("_recent")
    return stitch(recent, older)


def listing(spark, path: str, fallback: list[tuple[str, str, str]]) -> DataFrame:
    """(symbol, name, exchange) of a listing in JSON, one symbol an entry; the fallback's rows where it has none."""
    rows = spark.read.schema("symbol string, name string, exchange string").option("multiLine", True).json(path).where("symbol is not null")
    few = spark.createDataFrame(fallback, rows.schema)
    some = rows.select(F.lit(True).alias("some")).limit(1)
    return rows.unionByName(few.join(some, F.lit(True), "left_anti"))  # a few rows against one


def merge_cells(cells: DataFrame) -> DataFrame:
    """One value and its source for each (symbol, period_key, item): the first, by `priority`, that is not null. One aggregate, however many sources."""
    best = F.min(F.struct("priority", "source", "value")).alias("best")
    return cells.where("value is not null").groupBy("symbol", "period_key", "item").agg(best).select("symbol", "period_key", "item", "best.value", "best.source")


def current_quote(intraday: DataFrame, daily: DataFrame) -> DataFrame:
    """price, reference, change and change in percent of each symbol: its last intraday bar, else its last daily one, against the last daily close of an earlier day."""
    last = lambda df, p: df.groupBy("symbol").agg(F.max(F.struct("ts", "close")).alias(p))
    q = last(daily, "d").join(last(intraday, "i"), "symbol", "full").select("symbol", F.coalesce("i", "d").alias("q"))
    before = daily.select("symbol", "ts", F.col("close").alias("c")).join(q, "symbol").where(F.col("ts") < F.date_trunc("day", "q.ts")).groupBy("symbol").agg(F.max_by("c", "ts").alias("reference"))
    out = q.join(before, "symbol", "left").select("symbol", F.col("q.close").alias("price"), "reference")
    return out.withColumn("change", F.col("price") - F.col("reference")).withColumn("change_pct", F.try_divide("change", "reference") * 100)


def on_exchange(listing: DataFrame, exchange: str, synonyms: dict[str, str]) -> DataFrame:
    """The listed symbols of an exchange, by any of its names."""
    names = {exchange.upper(), *[b for a, b in synonyms.items() if a == exchange.upper()], *[a for a, b in synonyms.items() if b == exchange.upper()]}
    return listing.where(F.upper("exchange").isin(sorted(names)))


def statement_cells(payloads: DataFrame) -> DataFrame:
    """(symbol, item, period, value) of JSON statements [periods, {group: [{Name, Value1, Value2, ...}]}], a period by its place; a payload that is none gives no rows."""
    j = payloads.select("symbol", F.from_json(F.get_json_object("payload", "$[0]"), "array<string>").alias("periods"), F.from_json(F.get_json_object("payload", "$[1]"), "map<string, array<map<string, string>>>").alias("groups"))
    rows = j.select("symbol", "periods", F.explode("groups").alias("group", "items")).select("symbol", "periods", F.explode("items").alias("x"))
    at = rows.select("symbol", F.col("x")["Name"].alias("item"), "x", F.posexplode("periods").alias("pos", "period"))
    return at.select("symbol", "item", "period", F.col("x")[F.concat(F.lit("Value"), (F.col("pos") + 1).cast("string"))].try_cast("double").alias("value"))
