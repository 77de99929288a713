"""From raw tables to canonical ones: price normalising, units, statement matrices, label matching and scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import norm_label, period_key, strip_accents
from tidemark.sources.merge import PRICES

#: Other names of price columns.
ALIASES = {"time": "ts", "date": "ts", "timestamp": "ts", "tradingdate": "ts", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume", "ticker": "symbol", "code": "symbol"}


def unique_columns(df: DataFrame) -> DataFrame:
    """The columns in lower case, the first of each name."""
    seen: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(c.lower(), i)
    names = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*names).select(*[F.col(names[i]).alias(c) for c, i in seen.items()])


def normalize_price(raw: DataFrame, as_of: Column) -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume) of a raw table, one for each symbol and time.

    Columns go by their known names, the first of several that mean the same; numbers and times that cannot be read are null; a missing open, high or
    low is the close; rows later than as_of, without time or without a positive close are left out; of rows with one symbol and time the
    first in the order of `seq` stays (of any, if there is no such column: the one of largest close).
    """
    df = unique_columns(raw)
    found: dict[str, str] = {}
    for c in df.columns:
        found.setdefault(ALIASES.get(c, c), c)
    number = lambda c: F.col(found[c]).cast("string").try_cast("double") if c in found else F.lit(None).cast("double")
    order = [F.col("seq")] if "seq" in found else [F.desc("close")]
    close = number("close")
    rows = df.select(
        F.upper(F.trim(found["symbol"])).alias("symbol"), F.col(found["ts"]).cast("string").try_cast("timestamp_ntz").alias("ts"), *[F.coalesce(number(c), close).alias(c) for c in PRICES[:3]], close.alias("close"),
        number("volume").alias("volume"), *([F.col(found["seq"]).alias("seq")] if "seq" in found else []),
    )
    kept = rows.where("symbol is not null and ts is not null and close > 0").where(F.col("ts") <= as_of)
    one = kept.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(*order))).where("_rn = 1")
    return one.select("symbol", "ts", *PRICES, "volume")


def implausible(bars: DataFrame) -> DataFrame:
    """The bars whose close lies far outside their range, or whose high is below their low."""
    return bars.where((F.col("high") < F.col("low")) | (F.col("close") > 1.2 * F.col("high")) | (F.col("close") < 0.8 * F.col("low")))


def lift_units(bars: DataFrame, exempt: list[str], below: float = 1000.0) -> DataFrame:
    """Prices times 1000 for the symbols whose median close is positive and below `below`; index symbols are exempt."""
    median = bars.groupBy("symbol").agg(F.percentile("close", 0.5).alias("_median"))
    up = F.when((F.col("_median") > 0) & (F.col("_median") < below) & ~F.col("symbol").isin(exempt), 1000.0).otherwise(1.0)
    return bars.join(median, "symbol").withColumns({c: F.col(c) * up for c in PRICES}).drop("_median")


def pct_change(new: Column, old: Column) -> Column:
    return F.try_divide(new - old, F.abs(old)) * 100


def money_text(v: Column) -> Column:
    """An amount in billions, millions or as it is."""
    a = F.abs(v)
    return F.when(a >= 1e9, F.concat(F.format_number(v / 1e9, 2), F.lit(" bn"))).when(a >= 1e6, F.concat(F.format_number(v / 1e6, 2), F.lit(" m"))).otherwise(F.format_number(v, 0))


def matrix_cells(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, label, value) of a matrix that has a column for each period, pos being the column's place."""
    cols = [c for c in wide.columns if c not in keys]
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("label"), F.col(f"`{c}`").cast("string").try_cast("double").alias("value")) for i, c in enumerate(cols)])
    return wide.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.pos", "x.label", "x.value")


def by_period(cells: DataFrame, table: list[str], row: list[str]) -> DataFrame:
    """Cells with their period_key, one for each row and period: that of the first place. `table` and `row` are the columns that name a table and its rows.

    Labels with a suffix _N are copies and left out; a table of four or more period columns under a single period is left out, as its columns cannot be told apart.
    """
    known = cells.withColumn("period_key", period_key(F.col("label"))).where(F.col("period_key").isNotNull() & ~F.col("label").rlike(r"_\d+$"))
    fine = known.groupBy(*table).agg(F.count_distinct("pos").alias("_n"), F.count_distinct("period_key").alias("_k")).where("not (_n >= 4 and _k = 1)").select(*table)
    return known.join(fine, table).groupBy(*table, *row, "period_key").agg(F.min_by("value", "pos").alias("value"))


def from_tabular(rows: DataFrame, year: str, quarter: str, order: str) -> DataFrame:
    """rows with period_key from a year and a quarter column (0 outside 1 to 4), the last by `order` of each symbol and period; rows without a year are left out."""
    q = F.col(quarter).cast("int")
    keyed = rows.withColumn("period_key", F.col(year).cast("int") * 10 + F.when(q.between(1, 4), q).otherwise(0)).where("period_key is not null")
    return keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol", "period_key").orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def period_order(labels: DataFrame) -> DataFrame:
    """(symbol, label, place): period labels in order of time, or of the alphabet where a symbol has one that names no period."""
    k = labels.select("symbol", "label").distinct().withColumn("key", period_key(F.col("label")))
    k = k.withColumn("sure", F.min(F.col("key").isNotNull()).over(Window.partitionBy("symbol")))
    return k.select("symbol", "label", F.row_number().over(Window.partitionBy("symbol").orderBy(F.when(F.col("sure"), F.col("key")), "label")).alias("place"))


def match_items(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(symbol, item, row): for each item the row of a statement that its rules name first.

    rows has (symbol, row, item_id, label, label_en); rules (item, tier, ordinal, pattern, excluded): tier 0 compares ids, 1 labels, 2 English labels, in the
    order of `ordinal`. A label rule looks for labels that start with its pattern before those that hold it, with or without accents; labels that hold one of
    `excluded` are passed over. Rules are a registry of a few hundred rows and broadcast.
    """
    c = F.col
    # dealt by symbol before they meet the rules: the task that reads a large file then sorts none of what the rules find
    rows = rows.select("symbol", "row", "item_id", "label", "label_en").repartition("symbol")
    rows = rows.withColumns({"lab1": norm_label(c("label")), "lab2": norm_label(c("label_en"))})
    rows = rows.select("symbol", "row", F.lower("item_id").alias("id"), F.array(*[F.struct(F.lit(t).alias("tier"), c(f"lab{t}").alias("lab"), strip_accents(c(f"lab{t}")).alias("plain")) for t in (1, 2)]).alias("labels"))
    rules = rules.select("item", "tier", "ordinal", F.lower("pattern").alias("p"), strip_accents(F.lower("pattern")).alias("pp"), F.concat("excluded", F.transform("excluded", strip_accents)).alias("veto"))
    by_id = rows.where("id is not null").join(F.broadcast(rules.where("tier = 0").withColumnRenamed("p", "id")), "id").select("symbol", "item", "tier", "ordinal", F.lit(0).alias("mode"), "row")
    # what a label holds is no key: labels, made plain once, meet the rules of their tier
    said = rows.select("symbol", "row", F.inline("labels")).where("lab <> ''")
    holds = F.contains("lab", c("p")) | F.contains("plain", c("pp"))
    hits = said.join(F.broadcast(rules.where("tier in (1, 2)")), ["tier"]).where(holds & ~F.exists("veto", lambda e: F.contains("lab", e) | F.contains("plain", e)))
    by_label = hits.select("symbol", "item", "tier", "ordinal", F.when(F.startswith("lab", c("p")) | F.startswith("plain", c("pp")), 0).otherwise(1).alias("mode"), "row")
    best = by_id.unionByName(by_label).groupBy("symbol", "item").agg(F.min(F.struct("tier", "ordinal", "mode", "row")).alias("best"))
    return best.select("symbol", "item", "best.row")


def unit_of_labels(rows: DataFrame, billions: list[str], millions: list[str]) -> DataFrame:
    """(symbol, factor): 1e9 or 1e6 where a label of the table says so, else null."""
    said = lambda words: F.max(reduce(lambda a, b: a | b, [F.contains(F.lower("label"), F.lit(w)) for w in words]))
    return rows.groupBy("symbol").agg(F.when(said(billions), 1e9).when(said(millions), 1e6).alias("factor"))


def canonicalize(cells: DataFrame, matched: DataFrame, factor: DataFrame, per_unit: list[str]) -> DataFrame:
    """Canonical cells (symbol, period_key, item, value) of cells (symbol, row, period_key, value); amounts take the table's factor, items of per_unit do not."""
    rows = cells.join(matched, ["symbol", "row"]).join(factor, "symbol", "left").where("value is not null")
    scaled = F.when(F.col("item").isin(per_unit), F.col("value")).otherwise(F.col("value") * F.coalesce("factor", F.lit(1.0)))
    return rows.select("symbol", "period_key", "item", scaled.alias("value"))


#: The items that tell a statement's scale, in order, the scales and the least amount of a listed company.
TELLING, SCALES, LEAST = ("total_assets", "equity", "revenue", "total_operating_income"), (1.0, 1e3, 1e6, 1e9), 1e10


def infer_scale(wide: DataFrame) -> DataFrame:
    """(symbol, scale): the least scale that lifts the median of the first telling item to LEAST; where none does, of the next item; else 1."""
    have = [c for c in TELLING if c in wide.columns]
    g = wide.groupBy("symbol").agg(*[F.percentile(F.abs(c), 0.5).alias(c) for c in have])
    one = lambda c: reduce(lambda acc, f: acc.when(F.col(c) * f >= LEAST, f), SCALES[1:], F.when(F.col(c).isNull() | (F.col(c) <= 0), None).when(F.col(c) * SCALES[0] >= LEAST, SCALES[0]))
    return g.select("symbol", F.coalesce(*[one(c) for c in have], F.lit(1.0)).alias("scale"))


def long_to_wide(cells: DataFrame, items: list[str]) -> DataFrame:
    """A column for each item, and <item>_source with where it came from; of several values the first by source."""
    first = [F.min(F.when(F.col("item") == i, F.struct("source", "value"))).alias(i) for i in items]
    g = cells.where("value is not null").groupBy("symbol", "period_key").agg(*first)
    return g.select("symbol", "period_key", *[F.col(f"{i}.value").alias(i) for i in items], *[F.col(f"{i}.source").alias(f"{i}_source") for i in items])


def symbol_label(symbol: Column, name: Column, most: int = 32, exchange: Column | None = None) -> Column:
    """SYMBOL - name (exchange), without what is not known; long names are cut."""
    known = lambda x: F.when(~F.lower(F.trim(x)).isin("", "nan"), F.trim(x))
    name = known(name)
    short = F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 2), F.lit("..."))).otherwise(name)
    label = F.concat_ws(" - ", symbol, short)
    return label if exchange is None else F.concat_ws(" ", label, F.concat(F.lit("("), known(exchange), F.lit(")")))


def label_symbol(label: Column) -> Column:
    """The symbol of a label as symbol_label() makes it, or of what was typed."""
    t = F.trim(label)
    return F.upper(F.trim(F.when(F.contains(t, F.lit(" - ")), F.substring_index(t, " - ", 1)).otherwise(F.substring_index(t, " (", 1))))


def find_option(symbols: DataFrame, options: DataFrame) -> DataFrame:
    """(symbol, option): the first option, by `ordinal`, that is the symbol, or begins with it and a space or dash."""
    o = options.withColumn("symbol", F.regexp_extract("option", "^([^ -]*)", 1))
    s = symbols.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    return s.join(o, "symbol").groupBy("symbol").agg(F.min_by("option", "ordinal").alias("option"))


def distinct_names(df: DataFrame) -> DataFrame:
    """df with every column, those of one name numbered from the second on: name, name (2), name (3)."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c} ({seen[c]})")
    return df.toDF(*names)


def flat_names(df: DataFrame) -> DataFrame:
    """df with the fields of its structs as columns, named by both, the first of each name."""
    flat = [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name} {g.name}".strip()) if g else F.col(f"`{f.name}`") for f in df.schema for g in (f.dataType.fields if f.dataType.typeName() == "struct" else [None])]
    return unique_columns(df.select(*flat))
