"""Payloads of providers as they landed, and scans over them: the first provider with something to tell wins, symbol by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.sources import merge

#: Other names of indices.
ALIASES = {"HNX": "HNXINDEX", "UPCOM": "UPCOMINDEX", "VN-INDEX": "VNINDEX", "VNI": "VNINDEX"}
#: How the payloads of a kind are read.
PARSERS = {"bars": merge.chart_bars, "statements": merge.statement_cells}


def canonical_symbol(symbol: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """In capitals without spaces around, an alias as what it stands for."""
    name = F.upper(F.trim(symbol))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[name], name) if aliases else name


def land(payloads: DataFrame, root: str, mode: str = "append") -> None:
    """Store payloads (kind, provider, symbol, payload, fetched_at) in folders by kind and provider."""
    payloads.select("kind", "provider", "symbol", "payload", "fetched_at").write.mode(mode).partitionBy("kind", "provider").parquet(root)


def latest(spark: SparkSession, root: str, kind: str, providers: list[str], aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(provider, symbol, payload, fetched_at): the last payload of each provider and symbol; only these folders are read."""
    rows = spark.read.parquet(root).where((F.col("kind") == kind) & F.col("provider").isin(providers)).withColumn("symbol", canonical_symbol(F.col("symbol"), aliases))
    rows = rows.where("payload is not null").groupBy("provider", "symbol").agg(F.max(F.struct("fetched_at", "payload")).alias("p"))
    return rows.select("provider", "symbol", "p.payload", "p.fetched_at")


def parsed(spark: SparkSession, root: str, kind: str, providers: list[str], aliases: dict[str, str] = ALIASES) -> DataFrame:
    """What the last payloads tell, with their provider."""
    rows = latest(spark, root, kind, providers, aliases).select(F.struct("provider", "symbol").alias("symbol"), "payload")
    out = PARSERS[kind](rows)
    return out.select(F.col("symbol.symbol").alias("symbol"), F.col("symbol.provider").alias("source"), *[c for c in out.columns if c != "symbol"])


def scan(spark: SparkSession, root: str, kind: str, providers: list[str], aliases: dict[str, str] = ALIASES) -> DataFrame:
    """The rows of each symbol's first provider, in the order given, that has any; an empty, broken or null payload has none. `source` tells which."""
    order = F.create_map(*[F.lit(x) for i, p in enumerate(providers) for x in (p, i)])
    rows = parsed(spark, root, kind, providers, aliases).withColumn("_p", order[F.col("source")])
    return rows.withColumn("_first", F.min("_p").over(Window.partitionBy("symbol"))).where("_p = _first").drop("_p", "_first")


def prices(spark: SparkSession, root: str, providers: list[str], start, end, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Bars from start to end, both included. A provider that has bars, but none within, is passed over."""
    order = F.create_map(*[F.lit(x) for i, p in enumerate(providers) for x in (p, i)])
    rows = parsed(spark, root, "bars", providers, aliases).where(F.col("ts").between(start, end)).withColumn("_p", order[F.col("source")])
    return rows.withColumn("_first", F.min("_p").over(Window.partitionBy("symbol"))).where("_p = _first").drop("_p", "_first")


def health(spark: SparkSession, root: str, kind: str, providers: list[str]) -> DataFrame:
    """(provider, available, symbols, fetched_at): whether a provider's last payloads tell anything, of how many symbols, and when they came."""
    told = parsed(spark, root, kind, providers).groupBy("source").agg(F.count_distinct("symbol").alias("symbols"))
    asked = spark.createDataFrame([(p,) for p in providers], "provider string")
    came = latest(spark, root, kind, providers).groupBy("provider").agg(F.max("fetched_at").alias("fetched_at"))
    both = asked.join(told.withColumnRenamed("source", "provider"), "provider", "left").join(came, "provider", "left")
    return both.select("provider", F.col("symbols").isNotNull().alias("available"), F.coalesce("symbols", F.lit(0)).alias("symbols"), "fetched_at")
