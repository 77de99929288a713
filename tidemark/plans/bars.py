"""Price bars and statements derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with nation and region of its supplier. Only nation and region, fixed at 25 and 5 rows, are broadcast."""
    geo = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, sf_dir, "supplier").join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    return table(spark, sf_dir, "lineitem").join(who, F.col("l_suppkey") == F.col("s_suppkey"))


def walk_bars(spark: SparkSession, sf_dir: str, symbol: str | Column = "r_name") -> DataFrame:
    """Daily bars (symbol, ts, open, high, low, close, volume): an integer random walk for each symbol, equal on any engine."""
    k = F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey")
    sym = F.col(symbol) if isinstance(symbol, str) else symbol
    day = (
        trades(spark, sf_dir)
        .groupBy(sym.alias("symbol"), F.col("l_shipdate").alias("ts"))
        .agg((F.sum(k) % 401 - 200).alias("r"), (F.max(k) % 61).alias("hx"), (F.min(k) % 61).alias("lx"), F.sum("l_quantity").cast("long").alias("volume"))
    )
    w = Window.partitionBy("symbol").orderBy("ts")
    close = F.round(1000 * F.exp(F.lit(1e-4) * F.sum("r").over(w)), 2)
    day = day.withColumn("cc", F.round(close * 100).cast("long")).withColumn("oc", F.lag("cc", 1, 100000).over(w))
    high = F.floor(F.greatest("oc", "cc") * (10000 + F.col("hx")) / 10000)
    low = F.floor(F.least("oc", "cc") * (10000 - F.col("lx")) / 10000)
    return day.select("symbol", "ts", (F.col("oc") / 100.0).alias("open"), (high / 100.0).alias("high"), (low / 100.0).alias("low"), (F.col("cc") / 100.0).alias("close"), "volume")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly canonical statements (symbol, period_key = year * 10 + quarter, items) for each nation, of simple deterministic sums."""
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    q = trades(spark, sf_dir).groupBy(F.col("n_name").alias("symbol"), (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).alias("period_key"))
    return q.agg(
        F.sum(p * (1 - d)).alias("revenue"), (-F.sum(p * 0.6)).alias("cogs"), F.sum(p * (0.35 - d)).alias("operating_profit"),
        F.sum(p * (0.3 - d)).alias("profit_before_tax"), F.sum(p * 0.05).alias("income_tax"), F.sum(p * (0.25 - d)).alias("net_income"),
        F.sum(p * 0.02).alias("interest_expense"), F.sum(p * 0.03).alias("depreciation"), (F.sum(p) * 4 + F.max(p)).alias("total_assets"),
        (F.sum(p) * 2 + F.sum("l_quantity")).alias("equity"), (F.sum(p) * 1.5 + F.sum("l_quantity") * 10).alias("current_assets"), (F.sum(p) * 0.9).alias("current_liabilities"),
        F.sum(p * d).alias("inventory"), F.sum(F.when(F.col("l_linestatus") == "O", p)).alias("receivables"), (F.sum(p) * 0.3).alias("cash"),
        F.sum(p * 0.5).alias("short_term_debt"), F.sum(F.when(F.col("l_returnflag") == "R", p)).alias("long_term_debt"),
        F.sum(p * (0.28 - d)).alias("cfo"), (-F.sum(p * 0.04)).alias("capex"), F.sum("l_quantity").alias("shares_outstanding"),
        F.sum(p * (F.lit(0.6) - d * 5)).alias("retained_earnings"),
    )


#: The same tables as SQL common table expressions.
BARS_SQL = """trades AS (SELECT l.*, n_name, r_name FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
day0 AS (SELECT {symbol} AS symbol, l_shipdate AS ts, sum(l_orderkey*7 + l_partkey*13 + l_suppkey)::BIGINT % 401 - 200 AS r,
 max(l_orderkey*7 + l_partkey*13 + l_suppkey) % 61 AS hx, min(l_orderkey*7 + l_partkey*13 + l_suppkey) % 61 AS lx, sum(l_quantity)::BIGINT AS volume FROM trades GROUP BY ALL),
day1 AS (SELECT *, round(round(1000*exp(1e-4*(sum(r) OVER (PARTITION BY symbol ORDER BY ts))::DOUBLE), 2)*100)::BIGINT AS cc FROM day0),
day2 AS (SELECT *, lag(cc, 1, 100000) OVER (PARTITION BY symbol ORDER BY ts) AS oc FROM day1),
bars AS (SELECT symbol, ts, oc/100.0::DOUBLE AS open, (greatest(oc, cc)*(10000+hx)//10000)/100.0::DOUBLE AS high, (least(oc, cc)*(10000-lx)//10000)/100.0::DOUBLE AS low,
 cc/100.0::DOUBLE AS close, volume FROM day2)"""

STATEMENTS_SQL = """trades AS (SELECT l.*, n_name, r_name FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
fin AS (SELECT n_name AS symbol, (year(l_shipdate)*10 + quarter(l_shipdate))::INT AS period_key, sum(l_extendedprice*(1-l_discount)) AS revenue, -sum(l_extendedprice*0.6::DOUBLE) AS cogs,
 sum(l_extendedprice*(0.35::DOUBLE-l_discount)) AS operating_profit, sum(l_extendedprice*(0.3::DOUBLE-l_discount)) AS profit_before_tax, sum(l_extendedprice*0.05::DOUBLE) AS income_tax,
 sum(l_extendedprice*(0.25::DOUBLE-l_discount)) AS net_income, sum(l_extendedprice*0.02::DOUBLE) AS interest_expense, sum(l_extendedprice*0.03::DOUBLE) AS depreciation,
 sum(l_extendedprice)*4 + max(l_extendedprice) AS total_assets, sum(l_extendedprice)*2 + sum(l_quantity) AS equity, sum(l_extendedprice)*1.5::DOUBLE + sum(l_quantity)*10 AS current_assets,
 sum(l_extendedprice)*0.9::DOUBLE AS current_liabilities, sum(l_extendedprice*l_discount) AS inventory, sum(l_extendedprice) FILTER (l_linestatus='O') AS receivables,
 sum(l_extendedprice)*0.3::DOUBLE AS cash, sum(l_extendedprice*0.5::DOUBLE) AS short_term_debt, sum(l_extendedprice) FILTER (l_returnflag='R') AS long_term_debt,
 sum(l_extendedprice*(0.28::DOUBLE-l_discount)) AS cfo, -sum(l_extendedprice*0.04::DOUBLE) AS capex, sum(l_quantity) AS shares_outstanding,
 sum(l_extendedprice*(0.6::DOUBLE-l_discount*5)) AS retained_earnings FROM trades GROUP BY ALL)"""


def bars_sql(symbol: str = "r_name") -> str:
    return BARS_SQL.format(symbol=symbol)
