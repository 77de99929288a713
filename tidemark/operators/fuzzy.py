"""Metrics of raw tables whose names of rows or columns vary: looked up by names alike, in an order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.store import kept

#: Names that are too short to be looked for inside others, and the least length of a name that is.
SHORT, LEAST = ("pe", "pb", "ps", "eps"), 4
#: Names that the metrics of raw statements go by, the preferred first.
NAMES = {
    "revenue": ("doanh thu", "revenue", "net revenue", "doanh_thu", "doanh thu thuần", "operating_sales", "net_sales"),
    "net_profit": ("lợi nhuận sau thuế", "net profit", "profit after tax", "loi_nhuan", "LNST", "net_profit", "profit_after_tax"),
    "gross_profit": ("lợi nhuận gộp", "gross profit", "loi nhuan gop", "gross_profit"), "roe": ("roe", "return on equity"), "roa": ("roa", "return on assets"),
    "equity": ("vốn chủ sở hữu", "equity", "total equity", "owners_equity"), "total_assets": ("tổng tài sản", "total assets", "total_assets"),
    "total_debt": ("tổng nợ", "total debt", "total liabilities", "nợ phải trả", "liabilities"), "debt_to_equity": ("debt_to_equity", "debtPerEquity", "nợ/vốn chủ", "nợ trên vốn chủ"),
    "cfo": ("tiền từ hoạt động kinh doanh", "operating cash flow", "CFO", "cash from operations", "operating_cash_flows", "hoạt động kinh doanh"),
    "capex": ("mua tài sản cố định", "capex", "capital expenditure", "purchase_of_fixed_assets", "tiền chi để mua sắm"),
}


def bare(name: Column) -> Column:
    """Lower case without underscores, spaces, slashes and percent signs."""
    return F.translate(F.lower(name), "_ /%", "")


def alike(wanted: str, name: Column) -> Column:
    """Whether a name is the one wanted, holds it, or is held by it; short ones only stand at its start or end."""
    w = wanted.lower().translate(str.maketrans("", "", "_ /%"))
    n = bare(name)
    if w in SHORT:
        return n.startswith(w) | n.endswith(w)
    holds = F.contains(n, F.lit(w)) if len(w) >= LEAST else F.lit(False)
    return (n == w) | holds | ((F.length(n) >= LEAST) & F.contains(F.lit(w), n))


def loosely(wanted: str, name: Column) -> Column:
    """Whether a name holds the one wanted or is held by it, however short."""
    w, n = wanted.lower().translate(str.maketrans("", "", "_ /%")), bare(name)
    return F.contains(n, F.lit(w)) | F.contains(F.lit(w), n)


def _rows(cells: DataFrame, names: tuple[str, ...], match) -> DataFrame:
    """The cells of each symbol's first row, by the order of names, then of rows, that has a value and a name alike."""
    known = cells.where("value is not null")
    named = lambda wanted: F.exists("ids", lambda x: F.coalesce(match(wanted, x), F.lit(False)))
    rank = F.array_min(F.array_compact(F.array(*[F.when(named(n), i) for i, n in enumerate(names)])))
    first = F.struct(F.col("_rank"), F.col("row"))
    hits = known.withColumn("_rank", rank).where("_rank is not null").withColumn("_first", F.min(first).over(Window.partitionBy("symbol")))
    return hits.where(first == F.col("_first")).drop("_rank", "_first")


def fuzzy_value(cells: DataFrame, names: tuple[str, ...], nonzero: bool = True) -> DataFrame:
    """(symbol, value): the last value by `period_key` of the row that names find; the last that is not 0, if there is one and nonzero is asked for.

    cells has (symbol, row, ids, period_key, value): a table's rows, or its columns, each with an ordinal and an array of names.
    """
    g = _rows(cells, names, alike).groupBy("symbol").agg(F.max_by("value", "period_key").alias("last"), F.max_by(F.when(F.col("value") != 0, F.col("value")), F.when(F.col("value") != 0, F.col("period_key"))).alias("nonzero"))
    return g.select("symbol", (F.coalesce("nonzero", "last") if nonzero else F.col("last")).alias("value"))


def series(cells: DataFrame, metric: str) -> DataFrame:
    """(symbol, period_key, value) of a metric of NAMES."""
    return _rows(cells, NAMES[metric], loosely).select("symbol", "period_key", "value")


def raw_metrics(income: DataFrame, balance: DataFrame, ratios: DataFrame, cash: DataFrame) -> DataFrame:
    """One row a symbol of what its raw tables (cells as in fuzzy_value) tell: last revenue and profit, growth, margins, returns, debt, cash flow and warnings.

    Growth is against the year before where there is one, else the row before. A return below 1 in the ratio table is a share and counts a hundredfold;
    one that the table lacks is net profit over equity or assets. Free cash flow adds capital expenditure, which is negative.
    """
    from tidemark.operators.statements import growth_vs_prior

    c = F.col
    # a dozen metrics read these: written once, what they are made of is not computed for each
    income, balance, ratios, cash = (kept(x, "raw") for x in (income, balance, ratios, cash))
    last = lambda cells, m: series(cells, m).groupBy("symbol").agg(F.max_by("value", "period_key").alias(m))
    grown = lambda m: growth_vs_prior(series(income, m).withColumnRenamed("value", "x"), "x").select("symbol", c("growth").alias(f"{m}_growth"))
    out = income.select("symbol").union(balance.select("symbol")).union(ratios.select("symbol")).union(cash.select("symbol")).distinct()
    parts = [last(income, m) for m in ("revenue", "net_profit", "gross_profit")] + [grown("revenue"), grown("net_profit")] + [last(balance, m) for m in ("equity", "total_assets", "total_debt")]
    parts += [last(ratios, m) for m in ("roe", "roa", "debt_to_equity")] + [last(cash, m) for m in ("cfo", "capex")]
    for p in parts:
        out = out.join(p, "symbol", "left")
    over = lambda a, b: F.try_divide(c(a), c(b))
    percent = lambda x: F.when(F.abs(c(x)) < 1, c(x) * 100).otherwise(c(x))
    out = out.withColumns({
        "net_margin": over("net_profit", "revenue") * 100, "gross_margin": over("gross_profit", "revenue") * 100, "roe": F.coalesce(percent("roe"), over("net_profit", "equity") * 100), "roa": F.coalesce(percent("roa"), over("net_profit", "total_assets") * 100),
        "debt_to_equity": F.coalesce(over("total_debt", "equity"), c("debt_to_equity")), "debt_to_assets": over("total_debt", "total_assets"), "fcf": c("cfo") + c("capex"),
    })
    odd = F.array_compact(F.array(F.when((c("revenue_growth") > 5) & (c("net_profit_growth") < -5), F.lit("profit falls")), F.when(c("debt_to_equity") > 2, F.lit("high debt")), F.when(c("cfo") < 0, F.lit("cash outflow"))))
    return out.withColumn("warnings", F.array_join(odd, ","))
