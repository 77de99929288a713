"""Statement analytics on canonical wide rows (symbol, period_key = year * 10 + quarter, 0 for a year, items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

def _key():
    return Window.partitionBy("symbol").orderBy("period_key")


def _ord():
    return Window.partitionBy("symbol", F.col("period_key") % 10 == 0).orderBy("qi")  # a year's row is no quarter


#: Items that ratios look at, and the par value of a share.
ITEMS = (
    "revenue", "cogs", "gross_profit", "operating_profit", "profit_before_tax", "income_tax", "net_income", "net_income_parent", "interest_expense", "total_operating_income", "provision_expense",
    "net_interest_income", "cash", "short_term_investments", "receivables", "inventory", "current_assets", "total_assets", "current_liabilities", "payables", "short_term_debt", "long_term_debt",
    "total_liabilities", "equity", "minority_interest", "charter_capital", "retained_earnings", "customer_loans", "customer_deposits", "depreciation", "cfo", "capex", "dividends_paid", "shares_outstanding",
)
PAR = 10_000


def with_items(wide: DataFrame) -> DataFrame:
    """wide with is_bank, and every item that ratios look at, null where the table lacks it; a bank's revenue is its operating income if revenue is lacking."""
    lacks_revenue = "revenue" not in wide.columns
    d = wide.withColumns({x: F.lit(None).cast("double") for x in ITEMS if x not in wide.columns})
    d = d.withColumn("is_bank", F.max(F.col("customer_deposits").isNotNull() | F.col("net_interest_income").isNotNull()).over(Window.partitionBy("symbol")))
    return d.withColumn("revenue", F.when(F.col("is_bank"), F.col("total_operating_income"))) if lacks_revenue else d


def kinds(wide: DataFrame) -> DataFrame:
    """(symbol, period, is_bank): quarter where most keys are quarters, else year."""
    d = with_items(wide)
    return d.groupBy("symbol").agg(F.when(F.avg((F.col("period_key") % 10 > 0).cast("int")) > 0.5, "quarter").otherwise("year").alias("period"), F.first("is_bank").alias("is_bank"))


def shares() -> Column:
    """Shares as reported if positive, else from charter capital at par."""
    return F.when(F.col("shares_outstanding") > 0, F.col("shares_outstanding")).otherwise(F.col("charter_capital") / PAR)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def year_ago(x: Column) -> Column:
    """The value ten keys back, that is one year, whatever rows lie between."""
    return F.first_value(x).over(_key().rangeBetween(-10, -10))


def ttm(x: Column) -> Column:
    """Sum of four consecutive quarters, all there; needs period_key and the column qi of quarter ordinals."""
    w = _ord().rangeBetween(-3, 0)
    return F.when(F.count(x).over(w) == 4, F.sum(x).over(w))


def with_quarters(wide: DataFrame) -> DataFrame:
    return wide.withColumn("qi", F.expr("(period_key div 10) * 4 + period_key % 10"))


def flow(x: Column) -> Column:
    """An amount over a year: as it is in a year's row, over four quarters in a quarter's."""
    return F.when(F.col("period_key") % 10 == 0, x).otherwise(ttm(x))


def average(x: Column) -> Column:
    return (x + year_ago(x)) / 2


def prepared(wide: DataFrame) -> DataFrame:
    """Amounts over a year, year-ago averages and the derived amounts that ratios need. All items are doubles, null where missing."""
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    d = with_quarters(with_items(wide))
    flows = ("revenue", "cogs", "gross_profit", "operating_profit", "profit_before_tax", "income_tax", "net_income", "net_income_parent", "interest_expense", "depreciation", "cfo", "capex", "dividends_paid", "provision_expense")
    expenses = ("cogs", "interest_expense", "depreciation", "income_tax", "capex", "dividends_paid", "provision_expense")
    d = d.withColumns({f"t_{x}": flow(F.abs(c(x)) if x in expenses else c(x)) for x in flows})
    debt = F.when(c("short_term_debt").isNotNull() | c("long_term_debt").isNotNull(), zero("short_term_debt") + zero("long_term_debt"))
    d = d.withColumns({
        "debt": debt, "liabilities": F.coalesce(c("total_liabilities"), c("total_assets") - c("equity")), "ebit": c("t_profit_before_tax") + zero("t_interest_expense"),
        "t_gross_profit": F.coalesce(c("t_gross_profit"), c("t_revenue") - c("t_cogs")), "ni_parent": F.coalesce("t_net_income_parent", "t_net_income"), "ni": F.coalesce("t_net_income", "t_net_income_parent"),
        "equity_parent": c("equity") - zero("minority_interest"), "shares": shares(), "liquid": zero("cash") + zero("short_term_investments"),
    })
    d = d.withColumns({"ebitda": c("ebit") + c("t_depreciation"), "invested": c("equity") + c("debt") - c("liquid"), "eps_period": div(F.coalesce("net_income_parent", "net_income"), c("shares"))})
    return d.withColumns({f"a_{x}": average(c(x)) for x in ("equity", "equity_parent", "total_assets", "inventory", "receivables", "payables", "invested")})


def ratios(wide: DataFrame) -> DataFrame:
    """Profitability, liquidity, leverage, efficiency, growth, cash-flow, per-share and bank ratios of every symbol and period, years and quarters alike."""
    c, d = F.col, prepared(wide)
    pct = lambda a, b: div(a, b) * 100
    industrial = lambda x: F.when(~c("is_bank"), x)
    bank = lambda x: F.when(c("is_bank"), x)
    rate = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(0.5), div(c("t_income_tax"), c("t_profit_before_tax")))), F.lit(0.2))
    grown = {"revenue_growth": "revenue", "net_income_growth": "net_income", "eps_growth": "eps_period", "equity_growth": "equity", "total_assets_growth": "total_assets"}
    growth = {k: pct(c(x) - year_ago(c(x)), F.abs(year_ago(c(x)))) for k, x in grown.items()}
    fcf, rev = c("t_cfo") - c("t_capex"), c("t_revenue")
    dio, dso, dpo = div(365 * c("a_inventory"), c("t_cogs")), div(365 * c("a_receivables"), rev), div(365 * c("a_payables"), c("t_cogs"))
    out = {
        "gross_margin": industrial(pct(c("t_gross_profit"), rev)), "operating_margin": pct(c("t_operating_profit"), rev), "ebitda_margin": industrial(pct(c("ebitda"), rev)), "net_margin": pct(c("ni"), rev),
        "roe": pct(c("ni_parent"), c("a_equity_parent")), "roa": pct(c("ni"), c("a_total_assets")), "roic": industrial(pct(c("ebit") * (1 - rate), c("a_invested"))),
        "current_ratio": div(c("current_assets"), c("current_liabilities")), "quick_ratio": div(c("current_assets") - F.coalesce("inventory", F.lit(0.0)), c("current_liabilities")),
        "cash_ratio": div(c("cash") + F.coalesce("short_term_investments", F.lit(0.0)), c("current_liabilities")), "debt_equity": div(c("debt"), c("equity")), "liabilities_equity": div(c("liabilities"), c("equity")),
        "liabilities_assets": pct(c("liabilities"), c("total_assets")), "net_debt_ebitda": industrial(div(c("debt") - c("liquid"), c("ebitda"))), "interest_cover": industrial(div(c("ebit"), c("t_interest_expense"))),
        "equity_multiplier": div(c("a_total_assets"), c("a_equity")), "asset_turnover": div(rev, c("a_total_assets")), "inventory_turnover": div(c("t_cogs"), c("a_inventory")), "dio": dio, "dso": dso, "dpo": dpo, "ccc": dio + dso - dpo,
        **growth, "fcf": fcf, "cfo_to_income": div(c("t_cfo"), c("ni")), "fcf_margin": pct(fcf, rev), "capex_revenue": pct(c("t_capex"), rev), "payout": pct(c("t_dividends_paid"), c("ni_parent")),
        "eps": div(c("ni_parent"), c("shares")), "bvps": div(c("equity_parent"), c("shares")), "dps": div(c("t_dividends_paid"), c("shares")),
        "loan_deposit": bank(pct(c("customer_loans"), c("customer_deposits"))), "equity_assets": bank(pct(c("equity"), c("total_assets"))), "provision_income": bank(pct(c("t_provision_expense"), rev)),
    }
    return d.select("symbol", "period_key", *[v.alias(k) for k, v in out.items()])


def newest(df: DataFrame, order: str = "period_key") -> DataFrame:
    """Each symbol's last row."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def valuation(wide: DataFrame, prices: DataFrame) -> DataFrame:
    """Market value and multiples of each symbol with a price (symbol, price), from its last period with earnings or book value a share; null multiples of amounts that are not positive."""
    c, positive = F.col, lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0)))
    known = F.last("shares", ignorenulls=True).over(_key().rowsBetween(Window.unboundedPreceding, 0))
    d = prepared(wide).withColumn("sh", known).select("symbol", "period_key", "sh", "t_revenue", "ebitda", "liquid", "minority_interest", "debt")
    r = newest(ratios(wide).select("symbol", "period_key", "eps", "bvps", "dps").where("eps is not null or bvps is not null"))
    v = r.join(d, ["symbol", "period_key"]).join(prices, "symbol").where("sh is not null and price <> 0")
    v = v.withColumn("market_cap", c("price") * c("sh")).withColumn("enterprise_value", c("market_cap") + F.coalesce("debt", F.lit(0.0)) - c("liquid") + F.coalesce("minority_interest", F.lit(0.0)))
    return v.select(
        "symbol", "period_key", "price", "market_cap", "enterprise_value", positive(c("price"), c("eps")).alias("pe"), positive(c("price"), c("bvps")).alias("pb"), positive(c("market_cap"), c("t_revenue")).alias("ps"),
        positive(c("enterprise_value"), c("ebitda")).alias("ev_ebitda"), (c("eps") / c("price") * 100).alias("earnings_yield"), F.when(c("dps") > 0, c("dps") / c("price") * 100).alias("dividend_yield"),
    )


def growth_vs_prior(wide: DataFrame, item: str) -> DataFrame:
    """Growth in percent of each symbol's last non-null value against the year before, else against the row before, and which of them it was."""
    d = wide.select("symbol", "period_key", F.col(item).alias("v")).where("v is not null")
    d = newest(d.withColumns({"year": year_ago(F.col("v")), "row": F.lag("v").over(_key())}))
    prior = F.coalesce("year", "row")
    basis = F.when(F.col("year").isNotNull(), "year").when(F.col("row").isNotNull(), "period")
    return d.select("symbol", "period_key", (div(F.col("v") - prior, F.abs(prior)) * 100).alias("growth"), basis.alias("basis"))


def warnings(wide: DataFrame) -> DataFrame:
    """Each symbol's last ratios with what is odd about them, joined by commas: profit falls while revenue grows, high debt, cash outflow.

    Growth is that of growth_vs_prior(), of parent's net income where a symbol has any and of operating income where it has no revenue. Debt to equity falls
    back on liabilities to equity. Cash flow is the last that is known, an amount of its own period.
    """
    c, d = F.col, with_items(wide)
    first_known = lambda x, y: F.when(F.max(c(x).isNotNull()).over(Window.partitionBy("symbol")), c(x)).otherwise(c(y))
    d = d.withColumns({"_sales": first_known("revenue", "total_operating_income"), "_profit": first_known("net_income_parent", "net_income")})
    grown = lambda x, name: growth_vs_prior(d, x).select("symbol", F.col("growth").alias(name))
    last = newest(ratios(wide)).select("symbol", "period_key", F.coalesce("debt_equity", "liabilities_equity").alias("debt_equity"))
    cash = newest(d.where("cfo is not null")).select("symbol", c("cfo").alias("last_cfo"))
    both = last.join(grown("_sales", "revenue_growth"), "symbol", "left").join(grown("_profit", "net_income_growth"), "symbol", "left").join(cash, "symbol", "left")
    odd = F.array_compact(F.array(
        F.when((c("revenue_growth") > 5) & (c("net_income_growth") < -5), F.lit("profit falls")), F.when(c("debt_equity") > 2, F.lit("high debt")), F.when(c("last_cfo") < 0, F.lit("cash outflow")),
    ))
    return both.select("symbol", "period_key", "revenue_growth", "net_income_growth", "debt_equity", "last_cfo", F.array_join(odd, ",").alias("warnings"))


def summary(wide: DataFrame, prices: DataFrame, years: DataFrame) -> DataFrame:
    """One row a symbol: last ratios, multiples and, of its yearly rows, F-score, Z-score and growth of revenue over three years."""
    r = newest(ratios(wide)).select("symbol", "roe", "net_margin", "debt_equity")
    v = valuation(wide, prices).select("symbol", "pe", "pb")
    return r.join(v, "symbol", "left").join(f_score(years).select("symbol", "f_score"), "symbol", "left").join(z_score(years).select("symbol", "zone"), "symbol", "left").join(cagr(years, "revenue"), "symbol", "left")


def table_by_period(r: DataFrame, columns: list[str], last: int = 6) -> DataFrame:
    """(symbol, item, rank 1.. from the newest, period label, value): a table of items by the last periods, in long form."""
    long = r.unpivot(["symbol", "period_key"], columns, "item", "value").where("value is not null")
    w = Window.partitionBy("symbol").orderBy(F.desc("period_key"))
    return long.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= last)


def ratio_rows(r: DataFrame, meta: DataFrame, last: int = 6) -> DataFrame:
    """table_by_period() with what meta (item, ordinal, group, label, format) says of each ratio, in its order; ratios that it lacks are left out. meta is a few dozen rows."""
    items = [c for c in r.columns if c not in ("symbol", "period_key")]
    return table_by_period(r, items, last).join(F.broadcast(meta), "item").select("symbol", "ordinal", "group", "label", "format", "item", "period_key", "rank", "value")


def trim(wide: DataFrame, years: int) -> DataFrame:
    """The last rows of each symbol: so many years, or four times as many quarters."""
    quarter = F.avg((F.col("period_key") % 10 > 0).cast("int")).over(Window.partitionBy("symbol")) > 0.5
    d = wide.withColumns({"_rn": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_key"))), "_q": quarter})
    return d.where(F.col("_rn") <= F.when(F.col("_q"), 4 * years).otherwise(years)).drop("_rn", "_q")


def align(years: DataFrame, quarters: DataFrame) -> DataFrame:
    """Cells (symbol, period_key, item, value) of years, filled where null or absent with the year's last quarter that has a value."""
    last = quarters.where("value is not null and period_key % 10 > 0").groupBy("symbol", (F.floor(F.col("period_key") / 10) * 10).cast("int").alias("period_key"), "item").agg(F.max_by("value", "period_key").alias("q"))
    both = years.join(last, ["symbol", "period_key", "item"], "full")
    return both.select("symbol", "period_key", "item", F.coalesce("value", "q").alias("value"))


def align_quarters(quarters: DataFrame, years: DataFrame) -> DataFrame:
    """Cells (symbol, period_key, item, value) of quarters; balances of fourth quarters that are null or absent are those of the year. Only balances are to be given: flows of a year are no quarter's."""
    q = quarters.where("period_key % 10 > 0")
    y = years.where("period_key % 10 = 0").select("symbol", (F.col("period_key") + 4).alias("period_key"), "item", F.col("value").alias("y"))
    return q.join(y, ["symbol", "period_key", "item"], "full").select("symbol", "period_key", "item", F.coalesce("value", "y").alias("value"))


def dupont(r: DataFrame) -> DataFrame:
    """Return on equity as margin, turnover and leverage."""
    return r.select("symbol", "period_key", "net_margin", "asset_turnover", div(F.col("roe"), F.col("net_margin") * F.col("asset_turnover")).alias("leverage"), "roe")


def annual(wide: DataFrame, flows: tuple[str, ...]) -> DataFrame:
    """Years from quarters: sums of flows over four quarters, last quarter's balances; years of other than four quarters are left out."""
    balances = [x for x in wide.columns if x not in ("symbol", "period_key", *flows)]
    g = wide.groupBy("symbol", F.expr("period_key div 10").alias("year")).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in flows], *[F.max_by(x, "period_key").alias(x) for x in balances])
    return g.where("n = 4").drop("n")


def yearly_rows(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("period_key") % 10 == 0)


def f_score(wide: DataFrame) -> DataFrame:
    """Nine-test score of the last yearly row against the one before; a test without its inputs counts neither as passed nor in the maximum.

    A symbol with one year has no score and a maximum of 0. Gross margin is gross profit, or revenue less costs, over revenue, and no bank's; shares are as in shares().
    """
    c, w = F.col, _key()
    d = yearly_rows(with_items(wide)).withColumns({"sh": shares(), "gp": F.when(~c("is_bank"), F.coalesce("gross_profit", c("revenue") - F.abs("cogs")))})
    d = d.withColumns({"roa": div(c("net_income"), c("total_assets")), "lev": div(c("long_term_debt"), c("total_assets")), "cur": div(c("current_assets"), c("current_liabilities")), "gm": div(c("gp"), c("revenue")), "turn": div(F.nullif(c("revenue"), F.lit(0.0)), c("total_assets"))})
    d = d.withColumns({f"p_{x}": F.lag(x).over(w) for x in ("roa", "lev", "cur", "gm", "turn", "sh")} | {"rows": F.count("*").over(Window.partitionBy("symbol"))})
    d = newest(d)
    tests = [c("roa") > 0, c("cfo") > 0, c("roa") > c("p_roa"), c("cfo") > c("net_income"), c("lev") <= c("p_lev"), c("cur") > c("p_cur"), c("sh") <= c("p_sh") * 1.001, c("gm") > c("p_gm"), c("turn") > c("p_turn")]
    passed, known = sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0)), sum((t.isNotNull().cast("int") for t in tests), F.lit(0))
    d = d.select("symbol", "period_key", passed.alias("passed"), F.when(c("rows") >= 2, known).otherwise(0).alias("f_max"))
    score = F.when(c("f_max") > 0, c("passed"))
    return d.select("symbol", "period_key", score.alias("f_score"), "f_max", F.when(score >= 7, "strong").when(score >= 4, "average").when(score.isNotNull(), "weak").alias("label"))


def z_score(wide: DataFrame) -> DataFrame:
    """Altman's Z'' for emerging markets, on the last yearly row, or the last row of a symbol without years; null for banks and where an input is missing."""
    c = F.col
    d = with_items(wide).withColumn("years", F.max(c("period_key") % 10 == 0).over(Window.partitionBy("symbol")))
    d = newest(d.where(~c("years") | (c("period_key") % 10 == 0)))
    ta = F.nullif(c("total_assets"), F.lit(0.0))
    tl = F.coalesce(F.nullif(c("total_liabilities"), F.lit(0.0)), ta - c("equity"))
    ebit = c("profit_before_tax") + F.coalesce(F.abs(c("interest_expense")), F.lit(0.0))
    z = 3.25 + 6.56 * (c("current_assets") - c("current_liabilities")) / ta + 3.26 * c("retained_earnings") / ta + 6.72 * ebit / ta + 1.05 * div(c("equity"), tl)
    z = F.when(~c("is_bank"), z)
    return d.select("symbol", "period_key", z.alias("z"), F.when(z > 5.85, "safe").when(z >= 4.35, "grey").when(z.isNotNull(), "distress").alias("zone"))


def cagr(wide: DataFrame, item: str, n: int = 3) -> DataFrame:
    """Compound growth of a symbol's last yearly value over that n values back, nulls left out before they are counted; null unless both are positive."""
    d = yearly_rows(wide).where(F.col(item).isNotNull()).withColumn("old", F.lag(item, n).over(_key()))
    d = newest(d).select("symbol", F.when((F.col("old") > 0) & (F.col(item) > 0), (F.pow(F.col(item) / F.col("old"), F.lit(1.0 / n)) - 1) * 100).alias("cagr"))
    return wide.select("symbol").distinct().join(d, "symbol", "left")
