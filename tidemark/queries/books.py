"""Statements, text, sources and state, keyed by operator."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import statements as fr
from tidemark.plans.bars import STATEMENTS_SQL, statements, table

QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


T4 = "OVER (PARTITION BY symbol ORDER BY qi RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)"
Y1 = "OVER (PARTITION BY symbol ORDER BY period_key RANGE BETWEEN 10 PRECEDING AND 10 PRECEDING)"
_POSITIVE = ("cogs", "interest_expense", "depreciation", "income_tax", "capex", "dividends_paid", "provision_expense")
_SUMMED = ("revenue", "cogs", "gross_profit", "operating_profit", "profit_before_tax", "income_tax", "net_income", "net_income_parent", "interest_expense", "depreciation", "cfo", "capex", "dividends_paid", "provision_expense")
#: Items that some queries add to the statements: (Spark, SQL).
MORE = {
    "payables": "short_term_debt * 0.4D", "dividends_paid": "net_income * -0.3D", "minority_interest": "equity * 0.05D", "short_term_investments": "cash * 0.1D", "net_income_parent": "case when period_key % 3 = 0 then net_income * 0.9D end",
    "customer_deposits": "case when length(symbol) % 2 = 0 then equity * 0.8D end", "customer_loans": "case when length(symbol) % 2 = 0 then equity * 0.6D end", "provision_expense": "revenue * -0.02D", "total_liabilities": "case when period_key % 2 = 0 then total_assets * 0.45D end",
}


def more(wide):
    return wide.withColumns({k: F.expr(v) for k, v in MORE.items()})


def prepared_sql(head: str = STATEMENTS_SQL, source: str = "fin", extra: bool = False, yearly: bool = False) -> str:
    """Common table expressions up to p, of which each row has what the ratios need; yearly rows take amounts as they are."""
    lacking = [*MORE, "gross_profit", "net_interest_income", "charter_capital"]
    items = ", ".join(f"{re.sub(r'([0-9])D', r'\1::DOUBLE', MORE[x])} AS {x}" if extra and x in MORE else f"NULL::DOUBLE AS {x}" for x in lacking)
    raw = lambda x: f"abs({x})" if x in _POSITIVE else x
    flows = ", ".join(f"{raw(x)} AS t_{x}" if yearly else f"CASE WHEN count({x}) {T4}=4 THEN sum({raw(x)}) {T4} END AS t_{x}" for x in _SUMMED)
    means = ", ".join(f"({x}+first_value({x}) {Y1})/2 AS a_{x}" for x in ("equity", "equity_parent", "total_assets", "inventory", "receivables", "payables", "invested"))
    ago = ", ".join(f"first_value({x}) {Y1} AS y_{x}" for x in ("revenue", "net_income", "equity", "total_assets", "eps_period"))
    return f"""WITH {head}, x0 AS (SELECT *, {items} FROM {source}),
q AS (SELECT *, (period_key//10)*4+period_key%10 AS qi, max(customer_deposits IS NOT NULL) OVER (PARTITION BY symbol) AS bank, CASE WHEN short_term_debt IS NOT NULL OR long_term_debt IS NOT NULL THEN coalesce(short_term_debt,0)+coalesce(long_term_debt,0) END AS debt,
 coalesce(total_liabilities, total_assets-equity) AS liabilities, equity-coalesce(minority_interest,0) AS equity_parent, coalesce(cash,0)+coalesce(short_term_investments,0) AS liquid, CASE WHEN shares_outstanding>0 THEN shares_outstanding ELSE charter_capital/10000 END AS shares FROM x0),
i AS (SELECT *, equity+debt-liquid AS invested, coalesce(net_income_parent, net_income)/nullif(shares,0) AS eps_period FROM q), t AS (SELECT *, {flows}, {means}, {ago} FROM i),
p AS (SELECT * REPLACE (coalesce(t_gross_profit, t_revenue-t_cogs) AS t_gross_profit), coalesce(t_net_income_parent, t_net_income) AS ni_parent, coalesce(t_net_income, t_net_income_parent) AS ni, t_profit_before_tax+coalesce(t_interest_expense,0) AS ebit, t_profit_before_tax+coalesce(t_interest_expense,0)+t_depreciation AS ebitda,
 coalesce(greatest(0,least(0.5::DOUBLE,t_income_tax/nullif(t_profit_before_tax,0))),0.2::DOUBLE) AS rate FROM t)"""


PREPARED = prepared_sql()
_IND, _BANK = "CASE WHEN NOT bank THEN {} END".format, "CASE WHEN bank THEN {} END".format
RATIOS = {
    "gross_margin": _IND("t_gross_profit/nullif(t_revenue,0)*100"), "operating_margin": "t_operating_profit/nullif(t_revenue,0)*100", "ebitda_margin": _IND("ebitda/nullif(t_revenue,0)*100"), "net_margin": "ni/nullif(t_revenue,0)*100",
    "roe": "ni_parent/nullif(a_equity_parent,0)*100", "roa": "ni/nullif(a_total_assets,0)*100", "roic": _IND("ebit*(1-rate)/nullif(a_invested,0)*100"), "current_ratio": "current_assets/nullif(current_liabilities,0)",
    "quick_ratio": "(current_assets-coalesce(inventory,0))/nullif(current_liabilities,0)", "cash_ratio": "(cash+coalesce(short_term_investments,0))/nullif(current_liabilities,0)", "debt_equity": "debt/nullif(equity,0)", "liabilities_equity": "liabilities/nullif(equity,0)",
    "liabilities_assets": "liabilities/nullif(total_assets,0)*100", "net_debt_ebitda": _IND("(debt-liquid)/nullif(ebitda,0)"), "interest_cover": _IND("ebit/nullif(t_interest_expense,0)"), "equity_multiplier": "a_total_assets/nullif(a_equity,0)",
    "asset_turnover": "t_revenue/nullif(a_total_assets,0)", "inventory_turnover": "t_cogs/nullif(a_inventory,0)", "dio": "365*a_inventory/nullif(t_cogs,0)", "dso": "365*a_receivables/nullif(t_revenue,0)", "dpo": "365*a_payables/nullif(t_cogs,0)",
    "ccc": "365*a_inventory/nullif(t_cogs,0)+365*a_receivables/nullif(t_revenue,0)-365*a_payables/nullif(t_cogs,0)",
    "revenue_growth": "(revenue-y_revenue)/nullif(abs(y_revenue),0)*100", "net_income_growth": "(net_income-y_net_income)/nullif(abs(y_net_income),0)*100", "eps_growth": "(eps_period-y_eps_period)/nullif(abs(y_eps_period),0)*100", "equity_growth": "(equity-y_equity)/nullif(abs(y_equity),0)*100", "total_assets_growth": "(total_assets-y_total_assets)/nullif(abs(y_total_assets),0)*100",
    "fcf": "t_cfo-t_capex", "cfo_to_income": "t_cfo/nullif(ni,0)", "fcf_margin": "(t_cfo-t_capex)/nullif(t_revenue,0)*100", "capex_revenue": "t_capex/nullif(t_revenue,0)*100", "payout": "t_dividends_paid/nullif(ni_parent,0)*100",
    "eps": "ni_parent/nullif(shares,0)", "bvps": "equity_parent/nullif(shares,0)", "dps": "t_dividends_paid/nullif(shares,0)",
    "loan_deposit": _BANK("customer_loans/nullif(customer_deposits,0)*100"), "equity_assets": _BANK("equity/nullif(total_assets,0)*100"), "provision_income": _BANK("t_provision_expense/nullif(t_revenue,0)*100"),
}


def rounded(df, keys, digits=3):
    return df.select(*keys, *[F.round(c, 5 if c == "fcf" else digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


def ratio_sql(prepared: str) -> str:
    return f"{prepared} SELECT symbol, period_key, " + ", ".join(f"round({v},{5 if k == 'fcf' else 3}) AS {k}" for k, v in RATIOS.items()) + " FROM p"


add("FR_06_12_ratios", lambda s, d: rounded(fr.ratios(more(statements(s, d))), ["symbol", "period_key"]), ratio_sql(prepared_sql(extra=True)))
add("FR_02_JN_09_year_ago", lambda s, d: (x := statements(s, d)).select("symbol", "period_key", F.round("revenue", 5).alias("revenue"), F.round(fr.year_ago(F.col("revenue")), 5).alias("year_ago")), f"WITH {STATEMENTS_SQL} SELECT symbol, period_key, round(revenue,5) AS revenue, round(first_value(revenue) {Y1},5) AS year_ago FROM fin")
add("FR_03_ttm", lambda s, d: fr.with_quarters(statements(s, d)).select("symbol", "period_key", F.round(fr.ttm(F.col("revenue")), 5).alias("ttm")), f"WITH {STATEMENTS_SQL}, q AS (SELECT *, (period_key//10)*4+period_key%10 AS qi FROM fin) SELECT symbol, period_key, CASE WHEN count(revenue) {T4}=4 THEN round(sum(revenue) {T4},5) END AS ttm FROM q")
add("FR_18_dupont", lambda s, d: rounded(fr.dupont(fr.ratios(statements(s, d))), ["symbol", "period_key"]), f"{PREPARED}, r AS (SELECT symbol, period_key, {RATIOS['net_margin']} AS nm, {RATIOS['asset_turnover']} AS turnover, {RATIOS['roe']} AS roe FROM p) SELECT symbol, period_key, round(nm,3) AS net_margin, round(turnover,3) AS asset_turnover, round(roe/nullif(nm*turnover,0),3) AS leverage, round(roe,3) AS roe FROM r")
FLOWS = ("revenue", "cogs", "operating_profit", "profit_before_tax", "income_tax", "net_income", "interest_expense", "depreciation", "cfo", "capex")
STOCKS = ("total_assets", "equity", "current_assets", "current_liabilities", "inventory", "receivables", "cash", "short_term_debt", "long_term_debt", "shares_outstanding", "retained_earnings")
YEARS = f"WITH {STATEMENTS_SQL}, yr AS (SELECT symbol, period_key//10 AS year, " + ", ".join(f"sum({x}) AS {x}" for x in FLOWS) + ", " + ", ".join(f"max_by({x}, period_key) AS {x}" for x in STOCKS) + " FROM fin GROUP BY ALL HAVING count(*)=4)"
YEARLY = f"{YEARS[5:]}, fy AS (SELECT * EXCLUDE (year), (year*10)::INT AS period_key FROM yr)"


def yearly(s, d):
    return fr.annual(statements(s, d), FLOWS).withColumn("period_key", (F.col("year") * 10).cast("int")).drop("year")


add("FR_06_12_annual_ratios", lambda s, d: rounded(fr.ratios(more(yearly(s, d))), ["symbol", "period_key"]), ratio_sql(prepared_sql(YEARLY, "fy", True, True)))
#: The scores of yearly rows fy, whose gross profit, liabilities and bank marks x0 has.
F_TESTS = "[roa>0, cfo>0, roa>p1, cfo>net_income, lev<=p2, cur>p3, sh<=p6*1.001::DOUBLE, gm>p4, tn>p5]"
SCORES = f"""fa AS (SELECT *, CASE WHEN shares_outstanding>0 THEN shares_outstanding ELSE charter_capital/10000 END AS sh, net_income/nullif(total_assets,0) AS roa, long_term_debt/nullif(total_assets,0) AS lev, current_assets/nullif(current_liabilities,0) AS cur, revenue/nullif(total_assets,0) AS tn,
 CASE WHEN NOT max(customer_deposits IS NOT NULL) OVER (PARTITION BY symbol) THEN coalesce(gross_profit, revenue-abs(cogs))/nullif(revenue,0) END AS gm FROM x0),
 fb AS (SELECT *, lag(roa) OVER w AS p1, lag(lev) OVER w AS p2, lag(cur) OVER w AS p3, lag(gm) OVER w AS p4, lag(tn) OVER w AS p5, lag(sh) OVER w AS p6, count(*) OVER (PARTITION BY symbol) AS n FROM fa WINDOW w AS (PARTITION BY symbol ORDER BY period_key) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_key DESC) = 1),
 fs AS (SELECT symbol, period_key, CASE WHEN n>1 THEN len(list_filter({F_TESTS}, lambda x: x))::INT END AS f_score, CASE WHEN n>1 THEN len(list_filter({F_TESTS}, lambda x: x IS NOT NULL))::INT ELSE 0 END AS f_max,
 CASE WHEN customer_deposits IS NULL THEN 3.25::DOUBLE+6.56::DOUBLE*(current_assets-current_liabilities)/total_assets+3.26::DOUBLE*retained_earnings/total_assets+6.72::DOUBLE*(profit_before_tax+coalesce(abs(interest_expense),0))/total_assets+1.05::DOUBLE*equity/coalesce(nullif(total_liabilities,0), total_assets-equity) END AS z FROM fb)"""
SCORED = prepared_sql(YEARLY, "fy", True, True).split(",\nq AS")[0]
ZONE = "CASE WHEN z>5.85 THEN 'safe' WHEN z>=4.35 THEN 'grey' WHEN z IS NOT NULL THEN 'distress' END AS zone"


def odd_revenue(s, d):
    """Yearly rows, revenue null in every fourth year and, of some symbols, negative in the others before 1996."""
    return yearly(s, d).withColumn("revenue", F.expr("case when period_key % 40 = 0 then null when length(symbol) = 5 and period_key < 19960 then -revenue else revenue end"))


add("FR_19_f_score", lambda s, d: fr.f_score(more(yearly(s, d))), f"{SCORED}, {SCORES} SELECT symbol, period_key, f_score, f_max, CASE WHEN f_score>=7 THEN 'strong' WHEN f_score>=4 THEN 'average' WHEN f_score IS NOT NULL THEN 'weak' END AS label FROM fs")
add("FR_20_z_score", lambda s, d: rounded(fr.z_score(more(yearly(s, d))), ["symbol", "period_key"]), f"{SCORED}, {SCORES} SELECT symbol, period_key, round(z,3) AS z, {ZONE} FROM fs")
add("FR_16_cagr", lambda s, d: rounded(fr.cagr(odd_revenue(s, d), "revenue"), ["symbol"]),
    f"WITH {YEARLY}, o AS (SELECT symbol, period_key, CASE WHEN period_key % 40 = 0 THEN NULL WHEN length(symbol) = 5 AND period_key < 19960 THEN -revenue ELSE revenue END AS v FROM fy), a AS (SELECT symbol, period_key, v, lag(v,3) OVER (PARTITION BY symbol ORDER BY period_key) AS old FROM o WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_key DESC) = 1) SELECT symbol, CASE WHEN old>0 AND v>0 THEN round((pow(v/old,1.0::DOUBLE/3)-1)*100,3) END AS cagr FROM (SELECT DISTINCT symbol FROM fy) LEFT JOIN a USING (symbol)")
add("PR_05_06_periods", lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")).alias("label")).select("o_orderkey", tx.period_key(F.col("label")).alias("key"), tx.period_label(tx.period_key(F.col("label"))).alias("shown")),
    "SELECT o_orderkey, year(o_orderdate)::INT*10+quarter(o_orderdate)::INT AS key, 'Q'||quarter(o_orderdate)||'/'||year(o_orderdate) AS shown FROM orders")
add("PR_12_unpivot_pivot", lambda s, d: statements(s, d).unpivot(["symbol", "period_key"], ["revenue", "net_income", "equity", "long_term_debt"], "item", "value").where("value is not null").select("symbol", "period_key", "item", F.round("value", 5).alias("value")),
    f"WITH {STATEMENTS_SQL} SELECT symbol, period_key, item, round(value,5) AS value FROM (SELECT symbol, period_key, revenue, net_income, equity, long_term_debt FROM fin) UNPIVOT (value FOR item IN (revenue, net_income, equity, long_term_debt))")
POS, NEG = ["the", "bon", "licht"], ["worthless", "trash", "licensed"]
SENT = lambda c: "(" + "+".join(f"contains(lower({c}),'{x}')::INT" for x in POS) + "-" + "-".join(f"contains(lower({c}),'{x}')::INT" for x in NEG) + ")"
add("TX_05_AG_08_sentiment", lambda s, d: table(s, d, "documents").groupBy("lang", tx.sentiment(F.col("text"), POS, NEG).alias("sentiment")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")),
    f"SELECT lang, CASE WHEN {SENT('text')}>0 THEN 'positive' WHEN {SENT('text')}<0 THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY ALL")
add("TX_09_strip_tags", lambda s, d: table(s, d, "pages").select("page_id", F.length(tx.strip_tags(F.col("html"))).cast("long").alias("n"), F.md5(tx.strip_tags(F.col("html"))).alias("digest")),
    "SELECT page_id, length(t)::BIGINT AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html,'<[^>]+>',' ','g'),'\\s+',' ','g')) AS t FROM pages)")
add("SRC_10_links", lambda s, d: table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+[^>]*href="([^"]*)"'), 1)).alias("link")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("link").alias("distinct_links")),
    "SELECT page_id, count(*) AS links, count(DISTINCT link) AS distinct_links FROM (SELECT page_id, unnest(regexp_extract_all(html,'<a\\s+[^>]*href=\"([^\"]*)\"',1)) AS link FROM pages) GROUP BY page_id")


def upsert(s, d):
    """Last write wins: orders rewritten by a later fetch of those of 1996."""
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("fetched"))
    late = table(s, d, "orders").where(F.year("o_orderdate") == 1996).select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(2).alias("fetched"))
    both = o.unionByName(late).groupBy("o_orderkey").agg(F.max_by(F.struct("o_totalprice", "fetched"), "fetched").alias("x"))
    return both.select("o_orderkey", F.round("x.o_totalprice", 2).alias("price"), F.col("x.fetched").alias("fetched"))


add("SNK_01_upsert", upsert, "SELECT o_orderkey, round(CASE WHEN year(o_orderdate)=1996 THEN o_totalprice*2 ELSE o_totalprice END,2) AS price, CASE WHEN year(o_orderdate)=1996 THEN 2 ELSE 1 END AS fetched FROM orders")
add("SNK_06_news_window", lambda s, d: (e := table(s, d, "events")).join(F.broadcast(e.agg(F.max("ts").alias("asof"))), F.col("ts") >= F.col("asof") - F.make_dt_interval(F.lit(7))).select("event_id", "event_type").orderBy(F.desc("event_id")).limit(200),
    "SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY event_id DESC LIMIT 200")
add("AG_10_rollup", lambda s, d: table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))), 2).alias("size")),
    "SELECT r_name, n_name, count(*) AS n, round(sum(greatest(c_acctbal,0)),2) AS size FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ROLLUP(r_name,n_name)")


def daily_bars(s, d):
    from tidemark.streaming import jobs

    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value")
    return jobs.daily_bars(e).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


add("SS_01_daily_bars", daily_bars, "SELECT event_type AS symbol, date_trunc('day',ts)::TIMESTAMP AS ts, min_by(value,(ts,event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value,(ts,event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL")


def bad_bars(s, d):
    from tidemark.plans.bars import walk_bars

    b = walk_bars(s, d, "n_name")
    return b.groupBy("symbol").agg(F.count_if((F.col("high") < F.col("low")) | (F.col("close") > 1.2 * F.col("high")) | (F.col("close") < 0.8 * F.col("low"))).alias("bad"), F.count("*").alias("n"))


from tidemark.plans.bars import bars_sql  # noqa: E402

add("PR_01_bad_bars", bad_bars, f"WITH {bars_sql('n_name')} SELECT symbol, count(*) FILTER (high<low OR close>1.2::DOUBLE*high OR close<0.8::DOUBLE*low) AS bad, count(*) AS n FROM bars GROUP BY symbol")
