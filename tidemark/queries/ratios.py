"""Statement tables, valuation, growth and warnings, keyed by operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import statements as fr
from tidemark.plans.bars import STATEMENTS_SQL, statements, walk_bars
from tidemark.queries.books import RATIOS, SCORED, SCORES, T4, Y1, YEARS, ZONE, more, prepared_sql, rounded, yearly
from tidemark.queries.market import NATION_BARS

QUERIES, ORACLE = {}, {}


def add(name, query, sql):
    QUERIES[name], ORACLE[name] = query, sql


EXTRA = prepared_sql(extra=True)
ONLY_BARS = NATION_BARS[NATION_BARS.index("day0 AS") :]
PRICED = f"{EXTRA}, {ONLY_BARS}, pr AS (SELECT symbol, max_by(close, ts) AS price FROM bars GROUP BY symbol)"
R = ", ".join(f"{v} AS r_{k}" for k, v in RATIOS.items())
LAST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_key DESC) = 1"


def prices(s, d):
    return walk_bars(s, d, "n_name").groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))


def mixed_kinds(s, d):
    """Years of the symbols up to F, quarters of the others."""
    q, y = more(statements(s, d)), more(yearly(s, d))
    return q.where("symbol > 'F'").unionByName(y.where("symbol <= 'F'"), allowMissingColumns=True)


add("FR_04_kinds", lambda s, d: fr.kinds(mixed_kinds(s, d)),
    f"WITH {STATEMENTS_SQL} SELECT DISTINCT symbol, CASE WHEN symbol > 'F' THEN 'quarter' ELSE 'year' END AS period, length(symbol) % 2 = 0 AS is_bank FROM fin WHERE symbol > 'F' OR symbol IN (SELECT symbol FROM fin GROUP BY symbol, period_key//10 HAVING count(*) = 4)")
add("FR_05_shares", lambda s, d: statements(s, d).withColumn("charter_capital", F.col("equity") / 3).withColumn("shares_outstanding", F.expr("case when period_key % 2 = 0 then shares_outstanding end")).select("symbol", "period_key", F.round(fr.shares(), 2).alias("shares")),
    f"WITH {STATEMENTS_SQL} SELECT symbol, period_key, round(CASE WHEN period_key % 2 = 0 AND shares_outstanding > 0 THEN shares_outstanding ELSE equity/3/10000 END, 2) AS shares FROM fin")
add("FR_13_bank_ratios", lambda s, d: rounded(fr.ratios(more(statements(s, d)).drop("revenue").withColumn("total_operating_income", F.col("net_income") * 4)).select("symbol", "period_key", "net_margin", "gross_margin", "loan_deposit", "equity_assets"), ["symbol", "period_key"]),
    f"WITH {STATEMENTS_SQL}, x AS (SELECT *, length(symbol) % 2 = 0 AS bank, CASE WHEN length(symbol) % 2 = 0 THEN net_income*4 END AS rev FROM fin), y AS (SELECT *, (period_key//10)*4+period_key%10 AS qi FROM x) SELECT symbol, period_key, round(CASE WHEN count(rev) {T4}=4 AND count(net_income) {T4}=4 THEN sum(net_income) {T4}/nullif(sum(rev) {T4},0)*100 END, 3) AS net_margin, NULL::DOUBLE AS gross_margin, round(CASE WHEN bank THEN 75.0::DOUBLE END, 3) AS loan_deposit, round(CASE WHEN bank THEN equity/total_assets*100 END, 3) AS equity_assets FROM y")
TABLE = ("net_margin", "roe", "current_ratio", "debt_equity")
add("FR_15_ratio_table", lambda s, d: fr.table_by_period(fr.ratios(more(statements(s, d))), list(TABLE)).select("symbol", "item", "period_key", "rank", F.round("value", 3).alias("value")),
    f"{EXTRA}, r AS (SELECT symbol, period_key, {', '.join(f'{RATIOS[k]} AS {k}' for k in TABLE)} FROM p), u AS (SELECT * FROM r UNPIVOT (value FOR item IN ({', '.join(TABLE)}))), k AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY period_key DESC)::INT AS rank FROM u) SELECT symbol, item, period_key, rank, round(value, 3) AS value FROM k WHERE rank <= 6")
VAL = ("price", "market_cap", "enterprise_value", "pe", "pb", "ps", "ev_ebitda", "earnings_yield", "dividend_yield")
add("FR_17_valuation", lambda s, d: fr.valuation(more(statements(s, d)), prices(s, d)).select("symbol", "period_key", *[F.round(c, 4).alias(c) for c in VAL]),
    f"""{PRICED}, l AS (SELECT *, {R} FROM p), v AS (SELECT l.*, price, price*last_value(shares IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY period_key) AS mc FROM l JOIN pr USING (symbol)), w AS (SELECT *, mc+coalesce(debt,0)-liquid+coalesce(minority_interest,0) AS ev FROM v WHERE r_eps IS NOT NULL OR r_bvps IS NOT NULL {LAST})
 SELECT symbol, period_key, round(price,4) AS price, round(mc,4) AS market_cap, round(ev,4) AS enterprise_value, round(CASE WHEN r_eps>0 THEN price/r_eps END,4) AS pe, round(CASE WHEN r_bvps>0 THEN price/r_bvps END,4) AS pb, round(CASE WHEN t_revenue>0 THEN mc/t_revenue END,4) AS ps, round(CASE WHEN ebitda>0 THEN ev/ebitda END,4) AS ev_ebitda, round(r_eps/price*100,4) AS earnings_yield, round(CASE WHEN r_dps>0 THEN r_dps/price*100 END,4) AS dividend_yield FROM w""")
add("FR_22_growth_vs_prior", lambda s, d: fr.growth_vs_prior(statements(s, d).where("symbol > 'J' or period_key % 10 > 2"), "revenue").withColumn("growth", F.round("growth", 4)),
    f"WITH {STATEMENTS_SQL}, x AS (SELECT symbol, period_key, revenue, first_value(revenue) {Y1} AS y, lag(revenue) OVER (PARTITION BY symbol ORDER BY period_key) AS l FROM fin WHERE symbol > 'J' OR period_key % 10 > 2), z AS (SELECT *, coalesce(y, l) AS b FROM x {LAST}) SELECT symbol, period_key, round((revenue-b)/nullif(abs(b),0)*100,4) AS growth, CASE WHEN y IS NOT NULL THEN 'year' WHEN l IS NOT NULL THEN 'period' END AS basis FROM z")
def some_without(s, d):
    """Statements with losses and outflows; some symbols lack debt, or the parent's share of profit."""
    return more(statements(s, d)).withColumns({
        "cfo": F.expr("case when length(symbol) % 3 = 0 then -cfo when period_key % 10 < 4 then cfo end"), "net_income_parent": F.expr("case when length(symbol) > 6 then net_income * 0.9D - case when period_key % 10 > 2 then revenue * 0.4D else 0D end end"),
        "short_term_debt": F.expr("case when length(symbol) % 2 = 0 then short_term_debt * 9D end"), "long_term_debt": F.expr("case when length(symbol) % 2 = 0 then long_term_debt end"), "equity": F.expr("case when length(symbol) = 7 then equity / 4 else equity end"),
    })


WITHOUT = f"""{STATEMENTS_SQL}, sm AS (SELECT * REPLACE (CASE WHEN length(symbol) % 3 = 0 THEN -cfo WHEN period_key % 10 < 4 THEN cfo END AS cfo, CASE WHEN length(symbol) % 2 = 0 THEN short_term_debt * 9 END AS short_term_debt, CASE WHEN length(symbol) % 2 = 0 THEN long_term_debt END AS long_term_debt, CASE WHEN length(symbol) = 7 THEN equity / 4 ELSE equity END AS equity),
 CASE WHEN length(symbol) > 6 THEN net_income * 0.9::DOUBLE - CASE WHEN period_key % 10 > 2 THEN revenue * 0.4::DOUBLE ELSE 0 END END AS parent, CASE WHEN period_key % 2 = 0 THEN total_assets * 0.45::DOUBLE END AS total_liabilities FROM fin)"""
GROWN = "(SELECT symbol, (v - coalesce(y, l)) / nullif(abs(coalesce(y, l)), 0) * 100 AS growth FROM (SELECT symbol, period_key, v, first_value(v) {y1} AS y, lag(v) OVER (PARTITION BY symbol ORDER BY period_key) AS l FROM (SELECT symbol, period_key, {item} AS v FROM sm) WHERE v IS NOT NULL {last}))"
add("FR_24_warnings", lambda s, d: fr.warnings(some_without(s, d)).select("symbol", "period_key", *[F.round(c, 3).alias(c) for c in ("revenue_growth", "net_income_growth", "debt_equity")], F.round("last_cfo", 2).alias("last_cfo"), "warnings"),
    f"""WITH {WITHOUT}, a AS {GROWN.format(y1=Y1, last=LAST, item="revenue")}, b AS {GROWN.format(y1=Y1, last=LAST, item="CASE WHEN length(symbol) > 6 THEN parent ELSE net_income END")}, c AS (SELECT symbol, cfo AS last_cfo FROM sm WHERE cfo IS NOT NULL {LAST}),
 e AS (SELECT symbol, period_key, coalesce((coalesce(short_term_debt,0)+coalesce(long_term_debt,0))*CASE WHEN short_term_debt IS NOT NULL OR long_term_debt IS NOT NULL THEN 1 END/nullif(equity,0), coalesce(total_liabilities, total_assets-equity)/nullif(equity,0)) AS de FROM sm {LAST})
 SELECT symbol, period_key, round(a.growth,3) AS revenue_growth, round(b.growth,3) AS net_income_growth, round(de,3) AS debt_equity, round(last_cfo,2) AS last_cfo, array_to_string(list_filter([CASE WHEN a.growth>5 AND b.growth < -5 THEN 'profit falls' END, CASE WHEN de>2 THEN 'high debt' END, CASE WHEN last_cfo<0 THEN 'cash outflow' END], lambda x: x IS NOT NULL), ',') AS warnings FROM e LEFT JOIN a USING (symbol) LEFT JOIN b USING (symbol) LEFT JOIN c USING (symbol)""")
add("FR_21_summary", lambda s, d: (x := fr.summary(more(statements(s, d)), prices(s, d), more(yearly(s, d)))).select("symbol", *[F.round(c, 3).alias(c) for c in ("roe", "net_margin", "debt_equity", "pe", "pb", "cagr")], "f_score", "zone"),
    f"""{PRICED}, l AS (SELECT *, {R} FROM p), z0 AS (SELECT * FROM l {LAST}), v AS (SELECT l.symbol, r_eps, r_bvps, price FROM l JOIN pr USING (symbol) WHERE (r_eps IS NOT NULL OR r_bvps IS NOT NULL) AND shares IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l.symbol ORDER BY period_key DESC) = 1),
 sc AS ({SCORED}, {SCORES} SELECT symbol, f_score, {ZONE} FROM fs),
 {YEARS[YEARS.index("yr AS"):]}, b AS (SELECT symbol, revenue, lag(revenue,3) OVER (PARTITION BY symbol ORDER BY year) AS old FROM yr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC) = 1),
 c AS (SELECT symbol, CASE WHEN old>0 AND revenue>0 THEN (pow(revenue/old,1.0::DOUBLE/3)-1)*100 END AS cagr FROM b)
 SELECT z0.symbol, round(r_roe,3) AS roe, round(r_net_margin,3) AS net_margin, round(r_debt_equity,3) AS debt_equity, round(CASE WHEN v.r_eps>0 THEN price/v.r_eps END,3) AS pe, round(CASE WHEN v.r_bvps>0 THEN price/v.r_bvps END,3) AS pb, round(cagr,3) AS cagr, f_score, zone FROM z0 LEFT JOIN v USING (symbol) LEFT JOIN c USING (symbol) LEFT JOIN sc USING (symbol)""")
add("FR_26_income_table", lambda s, d: fr.table_by_period(statements(s, d).withColumn("margin", F.try_divide(F.col("net_income"), F.col("revenue")) * 100), ["revenue", "net_income", "margin"]).select("symbol", "item", "rank", F.round(F.col("value") / 1000, 3).alias("value")),
    f"WITH {STATEMENTS_SQL}, u AS (SELECT * FROM (SELECT symbol, period_key, revenue, net_income, net_income/nullif(revenue,0)*100 AS margin FROM fin) UNPIVOT (value FOR item IN (revenue, net_income, margin))), k AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY period_key DESC)::INT AS rank FROM u) SELECT symbol, item, rank, round(value/1000,3) AS value FROM k WHERE rank <= 6")
add("PR_14_trim", lambda s, d: fr.trim(mixed_kinds(s, d), 2).select("symbol", "period_key"),
    f"{YEARS}, m AS (SELECT symbol, period_key FROM fin WHERE symbol > 'F' UNION ALL SELECT symbol, (year*10)::INT FROM yr WHERE symbol <= 'F') SELECT symbol, period_key FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_key DESC) <= CASE WHEN symbol > 'F' THEN 8 ELSE 2 END")


def cells(df, items=("revenue", "equity", "receivables")):
    return df.unpivot(["symbol", "period_key"], list(items), "item", "value")


add("PR_13_align", lambda s, d: fr.align(cells(yearly(s, d)).withColumn("value", F.expr("case when period_key % 20 = 0 then null else value end")), cells(statements(s, d))).withColumn("value", F.round("value", 4)),
    f"{YEARS}, q AS (SELECT symbol, (period_key//10*10)::INT AS period_key, item, max_by(value, period_key) AS q FROM (SELECT symbol, period_key, revenue, equity, receivables FROM fin) UNPIVOT (value FOR item IN (revenue, equity, receivables)) GROUP BY ALL), y AS (SELECT symbol, (year*10)::INT AS period_key, item, CASE WHEN year % 2 = 0 THEN NULL ELSE value END AS value FROM (SELECT symbol, year, revenue, equity, receivables FROM yr) UNPIVOT INCLUDE NULLS (value FOR item IN (revenue, equity, receivables))) SELECT symbol, period_key, item, round(coalesce(value, q), 4) AS value FROM y FULL JOIN q USING (symbol, period_key, item)")
