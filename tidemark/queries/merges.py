"""Source merges, scores, fair values, peers and portfolios, keyed by operator."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import performance as px, scoring as sc, statements as fr
from tidemark.plans.bars import statements, table, walk_bars
from tidemark.queries.books import PREPARED, RATIOS
from tidemark.queries.market import BARS, NATION_BARS, STEPS
from tidemark.sources import merge as mg

QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def sources(s, d):
    """Recent bars from 2000 on, and older ones to ten days later, of which two symbols are on another price level."""
    bars = walk_bars(s, d)
    level = F.when(F.col("symbol").isin("ASIA", "EUROPE"), 0.5).otherwise(1.0)
    older = bars.where("ts < timestamp_ntz'2000-01-11'").select("symbol", "ts", *[(F.col(c) * level).alias(c) for c in mg.PRICES], "volume")
    return bars.where("ts >= timestamp_ntz'2000-01-01'"), older


def cells(s, d):
    """Statement cells of two sources: the first lacks current receivables and every even period of revenue."""
    q = statements(s, d).select("symbol", "period_key", F.expr("stack(3, 'revenue', revenue, 'equity', equity, 'receivables', receivables) as (item, value)"))
    a = q.select("symbol", "period_key", "item", F.expr("case when item = 'receivables' or (item = 'revenue' and period_key % 2 = 0) then null else value end").alias("value"), F.lit("A").alias("source"), F.lit(0).alias("priority"))
    return a.unionByName(q.withColumns({"value": F.col("value") * 2, "source": F.lit("B"), "priority": F.lit(1)}))


def with_priority(s, d):
    """Bars of source A without two symbols, and of source B with all."""
    bars = walk_bars(s, d).select("symbol", "ts", "close")
    a = bars.where("symbol not in ('ASIA', 'AFRICA')").withColumns({"source": F.lit("A"), "priority": F.lit(0)})
    return a.unionByName(bars.withColumns({"source": F.lit("B"), "priority": F.lit(1)}))


def payloads(s, d, nearest=False):
    """One JSON payload for each type of event and day, of its events as bars, their times in whole seconds: cut off, or those nearest (of two the even one)."""
    at = F.col("ts").cast("timestamp")
    second = F.rint(F.unix_micros(at) / 1e6).cast("long") if nearest else F.unix_timestamp(at)
    e = table(s, d, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), second.alias("t"), "value", "event_id")
    g = e.groupBy("symbol", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", "t", "value"))).alias("x"))  # a day's events of one type
    return g.select("symbol", F.to_json(F.struct(F.col("x.t").alias("t"), *[F.col("x.value").alias(c) for c in "ohlc"], F.col("x.event_id").alias("v"))).alias("payload"))


def metrics(s, d):
    """Last ratios of each nation with its last price; its region is the sector."""
    wide = statements(s, d)
    rows = fr.ratios(wide).join(wide.select("symbol", "period_key", "cfo", "net_income"), ["symbol", "period_key"])
    last = rows.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_key")))).where("rn = 1").drop("rn")
    price = walk_bars(s, d, "n_name").groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    where = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), F.col("n_nationkey").alias("place"))
    pe, pb = F.when(F.col("eps") > 0, F.col("price") / F.nullif("eps", F.lit(0.0))), F.when(F.col("bvps") > 0, F.col("price") / F.nullif("bvps", F.lit(0.0)))
    return last.join(price, "symbol").join(F.broadcast(where), "symbol").withColumns({"pe": pe, "pb": pb})


NEED = ("roe", "net_margin", "debt_equity", "revenue_growth", "eps", "bvps")
NATION_ONLY = NATION_BARS[NATION_BARS.index("day0 AS") :]
METRICS = f"""{PREPARED}, r AS (SELECT symbol, period_key, cfo, net_income, {", ".join(f"{RATIOS[k]} AS {k}" for k in NEED)} FROM p),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_key DESC) = 1), {NATION_ONLY}, pr AS (SELECT symbol, max_by(close, ts) AS price FROM bars GROUP BY symbol),
m AS (SELECT l.*, price, CASE WHEN eps > 0 THEN price/eps END AS pe, CASE WHEN bvps > 0 THEN price/bvps END AS pb, r_name AS sector, n_nationkey AS place
 FROM l JOIN pr USING (symbol) JOIN nation ON n_name = symbol JOIN region ON n_regionkey = r_regionkey),
pp AS (SELECT a.symbol, a.sector, b.pe, b.pb, b.roe, b.net_margin, b.debt_equity FROM m a JOIN m b ON a.sector = b.sector AND a.symbol <> b.symbol QUALIFY row_number() OVER (PARTITION BY a.symbol ORDER BY b.place, b.symbol) <= 8),
peers AS (SELECT symbol, sector, count(coalesce(pe, pb, roe, net_margin, debt_equity)) AS peers, {", ".join(f"count(*) FILTER ({c} > {lo} AND {c} < {hi}) AS n_{c}, CASE WHEN count(*) FILTER ({c} > {lo} AND {c} < {hi}) >= 3 THEN round_even(median({c}) FILTER ({c} > {lo} AND {c} < {hi}), 2) END AS peer_{c}" for c, (lo, hi) in sc.BOUNDS.items())} FROM pp GROUP BY ALL),
v AS (SELECT m.*, peer_pe, peer_pb FROM m LEFT JOIN peers USING (symbol))"""


def valued(s, d):
    m = metrics(s, d)
    return m.join(sc.peer_medians(m).select("symbol", "peer_pe", "peer_pb"), "symbol", "left")


def case(x, steps, way):
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} {way} {b} THEN {p}" for b, p in steps[0]) + f" ELSE {steps[1]} END"


def share_sql(parts):
    got, most = " + ".join(f"coalesce({p}, 0)" for p, _ in parts), " + ".join(f"CASE WHEN ({p}) IS NULL THEN 0 ELSE {m} END" for p, m in parts)
    return f"round_even(({got})::DOUBLE / nullif({most}, 0) * 100, 0)", f"({most})::DOUBLE"


add("SRC_02_chart_json", lambda s, d: mg.chart_bars(payloads(s, d), "UTC").groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("closes"), F.sum("volume").alias("volumes")),
    "SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS n, round(sum(value), 4) AS closes, sum(event_id)::BIGINT AS volumes FROM events GROUP BY ALL")
add("SRC_04_06_last_quote", lambda s, d: (q := mg.last_quote(walk_bars(s, d, "n_name"))).select("symbol", *[F.round(c, 4).alias(c) for c in q.columns[1:]]),
    f"WITH {NATION_BARS}, a AS (SELECT *, date_trunc('day', max(ts) OVER (PARTITION BY symbol)) AS day FROM bars), q AS (SELECT symbol, max_by(close, ts) AS price, max_by(close, ts) FILTER (ts < day) AS reference FROM a GROUP BY symbol) SELECT symbol, round(price,4) AS price, round(reference,4) AS reference, round(price-reference,4) AS change, round((price-reference)/nullif(reference,0)*100,4) AS change_pct FROM q")
add("SRC_12_first_source", lambda s, d: mg.first_source(with_priority(s, d)),
    f"WITH {BARS} SELECT symbol, ts, close, CASE WHEN symbol IN ('ASIA','AFRICA') THEN 'B' ELSE 'A' END AS source, CASE WHEN symbol IN ('ASIA','AFRICA') THEN 1 ELSE 0 END AS priority FROM bars")
add("SRC_13_JN_03_stitch", lambda s, d: (q := mg.stitch(*sources(s, d))).select("symbol", "ts", *[F.round(c, 4).alias(c) for c in mg.PRICES], "volume", "adjusted", F.round("factor", 4).alias("factor")),
    f"""WITH {BARS}, o AS (SELECT symbol, ts, {", ".join(f"{c} * CASE WHEN symbol IN ('ASIA','EUROPE') THEN 0.5::DOUBLE ELSE 1 END AS {c}" for c in mg.PRICES)}, volume FROM bars WHERE ts < TIMESTAMP '2000-01-11'), n AS (SELECT * FROM bars WHERE ts >= TIMESTAMP '2000-01-01'),
k AS (SELECT symbol, median(n.close/nullif(o.close,0)) AS k FROM n JOIN o USING (symbol, ts) GROUP BY symbol), f AS (SELECT symbol, min(ts) AS st, any_value(CASE WHEN abs(k-1) > 0.005 THEN k END) AS f FROM n LEFT JOIN k USING (symbol) GROUP BY symbol)
SELECT symbol, ts, {", ".join(f"round({c}*coalesce(f,1),4) AS {c}" for c in mg.PRICES)}, volume, f IS NOT NULL AS adjusted, round(f,4) AS factor FROM o LEFT JOIN f USING (symbol) WHERE st IS NULL OR ts < st
UNION ALL SELECT symbol, ts, {", ".join(f"round({c},4) AS {c}" for c in mg.PRICES)}, volume, false, NULL FROM n""")
add("JN_04_merge_cells", lambda s, d: mg.merge_cells(cells(s, d)).withColumn("value", F.round("value", 4)),
    PREPARED.split(", x0 AS")[0] + """, u AS (SELECT symbol, period_key, unnest(['revenue','equity','receivables']) AS item, unnest([revenue, equity, receivables]) AS value FROM fin), c AS (SELECT *, item = 'receivables' OR (item = 'revenue' AND period_key % 2 = 0) AS b FROM u WHERE value IS NOT NULL)
 SELECT symbol, period_key, item, round(CASE WHEN b THEN value*2 ELSE value END, 4) AS value, CASE WHEN b THEN 'B' ELSE 'A' END AS source FROM c""")
add("AG_05_peer_medians", lambda s, d: sc.peer_medians(metrics(s, d)), f"{METRICS} SELECT * FROM peers")
add("VA_02_relative_value", lambda s, d: sc.relative_value(valued(s, d)).select("symbol", *[F.round(c, 3).alias(c) for c in ("fair_pe", "fair_pb", "fair", "upside")]),
    f"{METRICS}, f AS (SELECT symbol, price, CASE WHEN eps > 0 THEN eps*CASE WHEN peer_pe > 0 THEN peer_pe ELSE 15 END END AS fair_pe, CASE WHEN bvps > 0 THEN bvps*CASE WHEN peer_pb > 0 THEN peer_pb ELSE 1.5::DOUBLE END END AS fair_pb FROM v), h AS (SELECT *, list_avg([fair_pe, fair_pb]) AS fair FROM f) SELECT symbol, round(fair_pe,3) AS fair_pe, round(fair_pb,3) AS fair_pb, round(fair,3) AS fair, round((fair-price)/nullif(price,0)*100,3) AS upside FROM h")
add("VA_03_discounted_value", lambda s, d: sc.discounted_value(metrics(s, d)).select("symbol", "bear", "base", "bull"),
    f"{METRICS}, sn(name, g, t, r) AS (VALUES ('bear', 0.05::DOUBLE, 0.032::DOUBLE, 0.132::DOUBLE), ('base', 0.1, 0.04, 0.12), ('bull', 0.15, 0.048, 0.108)), y AS (SELECT unnest(range(1, 6)) AS y), z AS (SELECT symbol, name, round_even(sum(eps*((1+g)/(1+r))**y) + any_value(eps*(1+g)**5*(1+t)/(r-t)/(1+r)**5), 0) AS pv FROM m, sn, y WHERE eps > 0 GROUP BY symbol, name) SELECT m.symbol, {', '.join(f'''max(pv) FILTER (name = '{n}') AS {n}''' for n in ('bear', 'base', 'bull'))} FROM m LEFT JOIN z USING (symbol) GROUP BY m.symbol")

RISK = f", rk AS (SELECT symbol, CASE WHEN count(ret) FILTER (rn<=30) >= 5 THEN stddev_samp(ret) FILTER (rn<=30) END AS volatility, min((close-pk)/pk) AS max_drawdown FROM (SELECT *, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS ret, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS pk, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) GROUP BY symbol)"
RISK_PARTS = [(case("volatility*sqrt(252.0::DOUBLE)", sc.VOLATILITY, "<"), 30), (case("abs(max_drawdown)", sc.DRAWDOWN, "<"), 30), (case("debt_equity", sc.LEVERAGE, "<="), 20)]
CFO = "CASE WHEN cfo IS NULL THEN NULL WHEN cfo<=0 THEN 0 WHEN net_income IS NULL OR net_income<=0 THEN 8 WHEN cfo/net_income>=1 THEN 15 WHEN cfo/net_income>=0.5::DOUBLE THEN 10 ELSE 5 END"
FUND_PARTS = [(case("roe", sc.ROE, ">="), 25), (case("revenue_growth", sc.GROWTH, ">="), 20), (case("net_margin", sc.MARGIN, ">="), 20), (case("debt_equity", sc.DEBT, "<="), 20), (CFO, 15)]


def multiple_sql(x, cheap, alone):
    to_peer = f"CASE WHEN {x}/peer_{x} < 0.7::DOUBLE THEN 50 ELSE {case(f'{x}/peer_{x}', sc.TO_PEERS, '<=')} END"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN peer_{x} > 0 THEN {to_peer} WHEN {x} < {cheap} THEN 50 ELSE {case(x, alone, '<=')} END"


VAL_PARTS = [(multiple_sql("pe", 12, sc.PE_ALONE), 50), (multiple_sql("pb", 1, sc.PB_ALONE), 50)]
SCORES = f"{METRICS}{RISK}, scores AS (SELECT symbol, {share_sql(RISK_PARTS)[0]} AS risk_score, {share_sql(RISK_PARTS)[1]} AS risk_coverage, {share_sql(FUND_PARTS)[0]} AS fundamental_score, {share_sql(VAL_PARTS)[0]} AS valuation_score FROM v LEFT JOIN rk USING (symbol))"


def scored(s, d):
    df = valued(s, d).join(px.risk(walk_bars(s, d, "n_name")).select("symbol", "volatility", "max_drawdown"), "symbol", "left").withColumn("beta", F.lit(None).cast("double"))
    return sc.valuation_score(sc.fundamental_score(sc.risk_score(df)))


add("SC_03_04_05_scores", lambda s, d: scored(s, d).select("symbol", "risk_score", "risk_coverage", "fundamental_score", "valuation_score"), f"{SCORES} SELECT * FROM scores")
add("SC_08_composite", lambda s, d: sc.composite_score(scored(s, d).withColumns({"technical_score": F.lit(None).cast("double"), "momentum_score": F.lit(None).cast("double")})).select("symbol", "score", "coverage", "category"),
    f"{SCORES}, g AS (SELECT symbol, fundamental_score*25 + valuation_score*20 + risk_score*10 AS full_sum, coalesce(fundamental_score*25,0)+coalesce(valuation_score*20,0)+coalesce(risk_score*10,0) AS got, (fundamental_score IS NOT NULL)::INT*25.0::DOUBLE+(valuation_score IS NOT NULL)::INT*20+(risk_score IS NOT NULL)::INT*10 AS have FROM scores), h AS (SELECT symbol, round_even(got/nullif(have,0),0) AS score, have AS coverage FROM g) SELECT symbol, score, coverage, CASE WHEN score IS NULL THEN NULL WHEN score>=80 THEN 'outstanding' WHEN score>=65 THEN 'positive' WHEN score>=50 THEN 'neutral' WHEN score>=35 THEN 'cautious' ELSE 'high risk' END AS category FROM h")


def held(s, d):
    """Orders as positions of a portfolio for each priority, in the symbol of the customer's region."""
    geo = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(s, d, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    o = table(s, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", F.col("o_orderpriority").alias("portfolio"), F.col("r_name").alias("symbol"), (F.col("o_orderkey") % 90 + 10).cast("double").alias("quantity"), F.round(F.col("o_totalprice") / 300, 2).alias("buy_price"), F.lit(0.0015).alias("fee_pct"))


add("AG_07_JN_10_portfolio", lambda s, d: sc.positions(held(s, d), walk_bars(s, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("price")).where("symbol <> 'AFRICA'")).groupBy("portfolio").agg(F.count("*").alias("positions"), F.sum("current_value").alias("total_value"), F.round(F.sum("weight"), 4).alias("weights"), F.round(F.avg("pnl_pct"), 2).alias("mean_pct")),
    f"WITH {BARS}, pr AS (SELECT symbol, max_by(close, ts) AS price FROM bars WHERE symbol <> 'AFRICA' GROUP BY symbol), h AS (SELECT o_orderpriority AS portfolio, r_name AS symbol, (o_orderkey % 90 + 10)::DOUBLE AS q, round(o_totalprice/300, 2) AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS (SELECT portfolio, b*q*1.0015::DOUBLE AS cost, coalesce(price, 0)*q AS value FROM h LEFT JOIN pr USING (symbol)), y AS (SELECT portfolio, round_even(value, 0) AS cv, sum(round_even(value, 0)) OVER (PARTITION BY portfolio) AS tot, round_even((value-cost)/nullif(cost,0)*100, 2) AS pct FROM x) SELECT portfolio, count(*) AS positions, sum(cv) AS total_value, round(sum(cv/tot*100), 4) AS weights, round(avg(pct), 2) AS mean_pct FROM y GROUP BY portfolio")


def momentum(s, d):
    """Momentum by region against ASIA, without the averages of gains and losses."""
    bars = walk_bars(s, d)
    strength = px.relative_strength(bars, bars.where("symbol = 'ASIA'")).select("symbol", "difference")
    return sc.momentum_score(px.bar_returns(bars, STEPS).join(strength, "symbol", "left").withColumn("rsi", F.lit(None).cast("double")))


PAIR = "CASE WHEN {0} IS NOT NULL OR {1} IS NOT NULL THEN {2}::DOUBLE*coalesce({0},0) + {3}::DOUBLE*coalesce({1},0) END"
MOM_PARTS = [(case(PAIR.format("ret_5", "ret_10", 0.4, 0.6), sc.SHORT, ">"), 25), (case("ret_20", sc.MEDIUM, ">"), 20), (case(PAIR.format("ret_60", "ret_120", 0.5, 0.5), sc.LONG, ">"), 20), (case("difference", sc.STRENGTH, ">"), 20)]
add("SC_02_momentum_score", lambda s, d: momentum(s, d).select("symbol", "momentum_score"),
    f"WITH {BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn, {', '.join(f'(close/nullif(lag(close,{n}) OVER (PARTITION BY symbol ORDER BY ts),0)-1)*100 AS {k}' for k, n in STEPS.items())} FROM bars), ix AS (SELECT ts, close AS mk FROM bars WHERE symbol = 'ASIA'), j AS (SELECT b.symbol, ts, b.close, mk, row_number() OVER (PARTITION BY b.symbol ORDER BY ts DESC) AS k FROM bars b JOIN ix USING (ts)), rs AS (SELECT symbol, (max_by(close,ts)/min_by(close,ts)-max_by(mk,ts)/min_by(mk,ts))*100 AS difference FROM j WHERE k <= 60 GROUP BY symbol) SELECT symbol, {share_sql(MOM_PARTS)[0]} AS momentum_score FROM a LEFT JOIN rs USING (symbol) WHERE rn = 1")
