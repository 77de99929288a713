"""Screens, market tables, signals, scores, news and small state, keyed by operator."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import backtest as bt, desk, performance as px, scoring as sc, technical as ta
from tidemark.plans.bars import STATEMENTS_SQL, bars_sql, statements, table, walk_bars
from tidemark.queries.market import BARS, FOLD, NATION_BARS, SNAP, STEPS, w
from tidemark.queries.merges import FUND_PARTS, METRICS, MOM_PARTS, RISK, RISK_PARTS, VAL_PARTS, case, metrics, share_sql, valued

from tidemark.plans.store import shared_folder
from tidemark.sources import sinks
from tidemark.streaming.jobs import stream_of

QUERIES, ORACLE = {}, {}


def add(name, query, sql):
    QUERIES[name], ORACLE[name] = query, sql


def nations(s, d):
    return walk_bars(s, d, "n_name")


# every indicator in one recursion, and the average of directional movement in another
INDICATORS = """b0 AS (SELECT *, row_number() OVER s AS rn, lag(close) OVER s AS pc, high-lag(high) OVER s AS up, lag(low) OVER s-low AS dn, (high+low+close)/3 AS tp FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
b1 AS (SELECT *, greatest(high-low, abs(high-pc), abs(low-pc)) AS tr, CASE WHEN up>dn AND up>0 THEN up ELSE 0.0::DOUBLE END AS pm, CASE WHEN dn>up AND dn>0 THEN dn ELSE 0.0::DOUBLE END AS mm, greatest(close-pc,0) AS gain, greatest(pc-close,0) AS loss FROM b0),
ind AS (SELECT symbol, rn, close AS e12, close AS e26, 0.0::DOUBLE AS sig, NULL::DOUBLE AS g, NULL::DOUBLE AS l, pm AS p, mm AS m, tr AS v FROM b1 WHERE rn=1
 UNION ALL SELECT b.symbol, b.rn, {e12}, {e26}, i.sig*0.8::DOUBLE+0.2::DOUBLE*(({e12})-({e26})), CASE WHEN i.g IS NULL THEN b.gain ELSE i.g*{k}+b.gain/14 END, CASE WHEN i.l IS NULL THEN b.loss ELSE i.l*{k}+b.loss/14 END, i.p*{k}+b.pm/14, i.m*{k}+b.mm/14, i.v*{k}+b.tr/14 FROM ind i JOIN b1 b ON b.symbol=i.symbol AND b.rn=i.rn+1),
dx AS (SELECT symbol, rn, 100*p/nullif(v,0) AS pdi, 100*m/nullif(v,0) AS mdi, 100*abs(p-m)/nullif(p+m,0) AS dx FROM ind WHERE rn>=14),
ax AS (SELECT symbol, rn, dx AS a FROM dx WHERE rn=14 UNION ALL SELECT d.symbol, d.rn, a.a*{k}+d.dx/14 FROM ax a JOIN dx d ON d.symbol=a.symbol AND d.rn=a.rn+1),
w0 AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY ts) AS pt, coalesce(sign(close-pc)*volume,0)::DOUBLE AS st, CASE WHEN high=low THEN 0.0::DOUBLE ELSE ((close-low)-(high-close))/(high-low) END*volume AS mfv, count(*) OVER (PARTITION BY symbol) AS nn FROM b1),
w1 AS (SELECT *, sum(st) OVER (PARTITION BY symbol ORDER BY ts) AS obv, {smas}, CASE WHEN count(close) OVER {w20}=20 THEN avg(close) OVER {w20} END AS bm, CASE WHEN count(close) OVER {w20}=20 THEN stddev_samp(close) OVER {w20} END AS sd, CASE WHEN count(close) OVER {w20}=20 THEN sum(mfv) OVER {w20}/nullif(sum(volume) OVER {w20},0) END AS cmf,
 CASE WHEN count(volume) OVER {w20}=20 THEN volume/nullif(avg(volume) OVER {w20},0) END AS rel_volume, CASE WHEN count(tp) OVER {w14}=14 THEN 100-100/(1+sum(CASE WHEN tp>pt THEN tp*volume ELSE 0.0::DOUBLE END) OVER {w14}/nullif(sum(CASE WHEN tp<pt THEN tp*volume ELSE 0.0::DOUBLE END) OVER {w14},0)) END AS mfi, (close/nullif(lag(close,10) OVER (PARTITION BY symbol ORDER BY ts),0)-1)*100 AS roc FROM w0),
al AS (SELECT w1.*, e12, e26, sig, e12-e26-sig AS macd_hist, CASE WHEN rn>=14 THEN v END AS atr, pdi, mdi, CASE WHEN rn>=27 THEN a END AS adx, CASE WHEN rn<15 THEN NULL WHEN l=0 AND g>0 THEN 100.0::DOUBLE WHEN l=0 THEN 50.0::DOUBLE ELSE 100-100/(1+g/l) END AS rsi, bm+2*sd AS bu, bm-2*sd AS bl,
 lag(e12-e26-sig) OVER (PARTITION BY symbol ORDER BY ts) AS prev_hist, CASE WHEN count(obv) OVER {w20}=20 THEN avg(obv) OVER {w20} END AS obv_sma, lag(obv,5) OVER (PARTITION BY symbol ORDER BY ts) AS obv_5 FROM w1 JOIN ind USING (symbol, rn) LEFT JOIN dx USING (symbol, rn) LEFT JOIN ax USING (symbol, rn))""".format(
    e12="i.e12*(1-2.0::DOUBLE/13)+b.close*2.0::DOUBLE/13", e26="i.e26*(1-2.0::DOUBLE/27)+b.close*2.0::DOUBLE/27", k="(1-1.0::DOUBLE/14)", w20=w(20), w14=w(14),
    smas=", ".join(f"CASE WHEN nn>=30 AND count(close) OVER {w(p)}={p} THEN avg(close) OVER {w(p)} END AS s{p}" for p in (20, 50, 200)),
)
IND, NATION_IND = f"WITH RECURSIVE {BARS}, {INDICATORS}", f"WITH RECURSIVE {NATION_BARS}, {INDICATORS}"
ORACLE["TA_07_adx"] = f"{IND} SELECT symbol, ts, round(pdi,4) AS plus_di, round(mdi,4) AS minus_di, round(adx,4) AS adx FROM al"
ORACLE["TA_13_all_indicators"] = f"{NATION_IND} SELECT symbol, ts, round(s20,4) AS sma_20, round(bu,4) AS bb_upper, round(mfi,4) AS mfi, round(obv,4) AS obv, round(cmf,4) AS cmf, round(roc,4) AS roc, round(rel_volume,4) AS rel_volume, round(rsi,4) AS rsi, round(macd_hist,4) AS macd_hist, round(atr,4) AS atr, round(adx,4) AS adx FROM al"
ORACLE["TA_02_07_by_chunk"] = f"{NATION_IND} SELECT symbol, ts, round(e12,4) AS ema_12, round(e26,4) AS ema_26, round(rsi,4) AS rsi, round(e12-e26,4) AS macd, round(sig,4) AS macd_signal, round(macd_hist,4) AS macd_hist, round(atr,4) AS atr, round(pdi,4) AS plus_di, round(mdi,4) AS minus_di, round(adx,4) AS adx FROM al"
add("TA_16_signals", lambda s, d: ta.signals(ta.all_indicators(nations(s, d))).drop("band_position"),
    f"""{NATION_IND} SELECT symbol, ts, CASE WHEN rsi>=70 THEN 'overbought' WHEN rsi<=30 THEN 'oversold' WHEN rsi>50 THEN 'positive' WHEN rsi IS NOT NULL THEN 'negative' END AS rsi_signal, CASE WHEN macd_hist>0 AND coalesce(prev_hist,0)<=0 THEN 'cross up' WHEN macd_hist<0 AND coalesce(prev_hist,0)>=0 THEN 'cross down' WHEN macd_hist>coalesce(prev_hist,0) THEN 'rising' ELSE 'falling' END AS macd_signal,
 CASE WHEN bu IS NULL THEN NULL WHEN close>bu THEN 'above band' WHEN close<bl THEN 'below band' WHEN close>bm THEN 'upper half' ELSE 'lower half' END AS band_signal, CASE WHEN rel_volume>2 THEN 'spike' WHEN rel_volume>1.5::DOUBLE THEN 'high' WHEN rel_volume<0.5::DOUBLE THEN 'low' WHEN rel_volume IS NOT NULL THEN 'normal' END AS volume_signal,
 CASE WHEN adx IS NOT NULL THEN CASE WHEN pdi>mdi THEN 'up ' ELSE 'down ' END || CASE WHEN adx>=25 THEN 'strong' WHEN adx>=20 THEN 'moderate' ELSE 'weak' END END AS adx_signal, CASE WHEN cmf>0 THEN 'inflow' WHEN cmf IS NOT NULL THEN 'outflow' END AS flow_signal FROM al""")
RSI_15 = "CASE WHEN rsi IS NULL THEN NULL WHEN rsi BETWEEN 50 AND 70 THEN 15 WHEN (rsi>=40 AND rsi<50) OR (rsi>70 AND rsi<=80) THEN 8 WHEN rsi>80 OR rsi<30 THEN 0 ELSE 4 END"
TECH = [
    *[(f"CASE WHEN s{p} IS NULL THEN NULL WHEN close>s{p} THEN {m} ELSE 0 END", m) for p, m in ((200, 10), (50, 8), (20, 7))], (RSI_15, 15),
    ("CASE WHEN macd_hist>0 AND macd_hist>coalesce(prev_hist,macd_hist) THEN 15 WHEN macd_hist>0 THEN 9 WHEN macd_hist>coalesce(prev_hist,macd_hist) THEN 6 ELSE 0 END", 15), (case("rel_volume", sc.REL_VOLUME, ">"), 10),
    ("CASE WHEN bu IS NULL THEN NULL WHEN close>bm AND close<=bu THEN 10 WHEN close>bu THEN 4 WHEN close>bl THEN 5 ELSE 0 END", 10), ("CASE WHEN adx IS NULL THEN NULL WHEN adx>=25 THEN CASE WHEN pdi>mdi THEN 10 ELSE 0 END WHEN adx>=20 THEN CASE WHEN pdi>mdi THEN 6 ELSE 2 END ELSE 4 END", 10),
    (case("cmf", sc.MONEY_FLOW, ">"), 5), ("CASE WHEN mfi IS NULL THEN NULL WHEN mfi BETWEEN 50 AND 80 THEN 5 WHEN mfi>=40 AND mfi<50 THEN 3 WHEN mfi>80 THEN 2 ELSE 0 END", 5), ("CASE WHEN obv_sma IS NULL THEN NULL WHEN obv>obv_sma THEN 5 WHEN obv>obv_5 THEN 2 ELSE 0 END", 5),
]
add("SC_01_technical_score", lambda s, d: sc.technical_score(px.latest(ta.all_indicators(nations(s, d)))).select("symbol", "technical_score", "technical_max"),
    f"{NATION_IND} SELECT symbol, {share_sql(TECH)[0]} AS technical_score, {share_sql(TECH)[1]} AS technical_max FROM al QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
add("SC_09_recommendation", lambda s, d: sc.technical_score(px.latest(ta.all_indicators(nations(s, d)))).select("symbol", desk.recommendation(F.col("technical_score")).alias("advice"), desk.level(F.col("technical_score")).alias("level")),
    f"{NATION_IND}, x AS (SELECT symbol, {share_sql(TECH)[0]} AS t FROM al QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) SELECT symbol, CASE WHEN t>=80 THEN 'strong buy' WHEN t>=65 THEN 'buy' WHEN t>=50 THEN 'hold' WHEN t>=35 THEN 'reduce' WHEN t IS NOT NULL THEN 'sell' END AS advice, CASE WHEN t>=65 THEN 'high' WHEN t>=45 THEN 'medium' WHEN t IS NOT NULL THEN 'low' END AS level FROM x")


def market(s, d):
    """The last bar of ASIA as an index, with the breadth of the nations' bars."""
    bars = ta.exponential(ta.sma(walk_bars(s, d).where("symbol = 'ASIA'"), (20, 50, 200))).withColumn("ret_20", (F.col("close") / F.lag("close", 20).over(ta.by_ts()) - 1) * 100)
    return px.latest(bars).withColumn("one", F.lit(1)).join(px.breadth(px.snapshot(nations(s, d))).withColumn("one", F.lit(1)), "one")


N_SNAP = re.sub(r"\b(day0|day1|day2|bars)\b", r"n_\1", SNAP[SNAP.index("day0 AS") :].replace(", a AS", ", na AS").replace("FROM a ", "FROM na ").replace("(SELECT max(ts) FROM a", "(SELECT max(ts) FROM na"))
HEALTH = f"""{IND}, {N_SNAP}, br AS (SELECT count(*) FILTER (change>0.0001) AS u, count(*) FILTER (change< -0.0001) AS dn, avg(above_ma20::INT)*100 AS pa FROM snap),
h AS (SELECT list_avg([CASE WHEN close>s20 THEN 100.0 WHEN s20 IS NOT NULL THEN 0 END, CASE WHEN close>s50 THEN 100 WHEN s50 IS NOT NULL THEN 0 END, CASE WHEN close>s200 THEN 100 WHEN s200 IS NOT NULL THEN 0 END]) AS t, greatest(0,least(100,(rsi-30)/40*100)) AS r, (close/r20-1)*100 AS r20, (coalesce(br.u*100.0::DOUBLE/nullif(br.u+br.dn,0),50)+pa)/2 AS b FROM (SELECT *, lag(close,20) OVER (PARTITION BY symbol ORDER BY ts) AS r20 FROM al WHERE symbol='ASIA') q, br QUALIFY row_number() OVER (ORDER BY ts DESC) = 1),
z AS (SELECT round_even((coalesce(t*35,0)+coalesce(r*20,0)+coalesce(b*30,0)+coalesce(greatest(0,least(100,50+6*r20))*15,0))/((t IS NOT NULL)::INT*35+(r IS NOT NULL)::INT*20+(b IS NOT NULL)::INT*30+(r20 IS NOT NULL)::INT*15.0::DOUBLE),0) AS health FROM h)"""
add("SC_07_market_health", lambda s, d: sc.market_health(market(s, d)).select("health", "health_label"), f"{HEALTH} SELECT health, CASE WHEN health>=65 THEN 'positive' WHEN health>=50 THEN 'fair' WHEN health>=35 THEN 'cautious' ELSE 'weak' END AS health_label FROM z")


def boards(s, d):
    """A board for each market segment from the customers' balances."""
    return table(s, d, "customer").select(F.col("c_custkey"), (F.col("c_acctbal") / 4000).alias("ad_ratio"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3 == 1).alias("above_ma50"), (F.col("c_custkey") % 90).cast("double").alias("rsi"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal") * 1e8 - 2e11).alias("foreign_net"))


OLDER = [(case("ad", sc.ADVANCE, ">"), 30), ("CASE k%3 WHEN 1 THEN 25 WHEN 2 THEN 5 END", 25), ("CASE WHEN k%90 BETWEEN 50 AND 65 THEN 25 WHEN k%90>=40 AND k%90<50 THEN 15 WHEN k%90>65 THEN 10 ELSE 5 END", 25), ("CASE WHEN k%5=0 THEN NULL WHEN f>0 THEN 20 WHEN f>-1e11 THEN 10 ELSE 3 END", 20)]
add("SC_06_older_market_health", lambda s, d: sc.older_market_health(boards(s, d)).select("c_custkey", "health"), f"WITH x AS (SELECT c_custkey, c_custkey AS k, c_acctbal/4000 AS ad, c_acctbal*1e8::DOUBLE-2e11::DOUBLE AS f FROM customer) SELECT c_custkey, {share_sql(OLDER)[0]} AS health FROM x")

add("PX_03_last_rsi", lambda s, d: px.latest(ta.exponential(nations(s, d), ("rsi",))).select("symbol", F.round("rsi", 4).alias("rsi")), f"{NATION_IND} SELECT symbol, round(rsi,4) AS rsi FROM al QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
add("PX_06_report_returns", lambda s, d: desk.report_returns(nations(s, d)).select("symbol", *[F.round(c, 4).alias(c) for c in ("ret_21", "ret_63", "ret_year")]),
    f"WITH {NATION_BARS} SELECT symbol, round((close/lag(close,21) OVER s-1)*100,4) AS ret_21, round((close/lag(close,63) OVER s-1)*100,4) AS ret_63, CASE WHEN count(*) OVER (PARTITION BY symbol)>200 THEN round((close/first_value(close) OVER s-1)*100,4) END AS ret_year FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
add("PX_07_excess_return", lambda s, d: desk.excess_return(walk_bars(s, d), walk_bars(s, d).where("symbol = 'ASIA'")).select("symbol", *[F.round(c, 4).alias(c) for c in ("ret", "index_ret", "excess")]),
    f"WITH {BARS}, x AS (SELECT symbol, (close/lag(close,120) OVER (PARTITION BY symbol ORDER BY ts)-1)*100 AS r FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) SELECT x.symbol, round(x.r,4) AS ret, round(i.r,4) AS index_ret, round(x.r-i.r,4) AS excess FROM x, x i WHERE i.symbol = 'ASIA'")
add("PX_08_stop_and_upside", lambda s, d: desk.stop_and_upside(px.latest(ta.exponential(nations(s, d), ("atr",))).select("symbol", F.col("close").alias("price"), "atr", (F.col("close") * 1.2 - 50).alias("fair"))).select("symbol", F.round("stop", 4).alias("stop"), F.round("upside", 4).alias("upside")),
    f"{NATION_IND} SELECT symbol, round(greatest(0, close-2*atr),4) AS stop, round((close*1.2::DOUBLE-50-close)/nullif(close,0),4) AS upside FROM al QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
add("TA_17_index_overlay", lambda s, d: ta.sma(walk_bars(s, d).where("symbol = 'ASIA'"), (20, 50)).select("ts", F.round("sma_20", 4).alias("sma_20"), F.round("sma_50", 4).alias("sma_50"), (F.col("close") >= F.col("open")).alias("rising")),
    f"WITH {BARS} SELECT ts, CASE WHEN count(*) OVER (PARTITION BY symbol)>=30 AND count(close) OVER {w(20)}=20 THEN round(avg(close) OVER {w(20)},4) END AS sma_20, CASE WHEN count(*) OVER (PARTITION BY symbol)>=30 AND count(close) OVER {w(50)}=50 THEN round(avg(close) OVER {w(50)},4) END AS sma_50, close>=open AS rising FROM bars WHERE symbol='ASIA'")


def ruled(s, d):
    b = ta.exponential(ta.sma(walk_bars(s, d), (20, 50)), ("rsi",)).withColumn("mean_volume", ta.full(F.avg("volume").over(ta.last(20)), "volume", 20))
    c = F.col
    return bt.rules(b, (c("close") > c("sma_50")) & (c("sma_20") > c("sma_50")) & c("rsi").between(40, 70) & (c("volume") > c("mean_volume")), (c("close") < c("sma_50")) | (c("rsi") > 80))


add("BT_03_rules", lambda s, d: ruled(s, d).select("symbol", "ts", "signal"),
    f"{IND} SELECT symbol, ts, CASE WHEN coalesce(close<s50,false) OR coalesce(rsi>80,false) THEN -1 WHEN close>s50 AND s20>s50 AND rsi BETWEEN 40 AND 70 AND rel_volume>1 THEN 1 ELSE 0 END AS signal FROM al")
add("BT_07_curve_against_index", lambda s, d: (e := bt.equity(bt.ma_cross(walk_bars(s, d)))).join(walk_bars(s, d).where("symbol = 'ASIA'").select("ts", F.col("close").alias("market")), "ts").select("symbol", "ts", F.round(F.col("equity") / F.first("equity").over(ta.by_ts()) * 100, 4).alias("curve"), F.round(F.col("market") / F.first("market").over(ta.by_ts()) * 100, 4).alias("index_curve")),
    f"{FOLD}, j AS (SELECT e.symbol, e.ts, cash+held*e.close AS eq, m.close AS mk FROM e JOIN bars m ON m.ts=e.ts AND m.symbol='ASIA') SELECT symbol, ts, round(eq/first_value(eq) OVER s*100,4) AS curve, round(mk/first_value(mk) OVER s*100,4) AS index_curve FROM j WINDOW s AS (PARTITION BY symbol ORDER BY ts)")

add("FL_02_presets", lambda s, d: desk.screen(metrics(s, d), "value").select("symbol", F.lit("value").alias("screen")).unionByName(desk.screen(metrics(s, d), "growth").select("symbol", F.lit("growth").alias("screen"))).unionByName(desk.screen(metrics(s, d), "dividend").select("symbol", F.lit("dividend").alias("screen"))),
    f"{METRICS.replace('revenue_growth', 'revenue_growth', 1)} SELECT symbol, 'value' AS screen FROM m WHERE pe<=12 AND pb<=1.5::DOUBLE AND roe>=12 UNION ALL SELECT symbol, 'growth' FROM m JOIN (SELECT symbol, (net_income-y_net_income)/nullif(abs(y_net_income),0)*100 AS ng FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_key DESC)=1) USING (symbol) WHERE revenue_growth>=15 AND ng>=15 AND roe>=15")
add("FL_03_sliders", lambda s, d: desk.screen(metrics(s, d), "value", {"pe": ("<=", 60.0), "roe": (">=", -100.0), "pb": ("<=", 50.0), "net_margin": (">=", 1.0)}).select("symbol"), f"{METRICS} SELECT symbol FROM m WHERE pe<=60 AND roe>=-100 AND pb<=50 AND net_margin>=1")


def baskets(s, d):
    """Nations by region, by first letter, and all of them as an index."""
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.inline(F.array(F.struct(F.lit("ALL").alias("name"), F.lit(0).alias("ordinal"), F.col("n_name").alias("symbol")), F.struct(F.when(F.col("n_name") < "M", F.substring("n_name", 1, 1)).alias("name"), (F.ascii("n_name") + 10).alias("ordinal"), F.col("n_name").alias("symbol")), F.struct(F.when(F.col("n_nationkey") % 4 > 0, F.col("r_name")).alias("name"), (F.col("r_regionkey").cast("int") + 100).alias("ordinal"), F.col("n_name").alias("symbol"))))).where("name is not null")


B_SQL = "bk AS (SELECT 'ALL' AS name, 0 AS ordinal, n_name AS symbol FROM nation UNION ALL SELECT n_name[1:1], ascii(n_name)+10, n_name FROM nation WHERE n_name < 'M' UNION ALL SELECT r_name, r_regionkey+100, n_name FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey%4>0)"
add("FL_04_members", lambda s, d: desk.members(table(s, d, "nation").select(F.col("n_name").alias("symbol")), baskets(s, d), ["C", "ASIA"]), f"WITH {B_SQL} SELECT DISTINCT symbol FROM bk WHERE name IN ('C','ASIA')")
add("JN_08_sectors_of_baskets", lambda s, d: desk.sectors(table(s, d, "nation").select(F.col("n_name").alias("symbol")), baskets(s, d), ["ALL"], {"CHINA": "special", "PERU": "special"}), f"WITH {B_SQL} SELECT n_name AS symbol, CASE WHEN n_name IN ('CHINA','PERU') THEN 'special' ELSE coalesce((SELECT min_by(name, ordinal) FROM bk WHERE symbol=n_name AND name<>'ALL'),'other') END AS sector FROM nation")
add("TK_01_losers", lambda s, d: desk.movers(px.snapshot(nations(s, d)), "change", 10, False).select("symbol", F.round("change", 4).alias("change")), f"{SNAP} SELECT symbol, round(change,4) AS change FROM snap WHERE change IS NOT NULL ORDER BY snap.change, symbol LIMIT 10")
add("TK_01_by_volume", lambda s, d: desk.movers(px.snapshot(nations(s, d)), "volume").select("symbol", "volume"), f"{SNAP} SELECT symbol, volume FROM snap WHERE volume IS NOT NULL ORDER BY volume DESC, symbol LIMIT 10")
add("AG_03_board_breadth", lambda s, d: (b := desk.board_breadth(table(s, d, "customer").select((F.col("c_acctbal") - 4000).alias("change")))).withColumn("ad_ratio", F.round("ad_ratio", 6)), "SELECT count(*) FILTER (c_acctbal>4000) AS advancers, count(*) FILTER (c_acctbal<4000) AS decliners, count(*) FILTER (c_acctbal=4000) AS unchanged, round(count(*) FILTER (c_acctbal>4000)/count(*) FILTER (c_acctbal<4000)::DOUBLE,6) AS ad_ratio FROM customer")


def sourced_bars(s, d):
    return walk_bars(s, d).withColumn("source", F.when(F.year("ts") >= 2000, "A").otherwise("B"))


add("AG_01_provenance", lambda s, d: desk.provenance(sourced_bars(s, d)), f"WITH {BARS} SELECT symbol, CASE WHEN year(ts)>=2000 THEN 'A' ELSE 'B' END AS source, min(ts) AS first, max(ts) AS last, count(*) AS rows FROM bars GROUP BY ALL")
add("AG_09_sources_used", lambda s, d: desk.sources_used(sourced_bars(s, d).withColumn("source", F.when(F.col("symbol") != "ASIA", F.col("source")).otherwise("C"))), f"WITH {BARS} SELECT symbol, string_agg(DISTINCT CASE WHEN symbol='ASIA' THEN 'C' WHEN year(ts)>=2000 THEN 'A' ELSE 'B' END, ',' ORDER BY CASE WHEN symbol='ASIA' THEN 'C' WHEN year(ts)>=2000 THEN 'A' ELSE 'B' END) AS sources FROM bars GROUP BY symbol")
add("AG_06_peer_metrics", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(desk.as_percent(F.when(F.col("l_linenumber") > 3, F.col("l_discount") * 100).otherwise(F.col("l_discount"))), 4).alias("pct")), "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_linenumber>3 THEN CASE WHEN l_discount*100<1 THEN l_discount*10000 ELSE l_discount*100 END ELSE l_discount*100 END,4) AS pct FROM lineitem")
add("JN_07_compare", lambda s, d: desk.compare(walk_bars(s, d)).withColumn("rebased", F.round("rebased", 4)),
    f"WITH {BARS}, st AS (SELECT max(f) AS start FROM (SELECT min(ts) AS f FROM bars GROUP BY symbol)), g AS (SELECT sy.symbol, dy.ts FROM (SELECT DISTINCT symbol FROM bars) sy, (SELECT DISTINCT ts FROM bars, st WHERE ts>=start) dy), x AS (SELECT g.symbol, g.ts, (SELECT max_by(close, b.ts) FROM bars b WHERE b.symbol=g.symbol AND b.ts<=g.ts) AS c FROM g) SELECT symbol, ts, round(c/first_value(c) OVER (PARTITION BY symbol ORDER BY ts)*100,4) AS rebased FROM x")


def news(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("news_id"), F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("published_at"), F.col("ts").alias("fetched_at"), "value")


NEWS = "n AS (SELECT event_id AS news_id, event_type AS symbol, CASE WHEN event_id%4>0 THEN ts END AS p, ts AS f, value FROM events)"
add("TK_02_newest_news", lambda s, d: desk.newest_news(news(s, d)).select("symbol", "news_id", "rank"), f"WITH {NEWS} SELECT symbol, news_id, row_number() OVER (PARTITION BY symbol ORDER BY p DESC NULLS LAST, news_id)::INT AS rank FROM n QUALIFY rank<=40")
add("TK_03_feed", lambda s, d: desk.feed(news(s, d), ["click", "view"], 100).select("news_id", "symbol"), f"WITH {NEWS} SELECT news_id, symbol FROM n WHERE symbol IN ('click','view') ORDER BY coalesce(p,f) DESC, news_id LIMIT 100")
add("ST_01_union_all", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a")).unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")), allowMissingColumns=True), "SELECT c_custkey AS k, c_acctbal AS a, NULL AS n FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
add("ST_02_distinct_in_order", lambda s, d: desk.distinct_in_order(table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("ordinal")), "symbol", "ordinal"), "SELECT o_custkey AS symbol, min(o_orderkey) AS ordinal FROM orders GROUP BY ALL")
add("ST_03_intersect", lambda s, d: table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).intersect(table(s, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))), "SELECT o_orderdate::DATE::VARCHAR AS day FROM orders INTERSECT SELECT l_shipdate::DATE::VARCHAR FROM lineitem")
add("ST_04_first_of", lambda s, d: desk.first_of(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey"), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")


def late_cells(s, d):
    f = statements(s, d).select("symbol", "period_key", F.lit("revenue").alias("item"), F.col("revenue").alias("value"), F.lit(1).alias("fetched"))
    return f, f.where("period_key % 10 = 4").withColumns({"value": F.col("value") * 2, "fetched": F.lit(2)})


def written(s, label, how, first, *changes):
    """A table in the shared folder, made of `first` and changed; each change runs twice, as after a failure."""
    path = shared_folder(s, label)
    sinks.create(s, path, first.schema, how)
    sinks.upsert(first, path, how, "first")
    for k, (change, rows) in enumerate(changes):
        for _ in range(2):
            change(rows, path, how, f"change-{k}")
    return path


def cells_written(s, d):
    how = sinks.Table(("symbol", "period_key", "item"), "fetched", buckets=4)
    first, late = late_cells(s, d)
    return sinks.read(s, written(s, "cells", how, first, (sinks.upsert, late)), how).select("symbol", "period_key", "item", F.round("value", 4).alias("value"), "fetched")


def news_written(s, d):
    how, n = sinks.Table(("news_id",), "fetched_at", by="symbol"), news(s, d).select("news_id", "symbol", "value", F.lit(1).alias("fetched_at"))
    late = n.withColumns({"value": F.col("value") + 1, "fetched_at": F.lit(2)}).unionByName(n.withColumns({"value": F.col("value") + 2, "fetched_at": F.lit(3)}))
    return sinks.read(s, written(s, "news", how, n.where("news_id % 3 = 0"), (sinks.insert_new, late)), how).select("news_id", "symbol", F.round("value", 4).alias("value"))


def customers_left(s, d):
    how, c = sinks.Table(("c_custkey",), "at", buckets=4), table(s, d, "customer").select("c_custkey", "c_name", F.lit(1).alias("at"))
    gone = table(s, d, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.read(s, written(s, "customers", how, c, (sinks.delete, gone)), how).select("c_custkey", "c_name")


def bars_written(s, d):
    """Bars by year of which those of 1996 are fetched again, with another close and no volume, and some days more."""
    how, b = sinks.Table(("symbol", "ts"), "fetched", by="year"), walk_bars(s, d).withColumns({"fetched": F.lit(1), "year": F.year("ts")})
    again = b.where("year = 1996").drop("volume").withColumns({"close": F.col("close") * 2, "fetched": F.lit(2)})
    more = again.where("month(ts) = 2").withColumns({"ts": F.expr("ts - interval 20 years"), "year": F.lit(1976)})
    return sinks.read(s, written(s, "bars", how, b, (sinks.upsert, again.unionByName(more))), how).select("symbol", "ts", F.round("close", 4).alias("close"), "volume")


def documents_looked_up(s, d):
    how = sinks.TABLES["document"]
    docs = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("year"), F.col("source").alias("doc_type"), F.lit(1).alias("fetched_at"))
    return sinks.lookup(s, written(s, "documents", how, docs), how, F.col("doc_id") % 2 == 0).select("doc_id", "year", "doc_type")


def landed(s, d):
    """The last event of each user up to a time, landed from a stream; late ones go to a dead-letter table."""
    how, at = sinks.Table(("user_id",), "event_id", buckets=4), shared_folder(s, "landed")
    stream = stream_of(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    sinks.upsert_stream(stream, f"{at}/table", how, f"{at}/log", f"{at}/checkpoint", f"{at}/dead", F.lit("2024-01-20").cast("timestamp")).awaitTermination()
    return how, at


def landing_log(s, d):
    how, at = landed(s, d)
    log = s.read.parquet(f"{at}/log").agg(*[F.sum(c).alias(c) for c in ("rows", "kept", "dead")])
    return log.join(s.read.parquet(f"{at}/dead").agg(F.count("*").alias("in_dead")), F.lit(True))  # a row each


add("SNK_01_upsert_bars", bars_written, f"WITH {BARS} SELECT symbol, ts, round(CASE WHEN year(ts)=1996 THEN close*2 ELSE close END,4) AS close, CASE WHEN year(ts)<>1996 THEN volume END AS volume FROM bars UNION ALL SELECT symbol, ts - INTERVAL 20 YEAR, round(close*2,4), NULL FROM bars WHERE year(ts)=1996 AND month(ts)=2")
add("SNK_02_upsert_cells", cells_written, f"WITH {STATEMENTS_SQL} SELECT symbol, period_key, 'revenue' AS item, round(CASE WHEN period_key%10=4 THEN revenue*2 ELSE revenue END,4) AS value, CASE WHEN period_key%10=4 THEN 2 ELSE 1 END AS fetched FROM fin")
add("SNK_03_insert_new", news_written, f"WITH {NEWS} SELECT news_id, symbol, round(CASE WHEN news_id%3=0 THEN value ELSE value+1 END,4) AS value FROM n")
add("SNK_04_delete", customers_left, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)")
add("SS_07_landed", lambda s, d: (lambda how, at: sinks.read(s, f"{at}/table", how).select("user_id", "event_id", F.round("value", 4).alias("value")))(*landed(s, d)), "SELECT user_id, max(event_id) AS event_id, round(max_by(value, event_id), 4) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY user_id")
add("SS_06_dead_letters", landing_log, "SELECT count(*)::BIGINT AS rows, (count(*) FILTER (ts <= TIMESTAMP '2024-01-20'))::BIGINT AS kept, (count(*) FILTER (ts > TIMESTAMP '2024-01-20'))::BIGINT AS dead, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS in_dead FROM events")
add("SNK_06_news_of_a_window", lambda s, d: desk.news_window(news(s, d), F.lit("2024-01-25").cast("timestamp_ntz"), 7, ["click", "view"], 150).select("news_id", "symbol"), f"WITH {NEWS} SELECT news_id, symbol FROM n WHERE coalesce(p,f) >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY AND coalesce(p,f) <= TIMESTAMP '2024-01-25' AND symbol IN ('click','view') ORDER BY coalesce(p,f) DESC, news_id LIMIT 150")
add("SNK_05_price_range", lambda s, d: desk.price_range(walk_bars(s, d), "ASIA", F.lit("1999-01-01").cast("timestamp_ntz"), F.lit("1999-12-31").cast("timestamp_ntz")), f"WITH {BARS} SELECT * FROM bars WHERE symbol='ASIA' AND ts BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-12-31'")
add("SNK_07_ordered_lookup", documents_looked_up, "SELECT doc_id, CASE WHEN doc_id%5>0 THEN n_chars END AS year, source AS doc_type FROM documents WHERE doc_id%2=0")
def two_tellings(s, d):
    """Cells as documents tell them, some per cent off and some missing, and as they are online, of which some are 0."""
    x = item_cells(s, d)
    told = x.where("period_key % 7 <> 3").withColumn("value", F.round("value") * (100 + F.col("period_key") % 11) / 100)
    return told, x.withColumn("value", F.when(F.col("period_key") % 10 == 2, 0.0).otherwise(-F.round("value")))


def item_cells(s, d):
    return statements(s, d).unpivot(["symbol", "period_key"], ["revenue", "equity"], "item", "value")


add("JN_12_reconcile", lambda s, d: desk.reconcile(*two_tellings(s, d)).select("symbol", "period_key", "item", F.round("difference", 4).alias("difference")), f"WITH {STATEMENTS_SQL} SELECT symbol, period_key, item, CASE WHEN period_key % 10 <> 2 THEN round((round(v) * (100 + period_key % 11) / 100 + round(v)) / nullif(abs(round(v)), 0) * 100, 4) END AS difference FROM (SELECT symbol, period_key, revenue, equity FROM fin) UNPIVOT (v FOR item IN (revenue, equity)) WHERE period_key % 7 <> 3")


def quoted(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        "c_custkey", (F.abs("c_acctbal") + 1).alias("price"), F.when(k % 2 == 0, k.cast("double")).otherwise(k * 2e7).alias("shares"), (F.col("c_acctbal") * 1e6).alias("net_income"), (k * 3e9).cast("double").alias("equity"),
        F.when(k % 7 == 0, 500.0).alias("eps_given"), F.when(k % 5 == 0, 900.0).alias("bvps_given"), F.when(k % 3 == 0, F.col("c_acctbal") / 10).alias("eps_provider"), F.when(k % 4 == 0, 1200.0).alias("bvps_provider"), F.when(k % 6 == 1, 11.0).alias("pe_provider"), F.when(k % 6 == 2, 1.3).alias("pb_provider"),
    )


add("VA_01_06_resolved_multiples", lambda s, d: desk.resolved_multiples(quoted(s, d)).select("c_custkey", "eps", "bvps", *[F.round(F.col(c) / 1000, 3).alias(f"{c}_thousands") for c in ("pe", "pb")]),
    """WITH x AS (SELECT c_custkey AS k, CASE WHEN abs(c_acctbal)+1<1000 THEN (abs(c_acctbal)+1)*1000 ELSE abs(c_acctbal)+1 END AS price, CASE WHEN c_custkey%2=0 THEN c_custkey*1e6::DOUBLE ELSE CASE WHEN c_custkey*2e7::DOUBLE<=1e7 THEN c_custkey*2e13::DOUBLE ELSE c_custkey*2e7::DOUBLE END END AS sh, c_acctbal*1e6::DOUBLE AS ni, c_custkey*3e9::DOUBLE AS eq, CASE WHEN c_custkey%7=0 THEN 500.0::DOUBLE END AS eg, CASE WHEN c_custkey%5=0 THEN 900.0::DOUBLE END AS bg, CASE WHEN c_custkey%3=0 AND c_acctbal>0 THEN c_acctbal/10 END AS ep, CASE WHEN c_custkey%4=0 THEN 1200.0::DOUBLE END AS bp, CASE WHEN c_custkey%6=1 THEN 11.0::DOUBLE END AS pp, CASE WHEN c_custkey%6=2 THEN 1.3::DOUBLE END AS bb FROM customer),
 y AS (SELECT *, coalesce(eg, ep, round_even(price/pp,1), CASE WHEN ni>0 THEN round_even(ni/sh,1) END) AS eps, coalesce(bg, bp, round_even(price/bb,1), round_even(eq/sh,1)) AS bvps FROM x) SELECT k AS c_custkey, eps, bvps, round(coalesce(round_even(price/eg,2), pp, CASE WHEN eps>0 THEN round_even(price/eps,2) END)/1000,3) AS pe_thousands, round(coalesce(round_even(price/bg,2), bb, CASE WHEN bvps>0 THEN round_even(price/bvps,2) END)/1000,3) AS pb_thousands FROM y""")


def momentum_inputs(s, d, by="r_name", index="ASIA"):
    bars = walk_bars(s, d, by)
    strength = px.relative_strength(bars, bars.where(F.col("symbol") == index)).select("symbol", "difference")
    rsi = px.latest(ta.exponential(bars, ("rsi",))).select("symbol", "rsi")
    return px.bar_returns(bars, STEPS).join(strength, "symbol", "left").join(rsi, "symbol", "left")


RSI_MOM = "CASE WHEN rsi IS NULL THEN NULL WHEN rsi BETWEEN 50 AND 70 THEN 15 WHEN (rsi>=40 AND rsi<50) OR (rsi>70 AND rsi<=80) THEN 8 WHEN rsi>80 OR rsi<30 THEN 2 ELSE 5 END"
def momentum_sql(head, index):
    return f"{head}, mo AS (SELECT symbol, {', '.join(f'(close/nullif(lag(close,{n}) OVER (PARTITION BY symbol ORDER BY ts),0)-1)*100 AS {k}' for k, n in STEPS.items())} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), ix AS (SELECT ts, close AS mk FROM bars WHERE symbol = '{index}'), j AS (SELECT b.symbol, ts, b.close, mk, row_number() OVER (PARTITION BY b.symbol ORDER BY ts DESC) AS k FROM bars b JOIN ix USING (ts)), rs AS (SELECT symbol, (max_by(close,ts)/min_by(close,ts)-max_by(mk,ts)/min_by(mk,ts))*100 AS difference FROM j WHERE k <= 60 GROUP BY symbol), lr AS (SELECT symbol, rsi FROM al QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) SELECT symbol, round(rsi,4) AS rsi, {share_sql([*MOM_PARTS, (RSI_MOM, 15)])[0]} AS momentum_score FROM mo LEFT JOIN rs USING (symbol) LEFT JOIN lr USING (symbol)"


add("SC_02_momentum_score_with_rsi", lambda s, d: sc.momentum_score(momentum_inputs(s, d)).select("symbol", F.round("rsi", 4).alias("rsi"), "momentum_score"),
    momentum_sql(IND, "ASIA"))


# all five groups of scores, and risk with beta, of nations; the first nation is their index
MARKET = "NATION_1"


def all_scores(s, d):
    bars = nations(s, d)
    beta = px.beta(bars, bars.where(F.col("symbol") == MARKET)).select("symbol", "beta")
    df = valued(s, d).join(px.risk(bars).select("symbol", "volatility", "max_drawdown"), "symbol", "left").join(beta, "symbol", "left")
    technical = sc.technical_score(px.latest(ta.all_indicators(bars))).select("symbol", "technical_score")
    momentum = sc.momentum_score(momentum_inputs(s, d, "n_name", MARKET)).select("symbol", "momentum_score")
    return sc.valuation_score(sc.fundamental_score(sc.risk_score(df))).join(technical, "symbol", "left").join(momentum, "symbol", "left")


BETA_SQL = f"WITH {NATION_BARS}, a AS (SELECT symbol, ts, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS ret FROM bars), m AS (SELECT ts, ret AS mk FROM a WHERE symbol = '{MARKET}') SELECT symbol, CASE WHEN count(*)>=60 AND var_samp(mk)<>0 THEN covar_samp(ret,mk)/var_samp(mk) END AS beta FROM a JOIN m USING(ts) WHERE ret IS NOT NULL AND mk IS NOT NULL GROUP BY symbol"
BETA_PART = ("CASE WHEN beta IS NULL THEN NULL WHEN beta BETWEEN 0.5 AND 1.2 THEN 20 WHEN beta<0.5 THEN 15 WHEN beta<=1.5 THEN 12 ELSE 5 END", 20)
WHOLE_RISK = [*RISK_PARTS[:2], BETA_PART, RISK_PARTS[2]]
GROUPS = f"""{METRICS}{RISK}, be AS ({BETA_SQL}), te AS ({ORACLE["SC_01_technical_score"]}), mm AS ({momentum_sql(NATION_IND, MARKET)}), sx AS (SELECT symbol, {share_sql(WHOLE_RISK)[0]} AS risk_score, {share_sql(WHOLE_RISK)[1]} AS risk_coverage, beta, {share_sql(FUND_PARTS)[0]} AS fundamental_score, {share_sql(VAL_PARTS)[0]} AS valuation_score, technical_score, momentum_score
 FROM v LEFT JOIN rk USING (symbol) LEFT JOIN be USING (symbol) LEFT JOIN te USING (symbol) LEFT JOIN mm USING (symbol))"""
add("SC_05_risk_with_beta", lambda s, d: all_scores(s, d).select("symbol", F.round("beta", 4).alias("beta"), "risk_score", "risk_coverage"), f"{GROUPS} SELECT symbol, round(beta, 4) AS beta, risk_score, risk_coverage FROM sx")
SHARES = ", ".join(f"({g}_score, {w})" for g, w in sc.WEIGHTS.items())
add("SC_08_composite_of_all", lambda s, d: sc.composite_score(all_scores(s, d)).select("symbol", "technical_score", "momentum_score", "score", "coverage", "category"),
    f"{GROUPS}, h AS (SELECT symbol, technical_score, momentum_score, (SELECT round_even(sum(x*w)/nullif(sum(w), 0), 0) FROM (VALUES {SHARES}) t(x, w) WHERE x IS NOT NULL) AS score, (SELECT coalesce(sum(w), 0)::DOUBLE FROM (VALUES {SHARES}) t(x, w) WHERE x IS NOT NULL) AS coverage FROM sx) SELECT *, CASE WHEN score IS NULL THEN NULL WHEN score>=80 THEN 'outstanding' WHEN score>=65 THEN 'positive' WHEN score>=50 THEN 'neutral' WHEN score>=35 THEN 'cautious' ELSE 'high risk' END AS category FROM h")
ORACLE["BT_02_rsi_equity"] = f"""{IND}, sg AS (SELECT symbol, rn, ts, open, close, lag(CASE WHEN rsi<30 THEN 1 WHEN rsi>70 THEN -1 ELSE 0 END,1,0) OVER (PARTITION BY symbol ORDER BY ts) AS act FROM al),
fo AS (SELECT symbol, rn, ts, 1e8::DOUBLE AS cash, 0::BIGINT AS held, close FROM sg WHERE rn=1
 UNION ALL SELECT symbol, rn, ts, CASE WHEN q>0 THEN cash - q*bp*(1+0.0015::DOUBLE) WHEN out THEN cash + held*(open*(1-0.001::DOUBLE))*(1-0.0015::DOUBLE) ELSE cash END, CASE WHEN q>0 THEN q WHEN out THEN 0 ELSE held END, close
 FROM (SELECT b.symbol, b.rn, b.ts, b.open, b.close, e.cash, e.held, b.open*(1+0.001::DOUBLE) AS bp, CASE WHEN b.act=1 AND e.held=0 THEN (floor(e.cash*0.95::DOUBLE/(b.open*(1+0.001::DOUBLE))/100)*100)::BIGINT ELSE 0 END AS q, b.act=-1 AND e.held>0 AS out FROM fo e JOIN sg b ON b.symbol=e.symbol AND b.rn=e.rn+1)) SELECT symbol, ts, round(cash+held*close,2) AS equity, held AS shares FROM fo"""
