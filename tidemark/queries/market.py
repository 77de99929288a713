"""Bars, indicators, returns, risk, breadth and ranks, keyed by operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as bt, performance as px, technical as ta
from tidemark.plans.bars import bars_sql, walk_bars

BARS, NATION_BARS = bars_sql(), bars_sql("n_name")
W = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def w(n: int) -> str:
    return W.format(n - 1)


def rounded(df, *cols, digits: int = 4):
    return df.select("symbol", *(["ts"] if "ts" in df.columns else []), *[F.round(c, digits).alias(c) for c in cols])


def sql_rounded(cols: list[str], source: str, more: str = "symbol, ts", digits: int = 4) -> str:
    return f"SELECT {more}, " + ", ".join(f"round({c}, {digits}) AS {c}" for c in cols) + f" FROM {source}"


QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


add("TA_01_TK_01_sma_leaders", lambda s, d: (
    px.latest(ta.sma(walk_bars(s, d), (20,))).select("symbol", F.round(F.col("close") / F.col("sma_20") - 1, 4).alias("above"), F.round("sma_20", 4).alias("sma_20")).orderBy(F.desc_nulls_last("above"), "symbol").limit(10)),
    f"WITH {BARS}, s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY symbol) >= 30 AND count(close) OVER {w(20)} = 20 THEN avg(close) OVER {w(20)} END AS sma, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) SELECT symbol, round(close/sma - 1, 4) AS above, round(sma, 4) AS sma_20 FROM s WHERE rn = 1 ORDER BY above DESC NULLS LAST, symbol LIMIT 10")
add("SRC_walk_bars", lambda s, d: walk_bars(s, d), f"WITH {BARS} SELECT * FROM bars")
SMA = (10, 20, 50, 100, 200)
add("TA_01_sma", lambda s, d: rounded(ta.sma(walk_bars(s, d)), *[f"sma_{p}" for p in SMA], digits=6),
    f"WITH {BARS}, s AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, " + ", ".join(f"CASE WHEN count(close) OVER {w(p)} = {p} THEN avg(close) OVER {w(p)} END AS m{p}" for p in SMA) + " FROM bars) SELECT symbol, ts, " + ", ".join(f"CASE WHEN n >= 30 THEN round(m{p}, 6) END AS sma_{p}" for p in SMA) + " FROM s")
add("TA_05_bollinger", lambda s, d: rounded(ta.bollinger(walk_bars(s, d)), "bb_middle", "bb_upper", "bb_lower", "bb_width"),
    f"WITH {BARS}, s AS (SELECT *, count(close) OVER {w(20)} AS n, avg(close) OVER {w(20)} AS m, stddev_samp(close) OVER {w(20)} AS sd FROM bars) SELECT symbol, ts, CASE WHEN n=20 THEN round(m,4) END AS bb_middle, CASE WHEN n=20 THEN round(m+2*sd,4) END AS bb_upper, CASE WHEN n=20 THEN round(m-2*sd,4) END AS bb_lower, CASE WHEN n=20 THEN round(4*sd/m,4) END AS bb_width FROM s")
add("TA_08_mfi", lambda s, d: rounded(ta.mfi(walk_bars(s, d)), "mfi"),
    f"WITH {BARS}, a AS (SELECT *, (high+low+close)/3 AS tp FROM bars), b AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY ts) AS pt FROM a), c AS (SELECT symbol, ts, count(tp) OVER {w(14)} AS n, sum(CASE WHEN tp>pt THEN tp*volume ELSE 0.0::DOUBLE END) OVER {w(14)} AS up, sum(CASE WHEN tp<pt THEN tp*volume ELSE 0.0::DOUBLE END) OVER {w(14)} AS dn FROM b) SELECT symbol, ts, CASE WHEN n=14 THEN round(100-100/(1+up/nullif(dn,0)),4) END AS mfi FROM c")
add("TA_09_obv", lambda s, d: rounded(ta.obv(walk_bars(s, d)), "obv"),
    f"WITH {BARS}, a AS (SELECT *, coalesce(sign(close-lag(close) OVER (PARTITION BY symbol ORDER BY ts))*volume,0)::DOUBLE AS st FROM bars) SELECT symbol, ts, round(sum(st) OVER (PARTITION BY symbol ORDER BY ts),4) AS obv FROM a")
add("TA_10_cmf", lambda s, d: rounded(ta.cmf(walk_bars(s, d)), "cmf"),
    f"WITH {BARS}, a AS (SELECT *, CASE WHEN high=low THEN 0.0::DOUBLE ELSE ((close-low)-(high-close))/(high-low) END*volume AS mfv FROM bars) SELECT symbol, ts, CASE WHEN count(close) OVER {w(20)}=20 THEN round(sum(mfv) OVER {w(20)}/nullif(sum(volume) OVER {w(20)},0),4) END AS cmf FROM a")
add("TA_11_roc", lambda s, d: rounded(ta.roc(walk_bars(s, d)), "roc"),
    f"WITH {BARS}, a AS (SELECT *, lag(close,10) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) SELECT symbol, ts, round((close-p)/nullif(p,0)*100,4) AS roc FROM a")
add("TA_12_relative_volume", lambda s, d: rounded(ta.relative_volume(walk_bars(s, d)), "rel_volume"),
    f"WITH {BARS} SELECT symbol, ts, CASE WHEN count(volume) OVER {w(20)}=20 THEN round(volume/nullif(avg(volume) OVER {w(20)},0),4) END AS rel_volume FROM bars")

EMAS = f"""WITH RECURSIVE {BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),
e AS (SELECT symbol, rn, ts, close AS ema_12, close AS ema_26, 0.0::DOUBLE AS sig FROM b WHERE rn = 1
 UNION ALL SELECT b.symbol, b.rn, b.ts, e.ema_12*(1-2.0::DOUBLE/13)+b.close*2.0::DOUBLE/13, e.ema_26*(1-2.0::DOUBLE/27)+b.close*2.0::DOUBLE/27,
 e.sig*0.8::DOUBLE+0.2::DOUBLE*((e.ema_12*(1-2.0::DOUBLE/13)+b.close*2.0::DOUBLE/13)-(e.ema_26*(1-2.0::DOUBLE/27)+b.close*2.0::DOUBLE/27)) FROM e JOIN b ON b.symbol=e.symbol AND b.rn=e.rn+1)"""
add("TA_02_ema", lambda s, d: rounded(ta.exponential(walk_bars(s, d), ("ema_12", "ema_26")), "ema_12", "ema_26"), f"{EMAS} SELECT symbol, ts, round(ema_12,4) AS ema_12, round(ema_26,4) AS ema_26 FROM e")
add("TA_04_macd", lambda s, d: rounded(ta.exponential(walk_bars(s, d), ("macd", "macd_signal", "macd_hist")), "macd", "macd_signal", "macd_hist"), f"{EMAS} SELECT symbol, ts, round(ema_12-ema_26,4) AS macd, round(sig,4) AS macd_signal, round(ema_12-ema_26-sig,4) AS macd_hist FROM e")
RSI = f"""WITH RECURSIVE {BARS}, b AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, greatest(close-lag(close) OVER (PARTITION BY symbol ORDER BY ts),0) AS g, greatest(lag(close) OVER (PARTITION BY symbol ORDER BY ts)-close,0) AS l FROM bars),
e AS (SELECT symbol, ts, rn, g, l FROM b WHERE rn = 2 UNION ALL SELECT b.symbol, b.ts, b.rn, e.g*(1-1.0::DOUBLE/14)+b.g/14, e.l*(1-1.0::DOUBLE/14)+b.l/14 FROM e JOIN b ON b.symbol=e.symbol AND b.rn=e.rn+1)"""
add("TA_03_rsi", lambda s, d: rounded(ta.exponential(walk_bars(s, d), ("rsi",)), "rsi"),
    f"{RSI} SELECT b.symbol, b.ts, CASE WHEN b.rn < 15 THEN NULL WHEN e.l=0 AND e.g>0 THEN 100.0::DOUBLE WHEN e.l=0 THEN 50.0::DOUBLE ELSE round(100-100/(1+e.g/e.l),4) END AS rsi FROM b LEFT JOIN e ON e.symbol=b.symbol AND e.rn=b.rn")
ATR = f"""WITH RECURSIVE {BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars), b AS (SELECT *, greatest(high-low, abs(high-pc), abs(low-pc)) AS tr FROM a),
e AS (SELECT symbol, ts, rn, tr AS v FROM b WHERE rn=1 UNION ALL SELECT b.symbol, b.ts, b.rn, e.v*(1-1.0::DOUBLE/14)+b.tr/14 FROM e JOIN b ON b.symbol=e.symbol AND b.rn=e.rn+1)"""
add("TA_06_atr", lambda s, d: rounded(ta.exponential(walk_bars(s, d), ("atr",)), "atr"), f"{ATR} SELECT symbol, ts, CASE WHEN rn>=14 THEN round(v,4) END AS atr FROM e")
add("TA_07_adx", lambda s, d: rounded(ta.exponential(walk_bars(s, d), ("plus_di", "minus_di", "adx")), "plus_di", "minus_di", "adx"))
add("TA_02_07_by_chunk", lambda s, d: rounded(ta.exponential_by_chunk(walk_bars(s, d, "n_name")), *ta.RECURSIVE, digits=4))
add("TA_13_all_indicators", lambda s, d: ta.exponential(ta.relative_volume(ta.roc(ta.cmf(ta.obv(ta.mfi(ta.bollinger(ta.sma(walk_bars(s, d, "n_name"), (20,)))))))), ("rsi", "macd_hist", "atr", "adx"))
    .select("symbol", "ts", *[F.round(c, 4).alias(c) for c in ("sma_20", "bb_upper", "mfi", "obv", "cmf", "roc", "rel_volume", "rsi", "macd_hist", "atr", "adx")]))
add("TA_14_trend", lambda s, d: ta.trend(walk_bars(s, d, "n_name")).select("symbol", F.col("score").cast("long").alias("score"), "label", F.round("from_high", 4).alias("from_high"), F.round("from_low", 4).alias("from_low")),
    f"WITH {NATION_BARS}, s AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, " + ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY symbol)>=30 AND count(close) OVER {w(p)}={p} THEN avg(close) OVER {w(p)} END AS m{p}" for p in (20, 50, 200)) + f", max(close) OVER {w(20)} AS hi, min(close) OVER {w(20)} AS lo, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars), t AS (SELECT *, (CASE WHEN m20 IS NULL THEN 0 WHEN close>m20 THEN 1 ELSE -1 END + CASE WHEN m50 IS NULL THEN 0 WHEN close>m50 THEN 2 ELSE -2 END + CASE WHEN m200 IS NULL THEN 0 WHEN close>m200 THEN 3 ELSE -3 END + CASE WHEN m20 IS NULL OR m50 IS NULL THEN 0 WHEN m20>m50 THEN 1 ELSE -1 END)::BIGINT AS score FROM s WHERE rn=1) SELECT symbol, score, CASE WHEN score>=3 THEN 'strong_up' WHEN score>0 THEN 'up' WHEN score=0 THEN 'flat' WHEN score>-3 THEN 'down' ELSE 'strong_down' END AS label, round((close-hi)/hi*100,4) AS from_high, round((close-lo)/lo*100,4) AS from_low FROM t")
add("TA_15_support_resistance", lambda s, d: ta.support_resistance(walk_bars(s, d, "n_name")),
    f"""WITH {NATION_BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn, last_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM bars),
 b AS (SELECT *, count(*) OVER m AS k, max(high) OVER m AS mh, min(low) OVER m AS ml FROM a WHERE rn<=120 WINDOW m AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
 g AS (SELECT symbol, count(*) AS n, max(now) AS now, list_sort(list(DISTINCT high) FILTER (k=11 AND high=mh)) AS t, list_sort(list(DISTINCT low) FILTER (k=11 AND low=ml)) AS l FROM b GROUP BY symbol),
 h AS (SELECT symbol, n, CASE WHEN len(list_filter(t, lambda x: x>now))>0 THEN list_filter(t, lambda x: x>now) ELSE list_reverse(t) END AS r, CASE WHEN len(list_filter(l, lambda x: x<now))>0 THEN list_reverse(list_filter(l, lambda x: x<now)) ELSE l END AS s FROM g)
 SELECT symbol, CASE WHEN n>=20 THEN s[1] END AS support_1, CASE WHEN n>=20 THEN s[2] END AS support_2, CASE WHEN n>=20 THEN r[1] END AS resistance_1, CASE WHEN n>=20 THEN r[2] END AS resistance_2 FROM h""")  # fmt: skip

STEPS = {"ret_5": 5, "ret_10": 10, "ret_20": 20, "ret_60": 60, "ret_120": 120}


def lag_sql(steps):
    return f"WITH {NATION_BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn, " + ", ".join(f"lag(close,{n}) OVER (PARTITION BY symbol ORDER BY ts) AS p{n}" for n in steps.values()) + " FROM bars) SELECT symbol, " + ", ".join(f"round((close/p{n}-1)*100,4) AS {k}" for k, n in steps.items()) + " FROM a WHERE rn=1"


add("PX_01_momentum", lambda s, d: rounded(px.bar_returns(walk_bars(s, d, "n_name"), STEPS), *STEPS), lag_sql(STEPS))
SCREEN = {"change_1m": 21, "change_3m": 63, "change_1y": 250}
add("PX_05_screener_returns", lambda s, d: rounded(px.bar_returns(walk_bars(s, d, "n_name"), SCREEN), *SCREEN), lag_sql(SCREEN))
CAL = {"ret_7d": "ends - INTERVAL 7 DAY", "ret_30d": "ends - INTERVAL 30 DAY", "ret_91d": "ends - INTERVAL 91 DAY", "ret_182d": "ends - INTERVAL 182 DAY", "ret_365d": "ends - INTERVAL 365 DAY", "ret_ytd": "make_date(year(ends)-1,12,31)::TIMESTAMP"}
add("PX_04_JN_05_calendar_returns", lambda s, d: rounded(px.calendar_returns(walk_bars(s, d, "n_name")), *CAL),
    f"WITH {NATION_BARS}, a AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS ends FROM bars), g AS (SELECT symbol, max_by(close, ts) AS now, min(ts) AS st, max(ts) AS ends, " + ", ".join(f"max_by(close, ts) FILTER (ts <= {v}) AS {k}" for k, v in CAL.items()) + " FROM a GROUP BY symbol) SELECT symbol, " + ", ".join((f"CASE WHEN date_diff('day', st::DATE, ends::DATE)>=360 THEN round((now/{k}-1)*100,4) END" if k == "ret_365d" else f"round((now/{k}-1)*100,4)") + f" AS {k}" for k in CAL) + " FROM g")
add("RK_01_02_risk", lambda s, d: px.risk(walk_bars(s, d, "n_name")).select("symbol", F.round("volatility", 6).alias("volatility"), F.round("max_drawdown", 6).alias("max_drawdown")),
    f"WITH {NATION_BARS}, a AS (SELECT *, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS ret, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS pk, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) SELECT symbol, CASE WHEN count(ret) FILTER (rn<=30)>=5 THEN round(stddev_samp(ret) FILTER (rn<=30),6) END AS volatility, round(min((close-pk)/pk),6) AS max_drawdown FROM a GROUP BY symbol")
INDEX = f"WITH {BARS}, ix AS (SELECT ts, close FROM bars WHERE symbol='ASIA')"
add("RK_03_JN_01_beta", lambda s, d: px.beta(walk_bars(s, d), walk_bars(s, d).where("symbol = 'ASIA'")).select("symbol", F.round("beta", 4).alias("beta"), "n"),
    f"{INDEX}, a AS (SELECT symbol, ts, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS ret FROM bars), m AS (SELECT ts, close/lag(close) OVER (ORDER BY ts)-1 AS mk FROM ix) SELECT symbol, CASE WHEN count(*)>=60 AND var_samp(mk)<>0 THEN round(covar_samp(ret,mk)/var_samp(mk),4) END AS beta, count(*) AS n FROM a JOIN m USING(ts) WHERE ret IS NOT NULL AND mk IS NOT NULL GROUP BY symbol")
add("PX_02_JN_02_relative_strength", lambda s, d: px.relative_strength(walk_bars(s, d), walk_bars(s, d).where("symbol = 'ASIA'")).select("symbol", *[F.round(c, 4).alias(c) for c in ("ret", "index_ret", "difference")], "outperforms"),
    f"{INDEX}, j AS (SELECT symbol, b.ts, b.close, ix.close AS mk, row_number() OVER (PARTITION BY symbol ORDER BY b.ts DESC) AS rn FROM bars b JOIN ix USING(ts)), g AS (SELECT symbol, (max_by(close,ts)/min_by(close,ts)-1)*100 AS r, (max_by(mk,ts)/min_by(mk,ts)-1)*100 AS i FROM j WHERE rn<=60 GROUP BY symbol) SELECT symbol, round(r,4) AS ret, round(i,4) AS index_ret, round(r-i,4) AS difference, r>i AS outperforms FROM g")
add("PX_09_rebased", lambda s, d: px.rebased(walk_bars(s, d)).select("symbol", "ts", F.round("rebased", 4).alias("rebased")),
    f"WITH {BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) SELECT symbol, ts, round(close/first_value(close) OVER (PARTITION BY symbol ORDER BY ts)*100,4) AS rebased FROM a WHERE rn<=126")

SNAP = f"""WITH {NATION_BARS}, a AS (SELECT *, (close/lag(close) OVER s-1)*100 AS change, (close/lag(close,5) OVER s-1)*100 AS ret_5, (close/lag(close,20) OVER s-1)*100 AS ret_20,
 CASE WHEN count(close) OVER {w(20)}=20 THEN close>avg(close) OVER {w(20)} END AS above_ma20,
 CASE WHEN count(close) OVER p=20 THEN close>max(close) OVER p END AS new_high, CASE WHEN count(close) OVER p=20 THEN close<min(close) OVER p END AS new_low, close*volume AS value, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn
 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), snap AS (SELECT * FROM a WHERE rn=1 AND ts >= (SELECT max(ts) FROM a WHERE rn=1) - INTERVAL 3 DAY)"""
add("AG_02_breadth", lambda s, d: (b := px.breadth(px.snapshot(walk_bars(s, d, "n_name")))).select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in b.dtypes]),
    f"{SNAP}, g AS (SELECT count(*) FILTER (change>0.0001) AS u, count(*) FILTER (change< -0.0001) AS dn, count(change) AS n, avg(above_ma20::INT)*100 AS pa, count(*) FILTER (new_high) AS nh, count(*) FILTER (new_low) AS nl, sum(value) AS v, avg(change) AS mc FROM snap) SELECT u AS advancers, dn AS decliners, n-u-dn AS unchanged, round(u/nullif(dn,0)::DOUBLE,4) AS ad_ratio, round(pa,4) AS pct_above_ma20, nh AS new_highs, nl AS new_lows, round(v,4) AS total_value, round(mc,4) AS mean_change FROM g")


def sectors(s, d):
    from tidemark.plans.bars import table

    geo = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    out = px.sector_performance(px.snapshot(walk_bars(s, d, "n_name")).join(F.broadcast(geo), "symbol"))
    return out.select("sector", *[F.round(c, 4).alias(c) for c in ("change_1d", "ret_5", "ret_20", "value")], "advancers", "decliners", "symbols")


add("AG_04_JN_08_sectors", sectors, f"{SNAP} SELECT r_name AS sector, round(coalesce(sum(change*value)/nullif(sum(value) FILTER (change IS NOT NULL),0), avg(change)),4) AS change_1d, round(avg(ret_5),4) AS ret_5, round(avg(ret_20),4) AS ret_20, round(sum(value),4) AS value, count(*) FILTER (change>0) AS advancers, count(*) FILTER (change<0) AS decliners, count(*) AS symbols FROM snap JOIN nation ON n_name=symbol JOIN region ON r_regionkey=n_regionkey GROUP BY r_name")


def movers(s, d):
    snap = px.snapshot(walk_bars(s, d, "n_name")).where("change is not null")
    return snap.orderBy(F.desc("change"), "symbol").limit(10).select("symbol", F.round("change", 4).alias("change"), "volume")


add("TK_01_top_movers", movers, f"{SNAP} SELECT symbol, round(change,4) AS change, volume FROM snap WHERE change IS NOT NULL ORDER BY change DESC, symbol LIMIT 10")


def screener(s, d):
    from tidemark.plans.bars import table

    p = table(s, d, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_retailprice") / F.col("p_size") - 25).alias("pe"), (F.col("p_partkey") % 37 - 5).cast("double").alias("roe"), (F.col("p_size") % 11).cast("double").alias("pb"))
    kept = p.where(px.conjunction(p, [("pe", "<=", 60), ("roe", ">=", 0)]))
    return px.composite_rank(kept, {"pe": 1, "roe": 1, "pb": 0.5}).select("symbol", F.round("pe", 6).alias("pe"), "roe", "pb", "score")


add("FL_01_RN_01_screener", screener, """WITH p AS (SELECT p_partkey AS symbol, p_retailprice/p_size-25 AS pe, (p_partkey%37-5)::DOUBLE AS roe, (p_size%11)::DOUBLE AS pb FROM part), k AS (SELECT * FROM p WHERE pe<=60 AND roe>=0),
 v AS (SELECT symbol, CASE WHEN pe>0 THEN pe END AS a, roe AS b, CASE WHEN pb>0 THEN pb END AS c FROM k),
 r AS (SELECT symbol, CASE WHEN a IS NOT NULL THEN (rank() OVER (PARTITION BY a IS NULL ORDER BY a DESC)+(count(*) OVER (PARTITION BY a)-1)/2.0::DOUBLE)/count(a) OVER () END AS x, (rank() OVER (ORDER BY b)+(count(*) OVER (PARTITION BY b)-1)/2.0::DOUBLE)/count(b) OVER () AS y,
 CASE WHEN c IS NOT NULL THEN (rank() OVER (PARTITION BY c IS NULL ORDER BY c DESC)+(count(*) OVER (PARTITION BY c)-1)/2.0::DOUBLE)/count(c) OVER () END AS z FROM v)
 SELECT k.symbol, round(pe,6) AS pe, roe, pb, round((coalesce(x,0)+coalesce(y,0)+coalesce(z,0)*0.5::DOUBLE)/2.5::DOUBLE*100,1) AS score FROM k JOIN r USING(symbol)""")  # fmt: skip

SIGNAL = f"sig AS (SELECT *, CASE WHEN count(close) OVER {w(20)}=20 THEN avg(close) OVER {w(20)} END AS f, CASE WHEN count(close) OVER {w(50)}=50 THEN avg(close) OVER {w(50)} END AS sl FROM bars), s2 AS (SELECT symbol, ts, open, close, CASE WHEN f>sl THEN 1 WHEN f<sl THEN -1 ELSE 0 END AS signal FROM sig)"
add("BT_01_ma_cross", lambda s, d: bt.ma_cross(walk_bars(s, d)).select("symbol", "ts", "signal"), f"WITH {BARS}, {SIGNAL} SELECT symbol, ts, signal FROM s2")
FOLD = f"""WITH RECURSIVE {BARS}, {SIGNAL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, lag(signal,1,0) OVER (PARTITION BY symbol ORDER BY ts) AS act FROM s2),
e AS (SELECT symbol, rn, ts, 1e8::DOUBLE AS cash, 0::BIGINT AS held, close FROM b WHERE rn=1
 UNION ALL SELECT symbol, rn, ts, CASE WHEN q>0 THEN cash - q*bp*(1+0.0015::DOUBLE) WHEN out THEN cash + held*(open*(1-0.001::DOUBLE))*(1-0.0015::DOUBLE) ELSE cash END, CASE WHEN q>0 THEN q WHEN out THEN 0 ELSE held END, close
 FROM (SELECT b.symbol, b.rn, b.ts, b.open, b.close, e.cash, e.held, b.open*(1+0.001::DOUBLE) AS bp, CASE WHEN b.act=1 AND e.held=0 THEN (floor(e.cash*0.95::DOUBLE/(b.open*(1+0.001::DOUBLE))/100)*100)::BIGINT ELSE 0 END AS q, b.act=-1 AND e.held>0 AS out FROM e JOIN b ON b.symbol=e.symbol AND b.rn=e.rn+1))"""
add("BT_04_equity", lambda s, d: bt.equity(bt.ma_cross(walk_bars(s, d))).select("symbol", "ts", F.round("equity", 2).alias("equity"), "shares"), f"{FOLD} SELECT symbol, ts, round(cash+held*close,2) AS equity, held AS shares FROM e")
add("BT_05_metrics", lambda s, d: (m := bt.metrics(bt.equity(bt.ma_cross(walk_bars(s, d))))).select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes]))
ORACLE["BT_05_metrics"] = f"""WITH RECURSIVE {BARS}, {SIGNAL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n, lag(signal,1,0) OVER (PARTITION BY symbol ORDER BY ts) AS act FROM s2),
e AS (SELECT symbol, rn, n, ts, 1e8::DOUBLE AS cash, 0::BIGINT AS held, 0::DOUBLE AS cost, NULL::DOUBLE AS pnl, close FROM b WHERE rn=1
 UNION ALL SELECT symbol, rn, n, ts, CASE WHEN q>0 THEN cash - q*bp*(1+0.0015::DOUBLE) WHEN out THEN cash + got ELSE cash END, CASE WHEN q>0 THEN q WHEN out THEN 0 ELSE held END, CASE WHEN q>0 THEN q*bp*(1+0.0015::DOUBLE) ELSE cost END, CASE WHEN out THEN got - cost END, close
 FROM (SELECT b.symbol, b.rn, b.n, b.ts, b.close, e.cash, e.held, e.cost, b.open*(1+0.001::DOUBLE) AS bp, e.held*(b.open*(1-0.001::DOUBLE))*(1-0.0015::DOUBLE) AS got, CASE WHEN b.act=1 AND e.held=0 THEN (floor(e.cash*0.95::DOUBLE/(b.open*(1+0.001::DOUBLE))/100)*100)::BIGINT ELSE 0 END AS q, b.act=-1 AND e.held>0 AS out FROM e JOIN b ON b.symbol=e.symbol AND b.rn=e.rn+1)),
f AS (SELECT symbol, ts, cash+held*close AS eq, CASE WHEN rn=n AND held>0 THEN held*close*(1-0.0015::DOUBLE)-cost ELSE pnl END AS pnl FROM e), g AS (SELECT *, eq/lag(eq) OVER (PARTITION BY symbol ORDER BY ts)-1 AS ret, max(eq) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM f),
h AS (SELECT symbol, max_by(eq, ts) AS final, date_diff('day', min(ts), max(ts)) AS days, min(eq/pk-1) AS mdd, stddev_samp(ret)*sqrt(252.0::DOUBLE) AS vol, count(pnl) AS trades, count(*) FILTER (pnl>0) AS wins, coalesce(sum(pnl) FILTER (pnl>0),0) AS won, coalesce(sum(-pnl) FILTER (pnl<=0),0) AS lost FROM g GROUP BY symbol),
k AS (SELECT *, CASE WHEN days>0 THEN pow(final/1e8::DOUBLE, 365.0::DOUBLE/days)-1 END AS growth FROM h)
SELECT symbol, round((final/1e8-1)*100,4) AS total_return, round(growth*100,4) AS cagr, round(mdd*100,4) AS max_drawdown, round(vol*100,4) AS volatility, round((growth-0.04::DOUBLE)/nullif(vol,0),4) AS sharpe, trades, round(wins*100.0::DOUBLE/nullif(trades,0),4) AS win_rate, CASE WHEN lost>0 THEN round(won/lost,4) WHEN won>0 THEN 'inf'::DOUBLE END AS profit_factor FROM k"""
add("BT_02_rsi_equity", lambda s, d: bt.equity(bt.rsi_reversion(ta.exponential(walk_bars(s, d), ("rsi",)))).select("symbol", "ts", F.round("equity", 2).alias("equity"), "shares"))
add("BT_06_buy_and_hold", lambda s, d: bt.buy_and_hold(walk_bars(s, d)).select("symbol", F.round("total_return", 4).alias("total_return"), F.round("max_drawdown", 4).alias("max_drawdown")),
    f"WITH {BARS}, a AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM bars) SELECT symbol, round((max_by(close,ts)/min_by(close,ts)-1)*100,4) AS total_return, round(min(close/pk-1)*100,4) AS max_drawdown FROM a GROUP BY symbol")
