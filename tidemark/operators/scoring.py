"""Scores of 0 to 100 from point ladders, fair values, peer medians and portfolio results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The ladders (bound, points) in the order of their branches, points below the last bound, and the most points.
VOLATILITY = ([(0.2, 30), (0.35, 22), (0.5, 14), (0.7, 7)], 2)
DRAWDOWN = ([(0.10, 30), (0.20, 22), (0.30, 14), (0.50, 7)], 2)
LEVERAGE = ([(0.5, 20), (1.0, 14), (2.0, 7)], 2)
ROE = ([(20, 25), (15, 18), (10, 12), (0, 5)], 0)
GROWTH = ([(20, 20), (10, 15), (0, 10), (-10, 5)], 0)
MARGIN = ([(20, 20), (10, 14), (5, 8), (0, 3)], 0)
DEBT = ([(0.5, 20), (1.0, 15), (1.5, 10), (2.0, 5)], 0)
SHORT = ([(5, 25), (2, 18), (0, 12), (-2, 6)], 0)
MEDIUM = ([(10, 20), (3, 14), (0, 8), (-5, 4)], 0)
LONG = ([(20, 20), (5, 14), (0, 8), (-10, 4)], 0)
STRENGTH = ([(10, 20), (3, 15), (0, 10), (-5, 5)], 0)
TO_PEERS = ([(1.0, 35), (1.3, 20)], 5)
PE_ALONE = ([(20, 35), (30, 20)], 5)
PB_ALONE = ([(1.5, 35), (3, 20)], 5)
WEIGHTS = {"technical": 25, "momentum": 20, "fundamental": 25, "valuation": 20, "risk": 10}
CLASSES = [(80, "outstanding"), (65, "positive"), (50, "neutral"), (35, "cautious")]
#: Open bounds of a plausible peer metric, most and fewest peers.
BOUNDS = {"pe": (0, 100), "pb": (0, 20), "roe": (-100, 100), "net_margin": (-100, 100), "debt_equity": (0, 20)}
MOST_PEERS, FEWEST_PEERS = 8, 3


def ladder(x: Column, steps: tuple[list, float], way: str) -> Column:
    """Points of the first step that holds x: way is one of `<`, `<=`, `>`, `>=`; null stays null."""
    test = {"<": lambda b: x < b, "<=": lambda b: x <= b, ">": lambda b: x > b, ">=": lambda b: x >= b}[way]
    (bound, points), *more = steps[0]
    branches = reduce(lambda acc, s: acc.when(test(s[0]), s[1]), more, F.when(x.isNull(), None).when(test(bound), points))
    return branches.otherwise(steps[1]).cast("double")


def share(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """(score, coverage): points over the most points of the parts that are there, rounded half to even, and those most points."""
    got = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p, _ in parts])
    most = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), float(m)).otherwise(0.0) for p, m in parts])
    return F.bround(F.try_divide(got, most) * 100, 0), most


def risk_score(df: DataFrame) -> DataFrame:
    """Adds risk_score and risk_coverage from volatility (daily), max_drawdown, beta and debt_equity; higher is less risk."""
    b = F.col("beta")
    beta = F.when(b.isNull(), None).when(b.between(0.5, 1.2), 20).when(b < 0.5, 15).when(b <= 1.5, 12).otherwise(5).cast("double")
    score, most = share([
        (ladder(F.col("volatility") * F.sqrt(F.lit(252.0)), VOLATILITY, "<"), 30), (ladder(F.abs("max_drawdown"), DRAWDOWN, "<"), 30),
        (beta, 20), (ladder(F.col("debt_equity"), LEVERAGE, "<="), 20),
    ])
    return df.withColumns({"risk_score": score, "risk_coverage": most})


def momentum_score(df: DataFrame) -> DataFrame:
    """Adds momentum_score from returns in percent (ret_5, ret_10, ret_20, ret_60, ret_120), the difference to the index and rsi; half a pair that is missing counts as 0."""

    def pair(a, b, x, y):
        return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), x * F.coalesce(a, F.lit(0.0)) + y * F.coalesce(b, F.lit(0.0)))

    r = F.col("rsi")
    rsi = F.when(r.isNull(), None).when(r.between(50, 70), 15).when(((r >= 40) & (r < 50)) | ((r > 70) & (r <= 80)), 8).when((r > 80) | (r < 30), 2).otherwise(5).cast("double")
    score, _ = share([
        (ladder(pair("ret_5", "ret_10", 0.4, 0.6), SHORT, ">"), 25), (ladder(F.col("ret_20"), MEDIUM, ">"), 20), (ladder(pair("ret_60", "ret_120", 0.5, 0.5), LONG, ">"), 20),
        (ladder(F.col("difference"), STRENGTH, ">"), 20), (rsi, 15),
    ])
    return df.withColumn("momentum_score", score)


def fundamental_score(df: DataFrame) -> DataFrame:
    """Adds fundamental_score from roe, revenue_growth, net_margin, debt_equity, cfo and net_income."""
    cfo, ni = F.col("cfo"), F.col("net_income")
    cash = F.when(cfo.isNull(), None).when(cfo <= 0, 0).when(ni.isNull() | (ni <= 0), 8).when(cfo / F.nullif(ni, F.lit(0.0)) >= 1, 15).when(cfo / F.nullif(ni, F.lit(0.0)) >= 0.5, 10).otherwise(5).cast("double")
    score, _ = share([
        (ladder(F.col("roe"), ROE, ">="), 25), (ladder(F.col("revenue_growth"), GROWTH, ">="), 20), (ladder(F.col("net_margin"), MARGIN, ">="), 20),
        (ladder(F.col("debt_equity"), DEBT, "<="), 20), (cash, 15),
    ])
    return df.withColumn("fundamental_score", score)


def valuation_score(df: DataFrame) -> DataFrame:
    """Adds valuation_score from pe and pb, against peer_pe and peer_pb where they are positive, else by themselves."""

    def part(x, peer, alone, cheap):
        to_peer = x / F.nullif(peer, F.lit(0.0))
        against = F.when(to_peer < 0.7, 50.0).otherwise(ladder(to_peer, TO_PEERS, "<="))
        return F.when(peer > 0, against).when(x < cheap, 50.0).otherwise(ladder(x, alone, "<="))

    pe, pb = F.col("pe"), F.col("pb")
    parts = [(F.when(pe <= 0, 0.0).otherwise(part(pe, F.col("peer_pe"), PE_ALONE, 12)), 50), (F.when(pb > 0, part(pb, F.col("peer_pb"), PB_ALONE, 1)), 50)]
    return df.withColumn("valuation_score", share([(F.when(F.col(c).isNotNull(), p), m) for c, (p, m) in zip(("pe", "pb"), parts)])[0])


def composite_score(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds score, coverage and category: the weighted mean of the columns `<group>_score` that are there, each held to 0..100."""
    total = sum(weights.values())
    parts = [(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(f"{g}_score"))), w * 100 / total) for g, w in weights.items()]
    got = reduce(lambda a, b: a + b, [F.coalesce(F.when(p.isNotNull() & F.col(f"{g}_score").isNotNull(), p * w), F.lit(0.0)) for g, (p, w) in zip(weights, parts)])
    have = reduce(lambda a, b: a + b, [F.when(F.col(f"{g}_score").isNotNull(), w).otherwise(0.0) for g, (_, w) in zip(weights, parts)])
    df = df.withColumns({"score": F.bround(F.try_divide(got, have), 0), "coverage": F.bround(have, 0)})
    (bound, name), *more = CLASSES
    label = reduce(lambda acc, c: acc.when(F.col("score") >= c[0], c[1]), more, F.when(F.col("score").isNull(), None).when(F.col("score") >= bound, name))
    return df.withColumn("category", label.otherwise("high risk"))


def peer_medians(metrics: DataFrame) -> DataFrame:
    """Medians over each symbol's first peers of its sector, in the order of `place`: itself excluded, values outside the bounds left out.

    `metrics` has (symbol, sector, place) and the metrics of BOUNDS, one row a symbol; equal places go by symbol. A symbol's peers are all among the first
    nine of its sector, so that the join meets at most nine rows a symbol. A median takes three values at least.
    """
    w = Window.partitionBy("sector").orderBy("place", "symbol")
    heads = metrics.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MOST_PEERS + 1)
    peers = heads.select("sector", F.col("symbol").alias("peer"), "rn", *[F.col(c).alias(f"p_{c}") for c in BOUNDS])
    pairs = metrics.select("symbol", "sector").join(peers, "sector").where("symbol <> peer")
    first = pairs.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("rn"))).where(F.col("k") <= MOST_PEERS)

    def inside(c):
        lo, hi = BOUNDS[c]
        return F.when((F.col(f"p_{c}") > lo) & (F.col(f"p_{c}") < hi), F.col(f"p_{c}"))

    out = first.groupBy("symbol", "sector").agg(
        F.count(F.coalesce(*[F.col(f"p_{c}") for c in BOUNDS])).alias("peers"), *[F.count(inside(c)).alias(f"n_{c}") for c in BOUNDS],
        *[F.when(F.count(inside(c)) >= FEWEST_PEERS, F.bround(F.percentile(inside(c), 0.5), 2)).alias(f"peer_{c}") for c in BOUNDS],
    )
    return out


def relative_value(df: DataFrame) -> DataFrame:
    """Adds fair values from eps, bvps and peer multiples (15 and 1.5 where there is no peer multiple), their mean and its distance from price in percent."""
    pe, pb = F.col("eps") * F.when(F.col("peer_pe") > 0, F.col("peer_pe")).otherwise(15.0), F.col("bvps") * F.when(F.col("peer_pb") > 0, F.col("peer_pb")).otherwise(1.5)
    df = df.withColumns({"fair_pe": F.when(F.col("eps") > 0, pe), "fair_pb": F.when(F.col("bvps") > 0, pb)})
    n = F.col("fair_pe").isNotNull().cast("int") + F.col("fair_pb").isNotNull().cast("int")
    df = df.withColumn("fair", F.try_divide(F.coalesce("fair_pe", F.lit(0.0)) + F.coalesce("fair_pb", F.lit(0.0)), n))
    return df.withColumn("upside", F.try_divide(F.col("fair") - F.col("price"), "price") * 100)


def discounted_value(df: DataFrame, growth: float = 0.10, terminal: float = 0.04, rate: float = 0.12, years: int = 5) -> DataFrame:
    """Adds bear, base and bull: eps grown over `years`, discounted, with a perpetuity after (20 times the last flow if the rate is not above its growth); null unless eps > 0."""

    def value(g, t, r):
        flows = sum(((1 + g) / (1 + r)) ** y for y in range(1, years + 1))
        last = (1 + g) ** years * ((1 + t) / (r - t) if r > t else 20)
        return F.when(F.col("eps") > 0, F.bround(F.col("eps") * (flows + last / (1 + r) ** years), 0))

    return df.withColumns({"bear": value(growth * 0.5, terminal * 0.8, rate * 1.1), "base": value(growth, terminal, rate), "bull": value(growth * 1.5, terminal * 1.2, rate * 0.9)})


def positions(held: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_basis with the fee, current_value, pnl, pnl_pct and weight (percent of its portfolio's value) of each position; a symbol without a price counts as 0.

    `held` has (portfolio, symbol, quantity, buy_price, fee_pct), `prices` (symbol, price).
    """
    px = F.coalesce("price", F.lit(0.0))
    cost, value = F.col("buy_price") * F.col("quantity") * (1 + F.col("fee_pct")), px * F.col("quantity")
    rows = held.join(prices, "symbol", "left").select(
        *held.columns, F.bround(cost, 0).alias("cost_basis"), F.bround(value, 0).alias("current_value"),
        F.bround(value - cost, 0).alias("pnl"), F.bround(F.coalesce(F.try_divide(value - cost, cost), F.lit(0.0)) * 100, 2).alias("pnl_pct"),
    )
    whole = rows.groupBy("portfolio").agg(F.sum("current_value").alias("whole"))
    return rows.join(whole, "portfolio").withColumn("weight", F.coalesce(F.try_divide("current_value", "whole"), F.lit(0.0)) * 100).drop("whole")


#: Ladders of the technical score and of the older market health.
REL_VOLUME = ([(1.5, 10), (1, 7), (0.7, 3)], 0)
MONEY_FLOW = ([(0.10, 5), (0, 3), (-0.10, 1)], 0)
ADVANCE = ([(2.0, 30), (1.5, 22), (1.0, 15), (0.5, 8)], 2)


def technical_score(ind: DataFrame) -> DataFrame:
    """Adds technical_score and technical_max, the points that its indicators could give, to the columns of technical.all_indicators."""
    c = F.col
    above = [(F.when(c(f"sma_{p}").isNotNull() & c("close").isNotNull(), (c("close") > c(f"sma_{p}")).cast("int") * float(m)), m) for p, m in ((200, 10), (50, 8), (20, 7))]
    r, hist, prev = c("rsi"), c("macd_hist"), F.coalesce("prev_hist", "macd_hist")
    rsi = F.when(r.isNull(), None).when(r.between(50, 70), 15.0).when(((r >= 40) & (r < 50)) | ((r > 70) & (r <= 80)), 8.0).when((r > 80) | (r < 30), 0.0).otherwise(4.0)
    macd = F.when(hist.isNull(), None).when((hist > 0) & (hist > prev), 15.0).when(hist > 0, 9.0).when(hist > prev, 6.0).otherwise(0.0)
    band = F.when(c("bb_upper").isNull(), None).when((c("close") > c("bb_middle")) & (c("close") <= c("bb_upper")), 10.0).when(c("close") > c("bb_upper"), 4.0).when(c("close") > c("bb_lower"), 5.0).otherwise(0.0)
    up = c("plus_di") > c("minus_di")
    adx = F.when(c("adx").isNull(), None).when(c("adx") >= 25, F.when(up, 10.0).otherwise(0.0)).when(c("adx") >= 20, F.when(up, 6.0).otherwise(2.0)).otherwise(4.0)
    m = c("mfi")
    mfi = F.when(m.isNull(), None).when(m.between(50, 80), 5.0).when((m >= 40) & (m < 50), 3.0).when(m > 80, 2.0).otherwise(0.0)
    obv = F.when(c("obv_sma").isNull(), None).when(c("obv") > c("obv_sma"), 5.0).when(c("obv") > c("obv_5"), 2.0).otherwise(0.0)
    score, most = share([*above, (rsi, 15), (macd, 15), (ladder(c("rel_volume"), REL_VOLUME, ">"), 10), (band, 10), (adx, 10), (ladder(c("cmf"), MONEY_FLOW, ">"), 5), (mfi, 5), (obv, 5)])
    return ind.withColumns({"technical_score": score, "technical_max": most})


def market_health(df: DataFrame) -> DataFrame:
    """Adds health and its label from an index's close, sma_20, sma_50, sma_200, rsi and ret_20, and a market's advancers, decliners and pct_above_ma20; parts without input drop out of the weights."""
    c = F.col
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    over = [F.when(c("close") > c(f"sma_{p}"), 100.0).when(c(f"sma_{p}").isNotNull(), 0.0) for p in (20, 50, 200)]
    known = sum((x.isNotNull().cast("int") for x in over), F.lit(0))
    trend = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in over), F.lit(0.0)), known)
    advance = F.coalesce(F.try_divide(c("advancers") * 100.0, c("advancers") + c("decliners")), F.lit(50.0))
    parts = [(trend, 35), (F.when(c("rsi").isNotNull(), held((c("rsi") - 30) / 40 * 100)), 20), ((advance + c("pct_above_ma20")) / 2, 30), (F.when(c("ret_20").isNotNull(), held(50 + 6 * c("ret_20"))), 15)]
    got = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    have = sum((F.when(p.isNotNull(), w).otherwise(0) for p, w in parts), F.lit(0))
    health = F.bround(F.try_divide(got, have), 0)
    return df.withColumn("health", health).withColumn("health_label", F.when(c("health").isNull(), None).when(c("health") >= 65, "positive").when(c("health") >= 50, "fair").when(c("health") >= 35, "cautious").otherwise("weak"))


def older_market_health(df: DataFrame) -> DataFrame:
    """Adds health from ad_ratio, above_ma50, rsi and foreign_net; parts without input leave both sums."""
    r, net = F.col("rsi"), F.col("foreign_net")
    rsi = F.when(r.isNull(), None).when(r.between(50, 65), 25.0).when((r >= 40) & (r < 50), 15.0).when(r > 65, 10.0).otherwise(5.0)
    foreign = F.when(net.isNull(), None).when(net > 0, 20.0).when(net > -100e9, 10.0).otherwise(3.0)
    index = F.when(F.col("above_ma50").isNull(), None).when(F.col("above_ma50"), 25.0).otherwise(5.0)
    return df.withColumn("health", share([(ladder(F.col("ad_ratio"), ADVANCE, ">"), 30), (index, 25), (rsi, 25), (foreign, 20)])[0])
