"""Rule signals and the one-position backtest, folded over each symbol's bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.technical import by_ts, full, last

#: Starting capital, fee, slippage, share of capital used and lot.
CAPITAL, FEE, SLIPPAGE, USED, LOT = 1e8, 0.0015, 0.001, 0.95, 100


def ma_cross(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """signal 1 where the fast average is above the slow one, -1 below, 0 without both or when equal."""
    a, b = full(F.avg("close").over(last(fast)), "close", fast), full(F.avg("close").over(last(slow)), "close", slow)
    return bars.withColumns({"fast": a, "slow": b}).withColumn("signal", F.when(F.col("fast") > F.col("slow"), 1).when(F.col("fast") < F.col("slow"), -1).otherwise(0)).drop("fast", "slow")


def rsi_reversion(bars: DataFrame) -> DataFrame:
    """signal 1 below 30, -1 above 70; bars need an rsi column."""
    return bars.withColumn("signal", F.when(F.col("rsi") < 30, 1).when(F.col("rsi") > 70, -1).otherwise(0))


def rules(bars: DataFrame, entry: Column, leave: Column) -> DataFrame:
    """signal -1 where `leave` holds, else 1 where `entry` does; null counts as false."""
    return bars.withColumn("signal", F.when(F.coalesce(leave, F.lit(False)), -1).when(F.coalesce(entry, F.lit(False)), 1).otherwise(0))


def equity(signals: DataFrame, capital: float = CAPITAL, fee: float = FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """(symbol, ts, equity, shares, trade_pnl): the signal acts on the next bar's open; one position at a time, in lots.

    trade_pnl is set on bars where a position is closed. A position still open is closed at the last close without slippage; that
    trade is logged but the curve is not marked again. A symbol's bars are one group, bounded by the calendar.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", ignore_index=True)
        cash, held, cost, out = capital, 0, 0.0, []
        before = 0
        for i, (o, c, s) in enumerate(zip(g["open"], g["close"], g["signal"])):
            pnl = None
            if before == 1 and held == 0:
                price = o * (1 + slippage)
                n = int(cash * USED / price / LOT) * LOT
                if n > 0 and n * price * (1 + fee) <= cash:
                    cost = n * price * (1 + fee)
                    cash, held = cash - cost, n
            elif before == -1 and held > 0:
                got = held * (o * (1 - slippage)) * (1 - fee)
                cash, pnl, held = cash + got, got - cost, 0
            out.append((cash + held * c, held, pnl))
            before = s
        if held and out:
            out[-1] = (out[-1][0], held, held * c * (1 - fee) - cost)
        g[["equity", "shares", "trade_pnl"]] = pd.DataFrame(out, columns=["equity", "shares", "trade_pnl"]).astype(float)
        g["shares"] = g["shares"].astype("int64")
        return g[["symbol", "ts", "equity", "shares", "trade_pnl"]]

    return signals.select("symbol", "ts", "open", "close", "signal").groupBy("symbol").applyInPandas(fold, "symbol string, ts timestamp_ntz, equity double, shares long, trade_pnl double")


def metrics(curve: DataFrame, capital: float = CAPITAL, rf: float = 0.04) -> DataFrame:
    """Total return, yearly growth, drawdown, volatility, Sharpe, trades, win rate and profit factor (infinite without losses)."""
    d = curve.withColumns({"ret": F.try_divide(F.col("equity"), F.lag("equity").over(by_ts())) - 1, "peak": F.max("equity").over(by_ts().rowsBetween(Window.unboundedPreceding, 0))})
    win, loss = F.sum(F.when(F.col("trade_pnl") > 0, F.col("trade_pnl"))), F.sum(F.when(F.col("trade_pnl") <= 0, -F.col("trade_pnl")))
    g = d.groupBy("symbol").agg(
        F.max_by("equity", "ts").alias("final"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.min(F.col("equity") / F.col("peak") - 1).alias("mdd"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"),
        F.count("trade_pnl").alias("trades"), F.count_if(F.col("trade_pnl") > 0).alias("wins"), F.coalesce(win, F.lit(0.0)).alias("won"), F.coalesce(loss, F.lit(0.0)).alias("lost"),
    )
    growth = F.when(F.col("days") > 0, F.pow(F.col("final") / capital, 365.0 / F.col("days")) - 1)
    return g.select(
        "symbol", ((F.col("final") / capital - 1) * 100).alias("total_return"), (growth * 100).alias("cagr"), (F.col("mdd") * 100).alias("max_drawdown"), (F.col("vol") * 100).alias("volatility"),
        F.try_divide(growth - rf, F.col("vol")).alias("sharpe"), "trades", (F.try_divide(F.col("wins"), F.col("trades")) * 100).alias("win_rate"),
        F.when(F.col("lost") > 0, F.col("won") / F.col("lost")).when(F.col("won") > 0, F.lit(float("inf"))).alias("profit_factor"),
    )


def buy_and_hold(bars: DataFrame) -> DataFrame:
    g = bars.withColumn("peak", F.max("close").over(by_ts().rowsBetween(Window.unboundedPreceding, 0))).groupBy("symbol")
    return g.agg(((F.max_by("close", "ts") / F.min_by("close", "ts") - 1) * 100).alias("total_return"), (F.min(F.col("close") / F.col("peak") - 1) * 100).alias("max_drawdown"))
