"""What users add: strategies as functions of bars, and signals spread over the days they hold, as a table function in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

Strategy = Callable[[DataFrame], Column]


def with_strategies(bars: DataFrame, strategies: dict[str, Strategy]) -> DataFrame:
    """(symbol, ts, strategy, signal) of every bar and strategy; a signal is 1 (buy), -1 (sell) or 0, null counts as 0 and what is larger as its sign.

    A strategy takes the bars and gives a column over them. It is checked before anything runs: it must be known by the bars' columns and whole numbers.
    """
    columns = {}
    for name, strategy in strategies.items():
        column = strategy(bars)
        if not isinstance(column, Column):
            raise TypeError(f"strategy {name} gives no column")
        kind = bars.select(column.alias("signal")).schema["signal"].dataType  # fails for columns that the bars lack
        if not isinstance(kind, IntegralType):
            raise TypeError(f"strategy {name} gives {kind.simpleString()}, not whole numbers")
        columns[name] = F.signum(F.coalesce(column, F.lit(0))).cast("int")
    wide = bars.select("symbol", "ts", *[c.alias(f"s{i}") for i, c in enumerate(columns.values())])
    cells = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"s{i}").alias("signal")) for i, n in enumerate(columns)])
    return wide.select("symbol", "ts", F.inline(cells))


class Held:
    """A signal, once a day, from the day it is given on: (day, left) for so many days."""

    def eval(self, day, signal: int, days: int):
        import datetime

        if day is not None and signal:
            for k in range(max(0, days or 0)):
                yield day + datetime.timedelta(days=k), int(days - k - 1)


def register(spark: SparkSession, name: str = "held") -> None:
    """Makes Held known to SQL: SELECT ... FROM signals, LATERAL held(day, signal, days)."""
    spark.udtf.register(name, F.udtf(Held, returnType="day date, left int"))
