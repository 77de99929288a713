"""Statements as sheets to look at: a row an item in the order of a registry, a column a period in the order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import period_label


def statement_rows(cells: DataFrame, registry: DataFrame, unit: float = 1e9) -> DataFrame:
    """(symbol, statement, ordinal, label, period_key, shown): items with any value, amounts in units, those of a share and counts as they are.

    cells has (symbol, period_key, item, value); registry (item, statement, ordinal, label, per_unit), a few dozen rows.
    """
    rows = cells.where("value is not null").join(F.broadcast(registry), "item")
    return rows.select("symbol", "statement", "ordinal", "label", "period_key", F.when(F.col("per_unit"), F.col("value")).otherwise(F.col("value") / unit).alias("shown"))


def sheet(rows: DataFrame, value: str = "shown") -> DataFrame:
    """rows with a column for each period, oldest first, named as period_label() has it."""
    named = rows.withColumn("_period", period_label(F.col("period_key")))
    periods = [r[0] for r in named.select("_period", "period_key").distinct().orderBy("period_key").collect()]  # a few dozen
    keys = [c for c in ("symbol", "statement", "ordinal", "label") if c in rows.columns]
    return named.groupBy(*keys).pivot("_period", periods).agg(F.first(value)) if periods else rows.select(*keys)


def sources_sheet(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """Where each cell of (symbol, period_key, item, source) came from, as a sheet."""
    rows = cells.where("source is not null").join(F.broadcast(registry), "item")
    return sheet(rows.select("symbol", "statement", "ordinal", "label", "period_key", "source"), "source")


def export(df: DataFrame, path: str, *order: str) -> None:
    """One CSV file with a header for each symbol's rows, or for all, in this order. Numbers are written as they are."""
    by = [c for c in ("symbol",) if c in df.columns]
    ordered = df.withColumn("_by", F.col("symbol")).repartition("symbol").sortWithinPartitions("symbol", *order) if by else df.coalesce(1).sortWithinPartitions(*order)
    writer = ordered.write.mode("overwrite").option("header", True)
    (writer.partitionBy("_by") if by else writer).csv(path)
