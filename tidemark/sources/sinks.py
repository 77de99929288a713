"""Tables that are written: replaced or kept by key, appended to, looked up.

A table is a folder of Parquet, partitioned by one column; a change reads and rewrites only the partitions that it touches. What will
replace them is written aside first, under the change's name, and then put in place; a change that was broken off there is put in place by the next one,
and a change that is run again under its name leaves the same table. One writer at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.operators import desk


@dataclass(frozen=True)
class Table:
    """keys tell rows apart, the last by `at` stays; `by` is the column of the partitions, derived with `bucket` from the rows if it is none of theirs; `order` is that of a lookup."""

    keys: tuple[str, ...]
    at: str
    by: str = "bucket"
    buckets: int = 64
    order: tuple[tuple[str, bool], ...] = ()


#: Keys and the order of lookups (column, descending with nulls last) of the engine's own tables.
TABLES = {
    "price": Table(("symbol", "ts"), "fetched_at", order=(("ts", False),)), "financial": Table(("symbol", "period_type", "period_key", "item"), "fetched_at", order=(("period_key", False),)),
    "news": Table(("news_id",), "fetched_at"), "company": Table(("symbol",), "fetched_at"), "document": Table(("doc_id",), "fetched_at", order=(("year", True), ("doc_type", False))),
    "watchlist": Table(("symbol",), "added_at", order=(("added_at", False),)), "portfolio": Table(("id",), "created_at", order=(("created_at", False),)), "alert": Table(("id",), "created_at", order=(("created_at", True),)),
    "log": Table(("id",), "created_at", order=(("created_at", True),)),
}


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def _drop(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def with_partition(df: DataFrame, table: Table) -> DataFrame:
    """df with the column of its partition."""
    if table.by in df.columns:
        return df
    return df.withColumn(table.by, F.pmod(F.xxhash64(table.keys[0]), F.lit(table.buckets)).cast("int"))


def create(spark: SparkSession, path: str, schema: StructType, table: Table) -> None:
    """An empty table, if there is none."""
    if not exists(spark, path):
        none = with_partition(spark.createDataFrame([], schema), table)
        none.select(*[c for c in none.columns if c != table.by], table.by).coalesce(1).write.parquet(f"{path}/schema")


def read(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """The rows, with the column of their partition; those of a change that was broken off are put in place first."""
    recover(spark, path, table)
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, path: str, name: str, table: Table) -> None:
    schema = spark.read.parquet(f"{path}/schema").schema
    pending = f"{path}/pending/{name}"
    gone = [r[0] for r in spark.read.parquet(f"{pending}/touched").collect()]  # partitions, not rows
    if exists(spark, f"{pending}/rows"):
        rows = spark.read.schema(schema).parquet(f"{pending}/rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(table.by).parquet(f"{path}/rows")
        left = {r[0] for r in rows.select(table.by).distinct().collect()}
    else:
        left = set()
    for value in gone:  # partitions that lost all their rows
        if value not in left:
            _drop(spark, f"{path}/rows/{table.by}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
    _drop(spark, pending)


def recover(spark: SparkSession, path: str, table: Table) -> None:
    """Put changes in place that were written aside in full and broken off; drop those that were not."""
    at, files = _files(spark, f"{path}/pending")
    if files.exists(at):
        for name in sorted(s.getPath().getName() for s in files.listStatus(at)):
            if exists(spark, f"{path}/pending/{name}/ready"):
                _publish(spark, path, name, table)
            else:
                _drop(spark, f"{path}/pending/{name}")


def _change(new: DataFrame, path: str, table: Table, merge, name: str) -> None:
    """Merge new rows with those of the partitions they touch."""
    spark = new.sparkSession
    old, new = read(spark, path, table), with_partition(new, table)
    pending = f"{path}/pending/{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}"
    touched = new.select(table.by).distinct()
    touched.coalesce(1).write.parquet(f"{pending}/touched")
    values = [r[0] for r in spark.read.parquet(f"{pending}/touched").collect()]  # as many as there are partitions
    if not values:
        _drop(spark, pending)
        return
    mine = F.col(table.by).isin([v for v in values if v is not None]) | (F.col(table.by).isNull() if None in values else F.lit(False))
    merge(old.where(mine), new).select(*old.columns).repartition(table.by).write.partitionBy(table.by).parquet(f"{pending}/rows")
    touched.limit(0).write.parquet(f"{pending}/ready")
    _publish(spark, path, pending.rsplit("/", 1)[1], table)


def upsert(new: DataFrame, path: str, table: Table, name: str = "upsert") -> None:
    """Put rows in by key, the last by `at` in place of what is there. Columns that the table lacks are left out, those that new lacks are null."""
    _change(new, path, table, lambda old, rows: desk.upsert(old, rows, list(table.keys), table.at), name)


def insert_new(new: DataFrame, path: str, table: Table, name: str = "insert") -> None:
    """Put rows in whose key is not there; of several the first by `at`, then by all columns."""
    order = [F.col(table.at).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in new.columns if c not in (*table.keys, table.at)]]

    def merge(old, rows):
        fresh = desk.first_of(rows, list(table.keys), *order).join(old.select(*table.keys), list(table.keys), "left_anti")
        return old.unionByName(fresh.select(*[c for c in fresh.columns if c in old.columns]), allowMissingColumns=True)

    _change(new, path, table, merge, name)


def delete(gone: DataFrame, path: str, table: Table, name: str = "delete") -> None:
    """Take the rows of these keys out."""
    _change(gone.select(*table.keys).distinct(), path, table, lambda old, rows: old.join(rows, list(table.keys), "left_anti"), name)


def append(rows: DataFrame, path: str, name: str) -> None:
    """Rows of a log, as a part of their own; run again under its name, a part replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/part={name}")


def lookup(spark: SparkSession, path: str, table: Table, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows in the table's order, ties by key; those that `where` asks for, the first `limit` of them."""
    rows = read(spark, path, table)
    rows = rows if where is None else rows.where(where)
    rows = rows.orderBy(*[F.desc_nulls_last(c) if down else F.asc(c) for c, down in table.order], *table.keys).drop(*([table.by] if table.by == "bucket" else []))
    return rows if limit is None else rows.limit(limit)


def upsert_stream(stream: DataFrame, path: str, table: Table, log: str, checkpoint: str, dead: str | None = None, as_of=None):
    """Land what is available: each micro-batch is put in by key and leaves a row in the log; one that is run again leaves the same.

    With `dead`, rows without a time in `ts`, or later than as_of, go to that folder in the same micro-batch; the log counts rows read, kept and dead.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ok = F.lit(True) if dead is None else F.coalesce(F.col("ts") <= F.lit(as_of), F.lit(False))
        batch = batch.persist()
        counts = batch.agg(F.lit(number).alias("batch"), F.count("*").alias("rows"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dead")).first()
        upsert(batch.where(ok), path, table, f"batch-{number}")
        if dead is not None:
            append(batch.where(~ok), dead, str(number))
        append(spark.createDataFrame([tuple(counts)], "batch long, rows long, kept long, dead long"), log, str(number))
        batch.unpersist()

    create(stream.sparkSession, path, stream.schema, table)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
