"""Event-time operators that run alike over a batch and over a stream, and the job that lands a stream.

Events have (event_id, ts, symbol, value) and ts is a timestamp (not of the type without zone, which watermarks refuse).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans.store import shared_folder


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: the files of its folder, or the one file that it is."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    files = table.inputFiles()
    source = spark.readStream.schema(table.schema)
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return source.parquet(f"{sf_dir}/{name}.parquet")


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    at = shared_folder(stream.sparkSession, label)
    q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def watermarked(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def daily_bars(events: DataFrame) -> DataFrame:
    """symbol, ts (the day), open, high, low, close and volume (rows) of each day's events; first and last by time, then id; nulls are not looked at."""
    e = watermarked(events).where("value is not null").withColumn("at", F.struct("ts", "event_id"))
    day = e.groupBy("symbol", F.window("ts", "1 day").alias("day")).agg(F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count("*").alias("volume"))
    return day.select("symbol", F.col("day.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_snapshots(events: DataFrame, days: int = 20) -> DataFrame:
    """high, low, value and rows of each symbol over windows of so many days that start every day; days are summed up first, so that each event is shuffled once."""
    day = watermarked(events).groupBy("symbol", F.window("ts", "1 day").alias("day")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.sum("value").alias("total"), F.count("*").alias("n"))
    spans = day.groupBy("symbol", F.window(F.window_time("day"), f"{days} days", "1 day").alias("w"))
    return spans.agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("total").alias("total"), F.sum("n").alias("n")).select("symbol", F.col("w.start").alias("start"), "high", "low", "total", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """start, rows and value of each symbol's runs of events with no longer gap between them."""
    runs = watermarked(events).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return runs.select("symbol", F.col("w.start").alias("start"), "n", "total")


def first_by_id(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each key: the earliest in a batch, the first to arrive within the watermark on a stream."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    rest = [c for c in events.columns if c != key]
    first = events.groupBy(key).agg(F.min(F.struct("ts", *[c for c in rest if c != "ts"])).alias("f"))
    return first.select(*[F.col(key) if c == key else F.col(f"f.{c}").alias(c) for c in events.columns])


def split_future(events: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Rows up to as_of, and the later ones (or those without a time) for a dead-letter table."""
    ok = F.coalesce(F.col("ts") <= F.lit(as_of), F.lit(False))
    return events.where(ok), events.where(~ok)


def land(stream: DataFrame, path: str, log: str, checkpoint: str, mode: str = "append"):
    """Land what is available as one folder for each micro-batch, with a log row; a batch that is run again replaces its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number}").agg(F.count("*").alias("rows"))
        done.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
