"""Tables that are changed by key, with repeats and failures between."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import desk
from tidemark.sources import sinks

T = sinks.Table(("symbol", "k"), "at", by="year", order=(("at", True),))
SCHEMA = "symbol string, k int, v double, at int, year int, extra string"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("symbol", "k", "v", "at", "year", "extra").collect()), key=str)


@pytest.fixture
def made(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("A", k, float(k), 1, 2000 + k % 3, "x") for k in range(30)], SCHEMA)
    sinks.create(spark, path, first.schema, T)
    sinks.upsert(first, path, T)
    return path, first


def files(path):
    import pathlib

    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path, "rows").rglob("*.parquet")}


def test_upsert_touches_its_partitions_alone(spark, made):
    path, first = made
    before = files(path)
    late = spark.createDataFrame([("A", 3, -1.0, 2, 2000, "new"), ("A", 3, -2.0, 1, 2000, "old"), ("A", 99, 9.0, 0, 2000, None), ("B", 6, 5.0, 1, 2000, "n")], "symbol string, k int, v double, at int, year int, unknown string")
    sinks.upsert(late, path, T)
    want = rows_of(desk.upsert(first, late, ["symbol", "k"], "at"))
    assert rows_of(sinks.read(spark, path, T)) == want and [r for r in want if r[1] == 3] == [("A", 3, -1.0, 2, 2000, None)]
    assert {k: v for k, v in files(path).items() if "year=2000" not in k} == {k: v for k, v in before.items() if "year=2000" not in k}
    sinks.upsert(late, path, T)
    assert rows_of(sinks.read(spark, path, T)) == want


def test_first_write_stays_and_rows_go(spark, made):
    path, first = made
    more = spark.createDataFrame([("A", 1, 50.0, 0, 2001, "n"), ("C", 1, 2.0, 5, 2001, "late"), ("C", 1, 3.0, 4, 2001, "early"), ("D", 1, 1.0, 1, None, "no year")], SCHEMA)
    for _ in range(2):
        sinks.insert_new(more, path, T)
    got = rows_of(sinks.read(spark, path, T))
    assert len(got) == 32 and ("C", 1, 3.0, 4, 2001, "early") in got and ("A", 1, 1.0, 1, 2001, "x") in got and ("D", 1, 1.0, 1, None, "no year") in got
    keyed = sinks.Table(("symbol", "k"), "at", by="year")
    sinks.delete(first.where("year = 2002 or k = 3").select("symbol", "k", "year"), path, sinks.Table(("symbol", "k", "year"), "at", by="year"))
    assert all(r[4] != 2002 and r[:2] != ("A", 3) for r in rows_of(sinks.read(spark, path, keyed)))
    assert not any("year=2002" in f for f in files(path))
    sinks.upsert(more.where("false"), path, T)


@pytest.mark.parametrize("broken", ["before", "after"])
def test_broken_off(spark, made, broken, monkeypatch):
    path, first = made
    late = first.withColumns({"v": -F.col("v"), "at": F.lit(7)}).where("k < 10")
    publish = sinks._publish

    def fails(*args):
        if broken == "after":
            publish(*args[:2], args[2], args[3])
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "_publish", fails)
    with pytest.raises(RuntimeError):
        sinks.upsert(late, path, T, "day 1")
    monkeypatch.setattr(sinks, "_publish", publish)
    want = rows_of(desk.upsert(first, late, ["symbol", "k"], "at"))
    assert rows_of(sinks.read(spark, path, T)) == want
    sinks.upsert(late, path, T, "day 1")
    assert rows_of(sinks.read(spark, path, T)) == want


def test_lookups(spark, tmp_path):
    path, t = str(tmp_path / "d"), sinks.TABLES["document"]
    docs = spark.createDataFrame([(str(i), [None, 2020, 2021][i % 3], "ba"[i % 2], 1) for i in range(9)], "doc_id string, year int, doc_type string, fetched_at int")
    sinks.create(spark, path, docs.schema, t)
    assert sinks.lookup(spark, path, t).count() == 0
    sinks.upsert(docs, path, t)
    got = sinks.lookup(spark, path, t, F.col("doc_id") != "1", 4)
    assert [(r.year, r.doc_type) for r in got.collect()] == [(2021, "a"), (2021, "b"), (2021, "b"), (2020, "a")] and got.columns == docs.columns


def test_stream_with_dead_letters(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(f"S{i % 7}", day + dt.timedelta(days=i) if i % 9 else None, float(i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, v double, at int")
    for k in range(3):
        df.where(F.col("at") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t, limit = sinks.Table(("symbol",), "at", buckets=3), F.lit("2024-02-10").cast("timestamp")
    paths = [str(tmp_path / x) for x in ("t", "log", "ck", "dead")]
    for check in ("ck", "ck again"):  # a lost checkpoint runs all batches again under their numbers
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sinks.upsert_stream(stream, paths[0], t, paths[1], str(tmp_path / check), paths[3], limit).awaitTermination()
        good = df.where(F.coalesce(F.col("ts") <= limit, F.lit(False)))
        got = sinks.read(spark, paths[0], t).select("symbol", "at")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, good.groupBy("symbol").agg(F.max("at")).collect()))
        dead, log = spark.read.parquet(paths[3]), spark.read.parquet(paths[1]).agg(F.sum("rows"), F.sum("kept"), F.sum("dead")).first()
        assert dead.count() == 60 - good.count() == log[2] and tuple(log)[:2] == (60, good.count())
