"""What the training-data operators share: shared-folder materialisation, graph components and small helpers."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder of its own, any other an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder; a lost executor loses nothing of it. See discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads, and the shuffle files of plans that are done.

    A job may end while a stage that it no longer needs still runs; such stages are given a while to end before what they read goes.
    """
    spark = tables[0].sparkSession
    tracker, until = spark.sparkContext.statusTracker(), time.monotonic() + PATIENCE
    while tracker.getActiveStageIds() and time.monotonic() < until:
        time.sleep(0.05)
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let go of plans that nothing refers to any more: Spark deletes their shuffle files and checkpoints once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Spark's own reliable checkpoint, for small tables of ids and edges."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInPandas for rows with a doc_id, which goes through Python as text: pandas would turn a column of longs beside a null into floats.

    `schema` begins with `doc_id long`; make() passes the ids on as they come.
    """
    assert schema.startswith("doc_id long, ")
    out = df.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(make, schema.replace("doc_id long", "doc_id string", 1))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def text_column(name: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: Seconds that stages of jobs that have ended get to end themselves.
PATIENCE = 20
#: Edges of a partition of a graph.
EDGES = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (src, dst), longs: returns (node, component), component the smallest node.

    Alternating large-star and small-star steps. A node's smallest neighbour is found by a partial
    aggregate and joined back, so that no neighbourhood, however large, is gathered in one place.
    Nodes without an edge to another node do not appear. Null ends are dropped.
    """
    spark = edges.sparkSession
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(df):
        """Checkpointed, in no more partitions than its rows need."""
        done = checkpoint(df)
        rows = done.count()
        release(spark)
        return (done.coalesce(max(1, rows // EDGES)) if rows < dealt * EDGES else done), rows

    cur, rows = kept(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u is not null and v is not null and u <> v").distinct())
    if not rows:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # done when every node has one parent and no parent has a parent
        roles = cur.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself)
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        low = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of a node, and the node, go to the smallest of them
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        cur, rows = kept(small.where("u <> v").distinct())
    raise RuntimeError("components did not settle")
