"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all runs on one machine, a temporary one for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="filmloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that Python no longer holds; on Spark Connect, the server's own timer does."""
    gc.collect()
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of ``written`` that nothing needs any more."""
    jvm = df.sparkSession._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the smallest node reachable.

    Alternates large-star and small-star steps. Every step only takes a minimum per node and joins it back, so no
    neighbourhood is gathered; each step's edges are written to the shared folder. A node without an edge has no row.
    """
    from pyspark.sql import functions as F

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    now = written(ordered(edges), "cc")
    while True:
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_min.select("a", F.col("m").alias("b")))
        after = written(ordered(small), "cc")
        done = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        forget(now)
        now = after
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
