"""Helpers that the training-data operators share: tables in the shared folder, size-checked broadcasts, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arachne.plans.iterate import shared_folder

#: Rows up to which a side with one or two integer columns may be broadcast. Beyond it, callers shuffle instead.
BROADCAST_ROWS = 500_000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/arachne/{name}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    return write_out(df, name)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by write_out() that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs; without it they stay until the driver happens to collect garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends at most so many rows at once to Python: bounds a worker's memory where rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit; else df, which Spark then shuffles."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, comp), comp the smallest id; ids without edges don't appear.

    Alternating large-star and small-star steps: each is one aggregation and one join on the node, with partial
    aggregation before the shuffle, so a hub with very many links is no single task's work. Edges with a null end and
    loops are ignored. The loop ends when every component is a star around its smallest id.
    """
    spark = edges.sparkSession
    e, path = write_out(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low2, "u")
        small = (
            pairs.select(F.col("v").alias("x"), "m").union(low2.select(F.col("u").alias("x"), "m"))
            .where("x > m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        )
        new, new_at = write_out(small, "edges")
        remove(spark, path)
        e, path = new, new_at
        # Done once all is stars: no end has two centres, and no centre is an end.
        ends = e.select("u", F.lit(1).alias("end"), F.lit(0).alias("centre")).union(e.select("v", F.lit(0), F.lit(1)).distinct())
        per = ends.groupBy("u").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre"))
        if per.where("ends > 1 or ends = 1 and centre = 1").isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
