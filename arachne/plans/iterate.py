"""Lineage of iterative operators, cut by tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode (tests), and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="arachne-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Delete all tables that this library has left in the shared folder: for the end of a session, when no result is read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/arachne")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove(*tables: DataFrame | None) -> None:
    """Delete tables of checkpoint() that nothing reads any more."""
    for df in tables:
        if df is not None and hasattr(df, "_kept_at"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bounded(rows: DataFrame, limit: int, *by: str) -> DataFrame:
    """rows, if no group (by; without it all rows) has more than limit. Counted with partial aggregation, before a group moves to a task; raises ValueError else."""
    most = rows.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    if most > limit:
        raise ValueError(f"{most} rows belong together, and one task holds {limit} at most")
    return rows


def checkpoint(df: DataFrame, *spent: DataFrame | None) -> DataFrame:
    """df, computed and written to the shared folder, and read from there. spent: such tables that only df has still to read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arachne/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    remove(*spent)
    return out
