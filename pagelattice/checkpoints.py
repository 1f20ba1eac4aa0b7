"""Reliable checkpoints in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a private one is used only by local sessions that name none."""
    master = spark.sparkContext.master
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="pagelattice-")


def work_folder(spark: SparkSession) -> str:
    """The application's own folder for checkpoints and other files that its tasks share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage."""
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table of compressed columns: a fraction of a checkpoint's disk, later steps read only the columns that they need, and joins know its size. It stays in the application's folder."""
    if any(kind in t for _, t in df.dtypes for kind in ("void", "interval")):  # no types of stored columns
        return checkpoint(df)
    at = f"{work_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: files of shuffles that nothing reads any more go with it, else they stay until its memory is short."""
    gc.collect()
    spark._jvm.System.gc()
