"""Sinks: backups, versioned tables and the stored graph. A table is never overwritten while it is read: a new version is written beside it and a pointer moves last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("tabs", "groups", "edges")
GRAPH_POINTER = "_graph_pointer"


def write_backup(windows: DataFrame, path: str) -> None:
    """Window lists as JSON lines."""
    windows.select("browser", "windowId", "tabs").write.mode("overwrite").json(path)


def _pointed(spark: SparkSession, pointer: str) -> int | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(pointer)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("version long").json(pointer).agg(F.max("version")).first()[0]


def _point(spark: SparkSession, pointer: str, number: int) -> None:
    spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").json(pointer)


def current_version(spark: SparkSession, path: str) -> int | None:
    """The newest version that a table's own pointer or the one of the graph it belongs to names."""
    known = [n for n in (_pointed(spark, f"{path}/_pointer"), _pointed(spark, f"{path.rstrip('/').rpartition('/')[0]}/{GRAPH_POINTER}")) if n is not None]
    return max(known, default=None)


def write_version(table: DataFrame, path: str) -> int:
    """Write the next version of a table and point to it; returns its number."""
    spark = table.sparkSession
    number = (current_version(spark, path) or 0) + 1
    table.write.mode("overwrite").parquet(f"{path}/v={number:020d}")
    _point(spark, f"{path}/_pointer", number)
    return number


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    number = current_version(spark, path)
    return None if number is None else spark.read.parquet(f"{path}/v={number:020d}")


def replace_graph(graph, path: str) -> int:
    """New versions of tabs, groups and edges, empty ones included, under one pointer that moves last: readers see the old graph or the new one, never a mixture."""
    spark = graph.tabs.sparkSession
    number = max((current_version(spark, f"{path}/{name}") or 0 for name in TABLES)) + 1
    for name in TABLES:
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}/v={number:020d}")
    _point(spark, f"{path}/{GRAPH_POINTER}", number)
    return number


def read_graph_tables(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the graph as its pointer names them."""
    number = _pointed(spark, f"{path}/{GRAPH_POINTER}")
    return None if number is None else {name: spark.read.parquet(f"{path}/{name}/v={number:020d}") for name in TABLES}


def truncate(spark: SparkSession, path: str) -> None:
    """An empty next version of a table."""
    table = read_current(spark, path)
    if table is not None:
        write_version(table.where("false"), path)
