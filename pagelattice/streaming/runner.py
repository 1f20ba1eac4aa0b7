"""Running a streaming query to completion over what its source holds now."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..checkpoints import shared_folder


def run_once(spark: SparkSession, path: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], name: str, timeout_s: int = 3600) -> DataFrame:
    """Stream a Parquet file or folder through ``transform`` with trigger availableNow and read the sink back.

    Sink and checkpoint lie beside the other checkpoints, in the folder that spark.checkpoint.dir names (a private one only in local sessions)."""
    shared = shared_folder(spark)
    base = f"{shared}/stream-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent())
    events = reader.parquet(path)
    done = transform(events).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    if not done.awaitTermination(timeout_s):
        done.stop()
        raise TimeoutError(f"{name} didn't end in {timeout_s} s")
    return spark.read.parquet(f"{base}/out")
