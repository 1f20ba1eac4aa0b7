"""Running sums over a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_before(rows: DataFrame, order: str, value: str, out: str, width: int = 256) -> DataFrame:
    """rows with ``out``, the sum of ``value`` over all rows with a smaller ``order`` (a unique, non-null number).

    ``order`` is cut at ``width`` - 1 of its quantiles, so that parts hold about as many rows each however the numbers are spread: sums per part give each part's start (``width`` rows), a window inside a part gives
    the rest. Only the quantiles reach the driver."""
    cuts = sorted(set(rows.agg(F.percentile_approx(order, [i / width for i in range(1, width)], 20_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    cut = rows.withColumn("_part", part)
    starts = cut.groupBy("_part").agg(F.sum(value).alias("_s")).withColumn("_start", F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).select("_part", "_start")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(order)) - F.col(value)
    return cut.withColumn("_within", within).join(F.broadcast(starts), "_part").withColumn(out, (F.col("_start") + F.col("_within")).cast("long")).drop("_part", "_start", "_within")
