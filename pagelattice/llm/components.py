"""Problem 3: one group identifier for all records linked directly or indirectly.

Union-find runs inside edge partitions and keeps only a spanning forest of each (as stars: node, root of the node in that partition, the
root being the smallest node). Forests are merged hierarchically: ranges of about ``task_edges`` edges each, fewer partitions at every level,
until one partition holds the whole forest or the next level would no longer fit a task. In the second case the remaining forest is contracted
by alternating large-star and small-star steps (each a grouped minimum, hot nodes pre-aggregated),
so the result never depends on whether the global forest fits one task. Every level is a reliable checkpoint.

Defined cases: null ends and self-links are ignored; repeated and reversed links count once; nodes that are linked with no other node don't
come out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import spanning_stars
from .common import checkpoint

TASK_EDGES = 1_000_000


def _forest(batches):
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        node, root = spanning_stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        for i in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(root[i : i + 100_000]), pa.array(node[i : i + 100_000])], names=["a", "b"])


def _local(edges: DataFrame, partitions: int) -> DataFrame:
    """Spanning forest of each partition. Partitions are ranges of (smaller end, larger end): the links of one neighbourhood meet early, and those of a hub that a third of all links
    lead to are cut into as many partitions as their number asks for."""
    return edges.repartitionByRange(partitions, "a", "b").mapInArrow(_forest, "a long, b long")


def _contract(forest: DataFrame, max_rounds: int) -> DataFrame:
    """Large-star and small-star until no link changes: (a = smallest node, b) for every other node."""
    edges, before = forest, None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b")
        large = large.where("a < b").distinct()
        down = large.select(F.col("b").alias("node"), F.col("a").alias("nb"))
        low = down.groupBy("node").agg(F.min("nb").alias("m"))
        small = down.join(low, "node").select(F.col("m").alias("a"), F.col("nb").alias("b")).where("a < b")
        edges = checkpoint(small.unionByName(low.select(F.col("m").alias("a"), F.col("node").alias("b"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(links: DataFrame, a_col: str, b_col: str, task_edges: int = TASK_EDGES, fan_in: int = 16, max_rounds: int = 60) -> DataFrame:
    """(component_id, node): every linked node with the smallest node of its component."""
    a, b = F.col(a_col).cast("long"), F.col(b_col).cast("long")
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where((a != b) & a.isNotNull() & b.isNotNull())
    edges = checkpoint(edges.distinct())
    count = edges.count()
    partitions = max(1, ceil(count / (task_edges / 8)))
    while True:
        forest = checkpoint(_local(edges, partitions))
        if partitions == 1:
            break
        size = forest.count()
        fewest = ceil(size / task_edges)
        if fewest > max(1, partitions // 2):
            forest = _contract(forest, max_rounds)
            break
        edges, partitions = forest, max(fewest, ceil(partitions / fan_in))
    roots = forest.select(F.col("a").alias("component_id"), F.col("a").alias("node")).distinct()
    return forest.select(F.col("a").alias("component_id"), F.col("b").alias("node")).unionByName(roots)


def tab_links(edges: DataFrame, tabs: DataFrame) -> DataFrame:
    """(a, b): links of edges other than navigation and of duplicate_of, both ends being ids in tabs."""
    ids = tabs.select(F.col("id").alias("known")).where("known is not null").distinct()
    by_edge = edges.where("reason is not null and reason <> 'navigation'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    by_mark = tabs.where("duplicate_of is not null").select(F.col("id").alias("a"), F.col("duplicate_of").alias("b"))
    links = by_edge.unionByName(by_mark).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.join(ids, F.col("a") == F.col("known"), "left_semi").join(ids, F.col("b") == F.col("known"), "left_semi")


def tab_components(edges: DataFrame, tabs: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    return components(tab_links(edges, tabs), "a", "b", task_edges).select("component_id", F.col("node").alias("tab_id"))
