"""Connected components of link tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpoint


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for every node of the links that isn't its own root.

    Each round hangs the larger root of every open link under the smaller one and flattens all paths, as sequential union-find with path halving would."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        rx, ry = parent[x], parent[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        if len(x):
            np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    child = parent != np.arange(len(nodes))
    return nodes[child], nodes[parent[child]]


def _partition_forest(batches):
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        node, root = spanning_stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(node, pa.int64())], names=["a", "b"])


def connected_components(links: DataFrame, a_col: str, b_col: str, task_links: int = 250_000, max_rounds: int = 60) -> DataFrame:
    """(node, component): every linked node with the smallest node of its component.

    Partitions are ranges of (smaller end, larger end), so that the links of a hub are cut as well. Union-find inside partitions of about ``task_links`` links leaves stars; where one partition holds all links that is the result. Otherwise the stars are contracted in
    alternation: each round hangs a node's larger neighbours, then its smaller ones, under the smallest neighbour. Both are grouped minima and joins, so no
    node's neighbourhood is ever collected. Every round is a reliable checkpoint.
    """
    a, b = F.col(a_col).cast("long"), F.col(b_col).cast("long")
    edges = checkpoint(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    partitions = max(1, -(-edges.count() // task_links))
    edges = checkpoint(edges.repartitionByRange(partitions, "a", "b").mapInArrow(_partition_forest, "a long, b long"))
    before = None
    for _ in range(max_rounds if partitions > 1 else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        under = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(under, "b")
        moved = small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
        edges = checkpoint(moved.unionByName(under.select(F.col("m").alias("a"), "b")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        if partitions > 1:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
