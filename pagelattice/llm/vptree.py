"""Problem 6: the k most similar vectors of every query, by vantage-point trees per shard.

A shard is a partition of the scan, so no vector is shuffled: each task builds a tree over the unit vectors it reads and answers a block of queries.
On unit vectors the Euclidean distance is a metric with d^2 = 2 - 2 cos, so a subtree is ruled out by the triangle inequality when the query's
distance from the shell exceeds ``factor`` times the distance of its k-th neighbour so far; factor one is the exact search, smaller factors prune more
and may lose neighbours. The k best of every shard are merged by a ranked window (at most k rows per query and shard are shuffled).
Queries are broadcast in blocks of at most ``query_block`` rows (32 MB at 64 dimensions): more queries mean more passes, never a larger broadcast; of several passes each is finished
(a reliable checkpoint) and its block dropped before the next is read, so the driver never holds more than one.

How much is pruned depends on the data: ``compared_share`` reports the share of all pairs that a factor compares and ``recall`` what it finds of the exact neighbours.

Only vectors with exactly ``dims`` finite entries that aren't all zero count, on both sides; a query's own id is no neighbour of it; repeated rows of
an id are repeated candidates only once; ties go to the smaller id; fewer than k usable vectors give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

LEAF = 512
# Leaves and factor of the relaxed search: small leaves prune more, large ones multiply faster.
RELAXED_LEAF, RELAXED_FACTOR = 64, 0.16


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, positions) of the usable entries of a list column whose lists all have ``dims`` entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)
    scale = np.abs(flat).max(axis=1, initial=0.0)
    at = np.flatnonzero(np.isfinite(flat).all(axis=1) & (scale > 0))
    unit = flat[at] / scale[at, None]
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    return unit, at


class VantagePointTree:
    def __init__(self, vectors: np.ndarray, leaf: int | None = None, seed: int = 7):
        self.vectors, self.leaf, self.random, self.compared = vectors, leaf or LEAF, np.random.default_rng(seed), 0
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        some = self.random.choice(at, 24)
        spread = np.sqrt(np.maximum(0, 2 - 2 * self.vectors[some] @ self.vectors[self.random.choice(at, 128)].T)).std(axis=1)
        vantage = some[spread.argmax()]
        d = np.sqrt(np.maximum(0, 2 - 2 * self.vectors[at] @ self.vectors[vantage]))
        radius = float(np.median(d))
        inner = d <= radius
        if inner.all():
            half = len(at) // 2
            return (vantage, -1.0, self._build(at[:half]), self._build(at[half:]))
        return (vantage, radius, self._build(at[inner]), self._build(at[~inner]))

    def search(self, queries: np.ndarray, skip: np.ndarray, ids: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines), each (queries, k), -1 where fewer were found; skip holds each query's own id."""
        self.best = np.full((len(queries), k), -np.inf)
        self.where = np.full((len(queries), k), -1, np.int64)
        self.queries, self.skip, self.ids, self.k, self.factor = queries, skip, ids, k, factor
        self._visit(self.root, np.arange(len(queries)))
        return self.where, self.best

    def _radius(self, rows: np.ndarray) -> np.ndarray:
        worst = self.best[rows, -1]
        return np.where(np.isfinite(worst), np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isfinite(worst), worst, 0))), np.inf)

    def _visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for i in range(0, len(rows), 2048):
                self._leaf(node, rows[i : i + 2048])
            return
        vantage, radius, inner, outer = node
        if radius < 0:
            self._visit(inner, rows)
            self._visit(outer, rows)
            return
        d = np.sqrt(np.maximum(0, 2 - 2 * self.queries[rows] @ self.vectors[vantage]))
        near = d <= radius
        for first, second, some in ((inner, outer, near), (outer, inner, ~near)):
            mine, gap = rows[some], np.abs(d[some] - radius)
            self._visit(first, mine)
            self._visit(second, mine[gap <= self.factor * self._radius(mine) + 1e-9])

    def _leaf(self, at: np.ndarray, rows: np.ndarray) -> None:
        self.compared += len(at) * len(rows)
        cos = self.queries[rows] @ self.vectors[at].T
        hits = cos >= self.best[rows, -1:] - 1e-12
        for r in np.flatnonzero(hits.any(axis=1)):
            q, new = rows[r], at[hits[r]]
            new = new[self.ids[new] != self.skip[q]]
            if not len(new):
                continue
            exact = np.round((self.vectors[new] * self.queries[q]).sum(axis=1), 12)
            old = self.where[q] >= 0
            where, best = np.concatenate([self.where[q][old], new]), np.concatenate([self.best[q][old], exact])
            order = np.lexsort((self.ids[where], -best))[: self.k]
            self.where[q, : len(order)], self.best[q, : len(order)] = where[order], best[order]


def _answer(block, dims: int, k: int, factor: float, leaf: int, counts: bool):
    def run(batches):
        units, ids = [np.empty((0, dims))], [np.empty(0, np.int64)]
        for batch in batches:
            if batch.num_rows:
                unit, at = unit_rows(batch.column(1), dims)
                units.append(unit)
                ids.append(batch.column(0).to_numpy()[at])
        vectors, known = np.concatenate(units), np.concatenate(ids)
        _, first = np.unique(known, return_index=True)
        vectors, known = vectors[first], known[first]
        if not len(known):
            return
        numbers, own, queries = block.value
        tree = VantagePointTree(vectors, leaf)
        where, best = tree.search(queries, own, known, k, factor)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([tree.compared]), pa.array([len(queries) * len(known)])], names=["compared", "pairs"])
            return
        q, j = np.nonzero(where >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(known[where[q, j]]), pa.array(best[q, j])], names=["query_id", "neighbor_id", "cosine"])

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dims))


def _blocks(queries: DataFrame, dims: int, query_block: int):
    """Broadcasts of (query ids, own ids, unit vectors), of at most about ``query_block`` rows, and whether there are several."""
    asked = queries.select("query_id", F.coalesce("own_id", F.lit(-1)).cast("long").alias("own_id"), F.col("vector").cast("array<double>").alias("v")).where(F.col("query_id").isNotNull() & (F.size("v") == dims))
    blocks = max(1, -(-asked.count() // query_block))
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        unit, at = unit_rows(part.column("v").combine_chunks(), dims) if part.num_rows else (np.empty((0, dims)), np.empty(0, np.int64))
        yield queries.sparkSession.sparkContext.broadcast((part.column("query_id").to_numpy()[at], part.column("own_id").to_numpy()[at], unit)), blocks > 1


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "id", vector_col: str = "embedding", dims: int = 64, k: int = 5, factor: float = 1.0, query_block: int = 65_536, leaf: int = LEAF) -> DataFrame:
    """(query_id, neighbor_id, cosine, rank) for queries (query_id, own_id, vector), own_id being excluded from the neighbours."""
    usable, found = _usable(vectors, id_col, vector_col, dims), None
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbor_id")
    for held, several in _blocks(queries, dims, query_block):
        one = usable.mapInArrow(_answer(held, dims, k, factor, leaf, False), "query_id long, neighbor_id long, cosine double")
        one = one.groupBy("query_id", "neighbor_id").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if several:
            one = checkpoint(one)
            held.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def compared_share(vectors: DataFrame, queries: DataFrame, id_col: str = "id", vector_col: str = "embedding", dims: int = 64, k: int = 5, factor: float = RELAXED_FACTOR, query_block: int = 65_536, leaf: int = RELAXED_LEAF) -> DataFrame:
    """(compared, pairs): the pairs of a query and a vector that a search with this factor multiplies, and all of them."""
    usable, found = _usable(vectors, id_col, vector_col, dims), None
    for held, several in _blocks(queries, dims, query_block):
        one = usable.mapInArrow(_answer(held, dims, k, factor, leaf, True), "compared long, pairs long").agg(F.sum("compared").alias("compared"), F.sum("pairs").alias("pairs"))
        if several:
            one = checkpoint(one)
            held.destroy()
        found = one if found is None else found.unionByName(one)
    return found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def recall(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = RELAXED_FACTOR, leaf: int = RELAXED_LEAF, dims: int = 64) -> DataFrame:
    """(queries, exact, found, recall): how many of the exact k neighbours of the queries a relaxed search finds."""
    exact = nearest(vectors, queries, dims=dims, k=k).select("query_id", "neighbor_id")
    some = nearest(vectors, queries, dims=dims, k=k, factor=factor, leaf=leaf).select("query_id", "neighbor_id", F.lit(1).alias("hit"))
    met = exact.join(some, ["query_id", "neighbor_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    return met.agg(F.count("*").alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("exact"), F.coalesce(F.sum("h"), F.lit(0)).alias("found"), (F.sum("h") / F.sum("n")).alias("recall"))


def probe_neighbors(tabs: DataFrame, probes: DataFrame, dims: int = 64, k: int = 5, factor: float = 1.0) -> DataFrame:
    """Neighbours of the tabs named by probes (probe_id, tab_id)."""
    asked = probes.join(tabs.select("id", "embedding"), F.col("tab_id") == F.col("id")).select(F.col("probe_id").alias("query_id"), F.col("tab_id").alias("own_id"), F.col("embedding").alias("vector"))
    return nearest(tabs, asked, dims=dims, k=k, factor=factor)


def stated_query_set(tabs: DataFrame) -> DataFrame:
    """Queries of the whole-table form: every row whose id is divisible by 20."""
    return tabs.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("id").alias("own_id"), F.col("embedding").alias("vector"))
