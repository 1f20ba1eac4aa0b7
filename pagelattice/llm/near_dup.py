"""Problem 5: groups of records that share most of their tokens, found with count-vector R-trees.

Every record is its set of distinct tokens; equal sets are one class until the end. Tokens are hashed into 32 groups and a class becomes the point of
its group counts. For two points the sum of the coordinate minima bounds the overlap of the sets from above, for a point and a bounding box the
sum of the minima with the box's upper corner does, so whole subtrees are ruled out without touching their members.

One R-tree over all records would have to sit in one task, so the points are sharded first, exactly: with tokens ordered from rare to common, two sets at or above
the threshold t share one of their first n - ceil(t * n) + 1 tokens, so each class is sent to the shards of just those tokens and each shard
holds an R-tree. The tokens a set has left from the shard's token on bound the overlap as well: they are one more coordinate of points and boxes. The order comes from a table of token counts in ``CELLS`` hash cells: its size is fixed (4 MB), whatever the corpus, it is
built from all records, and any order gives the same result. A token of more than ``block`` classes makes no shard: records whose first shared token it is
meet by it and their second shared token together, which is far rarer (and in such a shard the same bounds hold). Shards still larger than ``block`` are cut into blocks that meet pairwise. Surviving
pairs are verified with the exact sets of 64-bit token hashes.

Defined cases: null tokens don't count; null arrays, sets below ``min_tokens`` and null ids take no part; repeated ids count once;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix64

GROUPS = 32
CELLS = 1 << 20
LEAF, FANOUT = 32, 16
_SATURATED = 255
# Records of up to so many tokens meet by pairs of tokens where their first shared token is a frequent one; longer ones, which have too many pairs, by blocks of that token.
PAIRED = 256


def token_classes(rows: DataFrame, id_col: str, tokens_col: str, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(members (id, class_id), classes (class_id, hashes, n, copies)); class_id is the smallest id with that token set."""
    hashes = F.array_sort(F.array_distinct(F.transform(F.filter(F.col(tokens_col), lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    sets = rows.select(F.col(id_col).alias("id"), hashes.alias("hashes")).where(F.col("id").isNotNull() & (F.size("hashes") >= min_tokens))
    grouped = sets.groupBy("hashes").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("copies"))
    classes = checkpoint(grouped.select("class_id", "hashes", F.size("hashes").alias("n"), F.xxhash64("hashes").alias("h"), "copies"))
    members = sets.select("id", F.xxhash64("hashes").alias("h")).join(classes.where("copies > 1").select("h", "class_id"), "h").select("id", "class_id").distinct()
    return members, classes


def cell_counts(classes: DataFrame) -> np.ndarray:
    """Number of classes per hash cell of the tokens: at most CELLS rows reach the driver."""
    cells = classes.select(F.explode("hashes").alias("t")).groupBy(F.pmod("t", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    counts = np.zeros(CELLS, np.int32)
    got = cells.toArrow()
    counts[got.column("cell").to_numpy()] = np.minimum(got.column("n").to_numpy(), np.iinfo(np.int32).max)
    return counts


def count_vectors(tokens: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Group counts (rows, GROUPS) as bytes; a row with a count of 255 or more is saturated throughout, which never rules it out."""
    group = (mix64(tokens.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % GROUPS
    counts = np.bincount(row * GROUPS + group, minlength=rows * GROUPS).reshape(rows, GROUPS)
    counts[(counts >= _SATURATED).any(axis=1)] = _SATURATED
    return counts.astype(np.uint8)


class _Ordered:
    """The tokens of a batch of classes, of every row from rare to common."""

    def __init__(self, batch: pa.RecordBatch, table: np.ndarray, threshold: Fraction, paired: int):
        self.paired, self.widest = paired, paired * threshold.denominator // threshold.numerator  # the largest records that meet by pairs only, and as well
        self.sizes = batch.column("n").to_numpy().astype(np.int64)
        tokens = batch.column("hashes").flatten().to_numpy()
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        seen = table[tokens % CELLS]
        order = np.lexsort((tokens, seen, row))
        self.unordered, self.unordered_row = tokens, row
        self.row, self.token, self.seen = row, tokens[order], seen[order]
        self.start = np.cumsum(self.sizes) - self.sizes
        self.rank = np.arange(len(row)) - self.start[row]
        self.shared = -(-self.sizes * threshold.numerator // threshold.denominator)  # tokens that a partner of any size has to share

    def singles(self, block: int) -> np.ndarray:
        """Places of the tokens that are shards of their own: those of the first n - c + 1, but for tokens of more than ``block`` classes in records that meet by pairs of tokens instead."""
        by_pairs = (self.seen > block) & (self.sizes <= self.paired)[self.row] & (self.shared >= 2)[self.row]
        return np.flatnonzero((self.rank < (self.sizes - self.shared + 1)[self.row]) & (self.seen > 1) & ~by_pairs)

    def pairs(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of (first, second) shared tokens where the first has more than ``block`` classes: two records that share at least two tokens have both among their first n - c + 2."""
        c = np.maximum(self.shared, 2)
        first = np.flatnonzero((self.seen > block) & (self.rank < (self.sizes - c + 1)[self.row]) & (self.sizes <= self.widest)[self.row])
        many = np.maximum((self.start + self.sizes - c + 2)[self.row[first]] - first - 1, 0)
        a = np.repeat(first, many)
        return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)

    def pair_keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(mix64(self.token[a].view(np.uint64)) * np.uint64(3) + self.token[b].view(np.uint64))


def pair_counts(classes: DataFrame, counts, threshold: Fraction, block: int, paired: int) -> np.ndarray:
    """Number of classes per hash cell of the pairs of tokens that are shards: at most CELLS rows reach the driver."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                o = _Ordered(whole.slice(at, 2048), counts.value, threshold, paired)
                cells, n = np.unique(o.pair_keys(*o.pairs(block)) % np.uint64(CELLS), return_counts=True)
                if len(cells):
                    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    got = classes.select("hashes", "n").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int32)
    out[got.column("cell").to_numpy()] = np.minimum(got.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out


def _shard_rows(counts, pair_counts, threshold: Fraction, block: int, paired: int):
    def emit(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                yield from rows(whole.slice(at, 2048))

    def rows(batch):
        if not batch.num_rows:
            return
        o = _Ordered(batch, counts.value, threshold, paired)
        ids = batch.column("class_id").to_numpy()
        vectors = count_vectors(o.unordered, o.unordered_row, len(o.sizes))
        one, (first, second) = o.singles(block), o.pairs(block)
        pair = o.pair_keys(first, second)
        key = np.concatenate([o.token[one].view(np.uint64), pair])
        many = np.concatenate([o.seen[one], pair_counts.value[(pair % np.uint64(CELLS)).astype(np.int64)]]).astype(np.int64)
        place = np.concatenate([one, first])
        keep = many > 1
        key, many, place = key[keep], many[keep], place[keep]
        r, left = o.row[place], o.sizes[o.row[place]] - o.rank[place]
        blocks = -(-many // block)
        mine = (mix64(ids[r].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        copies = np.repeat(np.arange(len(key)), blocks)
        other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks) if len(copies) else copies
        own, low, high = mine[copies], np.minimum(mine[copies], other), np.maximum(mine[copies], other)
        with np.errstate(over="ignore"):
            shard = mix64(key[copies] + low.astype(np.uint64) * np.uint64(0x9E3779B1) + high.astype(np.uint64) * np.uint64(0x85EBCA77C2B2)).view(np.int64)
        side = np.where(low == high, 0, np.where(own == low, 1, 2)).astype(np.int32)
        at_row = r[copies]
        for i in range(0, len(at_row), 65_536):
            s = slice(i, i + 65_536)
            points = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS), len(at_row[s]), [None, pa.py_buffer(np.ascontiguousarray(vectors[at_row[s]]))]).cast(pa.binary())
            columns = [pa.array(shard[s]), pa.array(side[s]), pa.array(ids[at_row[s]]), pa.array(o.sizes[at_row[s]].astype(np.int32)), pa.array(left[copies[s]].astype(np.int32)), points]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "side", "class_id", "n", "left", "point"])

    return emit


def needed(m, n, t: float):
    """Shared tokens that sets of sizes m and n need for the threshold."""
    return np.ceil(t / (1 + t) * (m + n) - 1e-9)


def possible(m, n, left_m, left_n, t: float):
    """Whether the sizes and the tokens left from the shard's token on allow the threshold (the first shared token names the shard that counts)."""
    return (np.minimum(m, n) >= t * np.maximum(m, n) - 1e-9) & (np.minimum(left_m, left_n) >= needed(m, n, t))


def admits(p: np.ndarray, q: np.ndarray, m, n, t: float) -> np.ndarray:
    """Whether the summed minima of the group counts reach the needed overlap; a saturated pair is always admitted."""
    bound = np.minimum(p, q).sum(axis=1, dtype=np.uint16)
    wide = (p[:, 0] == _SATURATED) & (q[:, 0] == _SATURATED)
    return wide | (bound >= needed(m, n, t))


class CountRTree:
    """Bulk-loaded R-tree over group counts: leaves of LEAF points; a box is its upper corner and the ranges of sizes and of tokens left."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, left: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes, -left))
        self.points, self.sizes, self.left = points[self.order], sizes[self.order], left[self.order]
        starts = np.arange(0, len(sizes), LEAF)
        level = [np.maximum.reduceat(self.points, starts, axis=0), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts), np.maximum.reduceat(self.left, starts)]
        self.levels = [level]
        while len(self.levels[-1][0]) > FANOUT:
            starts = np.arange(0, len(self.levels[-1][0]), FANOUT)
            self.levels.append([f.reduceat(x, starts, axis=0) for f, x in zip((np.maximum, np.minimum, np.maximum, np.maximum), self.levels[-1])])

    def leaves_for(self, upper: np.ndarray, small: int, large: int, left: int, t: float) -> np.ndarray:
        """Leaves whose box may hold partners of the points of a given box."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high, most = (x[nodes] for x in self.levels[depth])
            need = needed(small, np.maximum(low, np.ceil(t * small - 1e-9)), t)
            wide = (corner == _SATURATED).any(axis=1) & (upper == _SATURATED).any()
            bound = np.minimum(corner, upper).sum(axis=1, dtype=np.int32)
            keep = (wide | (bound >= need)) & (np.minimum(most, left) >= need) & (high >= t * small - 1e-9) & (low * t <= large + 1e-9)
            nodes = nodes[keep]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return nodes

    def join(self, other: "CountRTree", t: float, itself: bool):
        """(own, theirs) positions of all pairs that the bounds admit, leaf by leaf; of one tree with itself every pair once."""
        for leaf in range(len(self.levels[0][0])):
            upper, small, large, left = (x[leaf] for x in self.levels[0])
            leaves = other.leaves_for(upper, small, large, left, t)
            leaves = leaves[leaves >= leaf] if itself else leaves
            if not len(leaves):
                continue
            mine = np.arange(leaf * LEAF, min((leaf + 1) * LEAF, len(self.sizes)))
            theirs = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
            theirs = theirs[theirs < len(other.sizes)]
            ok = possible(self.sizes[mine][:, None], other.sizes[theirs][None, :], self.left[mine][:, None], other.left[theirs][None, :], t)
            if itself:
                ok &= theirs[None, :] > mine[:, None]
            i, j = np.nonzero(ok)
            for at in range(0, len(i), 131_072):
                x, y = mine[i[at : at + 131_072]], theirs[j[at : at + 131_072]]
                keep = admits(self.points[x], other.points[y], self.sizes[x], other.sizes[y], t)
                yield self.order[x[keep]], other.order[y[keep]]


def _shard_runs(batches, least_rows: int = 131_072):
    """Tables of whole shards from rows sorted by shard, of about so many rows and one shard more at most: a task holds no more, however much its partition has."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            if rows < least_rows:
                held.append(batch)
                rows += batch.num_rows
                break
            last = held[-1].column("shard")[held[-1].num_rows - 1].as_py()
            other = np.flatnonzero(batch.column("shard").to_numpy() != last)
            cut = int(other[0]) if len(other) else batch.num_rows
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search_shards(t: float):
    def run(batches):
        for table in _shard_runs(batches):
            shard, side, ids, sizes, left = (table.column(c).to_numpy() for c in ("shard", "side", "class_id", "n", "left"))
            points = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS)
            for pairs in _pairs_of_shards(shard, side, ids, sizes, left, points, t):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["class_a", "class_b"])

    return run


def _pairs_of_shards(shard, side, ids, sizes, left, points, t: float, at_once: int = 1_000_000):
    """Arrays of (class_a, class_b) that the bounds admit, from rows sorted by shard and side."""
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    ends = np.append(starts[1:], len(shard))
    span = ends - starts
    found: list[tuple] = []

    def pairs():
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        found.clear()
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return both[both[:, 0] != both[:, 1]]

    # Trees of one node, of up to two leaves' rows: all such shards at once, by distance within the sorted rows.
    rest = np.repeat(ends, span) - np.arange(len(shard))
    rest[np.repeat(span > 2 * LEAF, span)] = 0
    i = np.flatnonzero(rest > 1)
    for d in range(1, 2 * LEAF):
        i = i[rest[i] > d]
        if not len(i):
            break
        x = i[possible(sizes[i], sizes[i + d], left[i], left[i + d], t) & ((side[i] == 0) | (side[i] != side[i + d]))]
        for at in range(0, len(x), 131_072):
            a = x[at : at + 131_072]
            ok = admits(points[a], points[a + d], sizes[a], sizes[a + d], t)
            found.append((ids[a[ok]], ids[a[ok] + d]))
    # Larger shards: a tree each, or two where the shard is a pair of blocks.
    for k in np.flatnonzero(span > 2 * LEAF):
        own = np.arange(starts[k], ends[k])
        if side[own[0]] == 0:
            tree = CountRTree(points[own], sizes[own], left[own])
            met = ((ids[own[x]], ids[own[y]]) for x, y in tree.join(tree, t, True))
        else:
            low, high = own[side[own] == 1], own[side[own] == 2]
            if not len(low) or not len(high):
                continue
            trees = CountRTree(points[low], sizes[low], left[low]), CountRTree(points[high], sizes[high], left[high])
            met = ((ids[low[x]], ids[high[y]]) for x, y in trees[0].join(trees[1], t, False))
        for pair in met:
            found.append(pair)
            if sum(len(f[0]) for f in found[-64:]) > at_once or len(found) > 4096:
                yield pairs()
    if found:
        yield pairs()


def similar_token_classes(classes: DataFrame, threshold: float = 0.7, block: int = 4096, paired: int = PAIRED) -> DataFrame:
    """(class_a, class_b, jaccard) for all pairs of different token sets at or above the threshold."""
    exact = Fraction(str(threshold))
    spark = classes.sparkSession
    counts = spark.sparkContext.broadcast(cell_counts(classes))
    pairs_held = spark.sparkContext.broadcast(pair_counts(classes, counts, exact, block, paired))
    sharded = classes.select("class_id", "hashes", "n").mapInArrow(_shard_rows(counts, pairs_held, exact, block, paired), "shard long, side int, class_id long, n int, left int, point binary")
    found = sharded.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(_search_shards(float(threshold)), "class_a long, class_b long").distinct()
    left = classes.select(F.col("class_id").alias("class_a"), F.col("hashes").alias("x"))
    right = classes.select(F.col("class_id").alias("class_b"), F.col("hashes").alias("y"))
    pairs = found.join(left, "class_a").join(right, "class_b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("shared")
    return pairs.where(F.col("shared") * F.lit(exact.denominator) >= union * F.lit(exact.numerator)).select("class_a", "class_b", (F.col("shared") / union).alias("jaccard"))


def near_duplicate_pairs(rows: DataFrame, id_col: str = "id", tokens_col: str = "tokens", threshold: float = 0.7, min_tokens: int = 10, block: int = 4096, paired: int = PAIRED) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records at or above the threshold, copies included."""
    repeated, classes = token_classes(rows, id_col, tokens_col, min_tokens)
    single = classes.where("copies = 1").select(F.col("class_id").alias("id"), "class_id")
    members = single.unionByName(repeated.select("id", "class_id"))
    links = similar_token_classes(classes, threshold, block, paired).select("class_a", "class_b")
    a, b = members.select(F.col("id").alias("x"), F.col("class_id").alias("class_a")), members.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
    again = repeated.select(F.col("id").alias("x"), "class_id").join(repeated.select(F.col("id").alias("y"), "class_id"), "class_id").where("x < y").select("x", "y")
    pairs = links.join(a, "class_a").join(b, "class_b").select("x", "y").unionByName(again)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(rows: DataFrame, id_col: str = "id", tokens_col: str = "tokens", threshold: float = 0.7, min_tokens: int = 10, block: int = 4096) -> DataFrame:
    """The compact form (id, class_id, group_id): group_id is the smallest id that a record is linked with through similar records."""
    from .components import components

    repeated, classes = token_classes(rows, id_col, tokens_col, min_tokens)
    members = classes.where("copies = 1").select(F.col("class_id").alias("id"), "class_id").unionByName(repeated.select("id", "class_id"))
    groups = components(similar_token_classes(classes, threshold, block), "class_a", "class_b").select(F.col("node").alias("class_id"), F.col("component_id").alias("group_id"))
    return members.join(groups, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))
