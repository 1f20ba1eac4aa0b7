"""Problem 2: all pairs of records whose value sets have at least a given Jaccard similarity.

Size-aware overlap join. Two sets of sizes m and n reach the threshold t exactly when they share at least
c(m, n) = ceil(t / (1 + t) * (m + n)) values. Sets of at most ``small_size`` values are joined with each other on their c-element
subsets: each small set emits, for every c that some partner size asks of it, all its subsets of c values as one 64-bit key, and
two sets meet only where such a key and the sizes agree, so that every meeting is a pair of the result and a value that a third
of all records hold costs nothing by itself. Pairs with a larger set come from inverted lists: with the values ordered from rare to common,
two such sets share one of their first n - ceil(t * n) + 1 values, so only those entries are listed and scanned. The union of both is verified
with the exact sets. Equal sets are one class until the end, so copies cost one record each.

Defined cases: values are trimmed and lower-cased; null and blank values don't count; null, empty and blank sets match nothing; rows with a
null id take no part; repeated ids count once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix64, squeezed


def required_overlap(m: int, n: int, threshold: Fraction) -> int:
    return max(1, ceil(threshold / (1 + threshold) * (m + n)))


def partner_sizes(n: int, threshold: Fraction) -> range:
    return range(max(1, ceil(threshold * n)), floor(n / threshold) + 1)


def value_sets(rows: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """(id, items): the sorted distinct cleaned values of every row that has any."""
    cleaned = F.transform(F.col(set_col), lambda x: F.lower(squeezed(x)))
    items = F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))))
    return rows.select(F.col(id_col).alias("id"), items.alias("items")).where("id is not null and size(items) > 0")


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members (id, class_id), classes (class_id, items, n); class_id is the smallest id with that set."""
    keyed = sets.select("id", "items", F.xxhash64("items").alias("h"))
    classes = checkpoint(keyed.groupBy("h", "items").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("copies")))
    members = keyed.join(classes.select("h", "items", "class_id"), ["h", "items"]).select("id", "class_id").distinct()
    return members, classes.select("class_id", "items", F.size("items").alias("n"), "copies")


def _subset_keys(threshold: Fraction, small_size: int):
    plan: dict[int, list[tuple[int, np.ndarray]]] = {}
    for n in range(1, small_size + 1):
        wanted = sorted({required_overlap(n, m, threshold) for m in partner_sizes(n, threshold) if m <= small_size})
        plan[n] = [(c, np.array(list(combinations(range(n), c)), dtype=np.int64)) for c in wanted if c <= n]

    def emit(batches):
        for batch in batches:
            sets = batch.column("hashes")
            flat, offsets = sets.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())])
            ids, sizes = batch.column("class_id").to_numpy(), batch.column("n").to_numpy()
            mixed = mix64(flat.view(np.uint64))
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096]
                    values = mixed[offsets[some][:, None] + np.arange(n)]
                    for c, picks in plan[int(n)]:
                        with np.errstate(over="ignore"):
                            keys = mix64(values[:, picks].sum(axis=2, dtype=np.uint64) + np.uint64(c)).view(np.int64)
                        k = len(picks)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.ravel()), pa.array(np.full(keys.size, c, np.int32)), pa.array(np.repeat(ids[some], k)), pa.array(np.full(keys.size, n, np.int32))],
                            names=["key", "c", "class_id", "n"],
                        )

    return emit


def _small_pairs(classes: DataFrame, threshold: Fraction, small_size: int) -> DataFrame:
    hashed = classes.where(F.col("n") <= small_size).select("class_id", "n", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    keys = hashed.mapInArrow(_subset_keys(threshold, small_size), "key long, c int, class_id long, n int")
    ratio = threshold / (1 + threshold)
    a, b = keys.alias("a"), keys.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(ratio.numerator) / F.lit(ratio.denominator))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.class_id") < F.col("b.class_id")) & (need == F.col("a.c")))
    return met.select(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b"))


def _large_pairs(classes: DataFrame, threshold: Fraction, small_size: int) -> DataFrame:
    least = ceil(threshold * (small_size + 1))
    rows = classes.where(F.col("n") >= least).select("class_id", "n", F.explode("items").alias("item"))
    listed = rows.select("class_id", "n", F.xxhash64("item").alias("item"))
    counts = listed.groupBy("item").agg(F.count("*").alias("df"))
    ordered = listed.join(counts, "item").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("entries"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(threshold.numerator) / F.lit(threshold.denominator)).cast("int") + 1
    lists = ordered.select("class_id", "n", F.explode(F.slice("entries", F.lit(1), length)).alias("entry")).select("class_id", "n", F.col("entry.item").alias("item"))
    a, b = lists.where(F.col("n") > small_size).alias("a"), lists.alias("b")
    t = float(threshold)
    sizes = (F.col("a.n") * t <= F.col("b.n") + 1e-9) & (F.col("b.n") * t <= F.col("a.n") + 1e-9)
    met = a.join(b, (F.col("a.item") == F.col("b.item")) & sizes & (F.col("a.class_id") != F.col("b.class_id")))
    return met.select(F.least("a.class_id", "b.class_id").alias("class_a"), F.greatest("a.class_id", "b.class_id").alias("class_b"))


def similar_classes(classes: DataFrame, threshold: float = 0.6, small_size: int = 8) -> DataFrame:
    """(class_a, class_b, shared, jaccard) for all pairs of different sets at or above the threshold."""
    exact = Fraction(str(threshold))
    found = _small_pairs(classes, exact, small_size).unionByName(_large_pairs(classes, exact, small_size)).distinct()
    left = classes.select(F.col("class_id").alias("class_a"), F.col("items").alias("items_a"))
    right = classes.select(F.col("class_id").alias("class_b"), F.col("items").alias("items_b"))
    pairs = found.join(left, "class_a").join(right, "class_b").withColumn("shared", F.size(F.array_intersect("items_a", "items_b")))
    union = F.size("items_a") + F.size("items_b") - F.col("shared")
    kept = pairs.where(F.col("shared") * F.lit(exact.denominator) >= union * F.lit(exact.numerator))
    return kept.select("class_a", "class_b", "shared", (F.col("shared") / union).alias("jaccard"))


def similar_pairs(rows: DataFrame, id_col: str = "id", set_col: str = "keywords", threshold: float = 0.6, small_size: int = 8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records at or above the threshold, copies of equal sets included."""
    members, classes = set_classes(value_sets(rows, id_col, set_col))
    members = members.select("id", "class_id")
    links = similar_classes(classes, threshold, small_size).select("class_a", "class_b")
    same = classes.where("copies > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    a, b = members.select(F.col("id").alias("x"), F.col("class_id").alias("class_a")), members.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
    pairs = links.join(a, "class_a").join(b, "class_b").select("x", "y").unionByName(same.join(a, "class_a").join(b, "class_b").where("x < y").select("x", "y"))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_pairs_between(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_set: str, right_set: str, threshold: float = 0.6, small_size: int = 8) -> DataFrame:
    """(left_id, right_id) for two tables: both sides are joined as one collection of classes, then expanded side by side."""
    both = value_sets(left, left_id, left_set).select(F.lit(0).alias("side"), "id", "items").unionByName(value_sets(right, right_id, right_set).select(F.lit(1).alias("side"), "id", "items"))
    keyed = both.select("side", "id", "items", F.xxhash64("items").alias("h"))
    classes = checkpoint(keyed.groupBy("h", "items").agg(F.min(F.struct("side", "id")).alias("first")).withColumn("class_id", F.xxhash64(F.col("first.side"), F.col("first.id"))))
    members = keyed.join(classes.select("h", "items", "class_id"), ["h", "items"]).select("side", "id", "class_id").distinct()
    links = similar_classes(classes.select("class_id", "items", F.size("items").alias("n")), threshold, small_size).select("class_a", "class_b")
    same = classes.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    pairs = links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"))).unionByName(same)
    a = members.where("side = 0").select(F.col("id").alias("left_id"), F.col("class_id").alias("class_a"))
    b = members.where("side = 1").select(F.col("id").alias("right_id"), F.col("class_id").alias("class_b"))
    return pairs.join(a, "class_a").join(b, "class_b").select("left_id", "right_id")


def link_counts(rows: DataFrame, id_col: str = "id", set_col: str = "keywords", threshold: float = 0.6, small_size: int = 8) -> DataFrame:
    """The compact form: one row per record (id, class_id, copies, links), links being the number of similar records with other sets."""
    members, classes = set_classes(value_sets(rows, id_col, set_col))
    links = similar_classes(classes, threshold, small_size)
    both = links.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(links.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    sizes = classes.select(F.col("class_id").alias("other"), "copies")
    counted = both.join(sizes, "other").groupBy("class_id").agg(F.sum("copies").alias("links"))
    out = members.join(classes.select("class_id", "copies"), "class_id").join(counted, "class_id", "left")
    return out.select("id", "class_id", F.col("copies").cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
