"""Similarity of tabs: scores by embedding and keywords, edges, nearest neighbours.

A score is the cosine of the two embeddings; where that is exactly 0 (one is missing, empty or all zero, or their lengths differ) it is the Jaccard similarity of the keywords. Tabs of one
domain get a bonus. Embeddings with entries that aren't finite count as missing.

Cosines come from matrices: unit vectors lie in blocks of ``BLOCK`` rows, each pair of blocks is one task that multiplies two matrices and keeps what reaches the threshold (or the k best of each row),
so no pair below it is ever a row. Keyword scores come from a prefix-filtered equi-join, which leaves out the pairs that have a cosine. Only results that ask for every pair within a domain are quadratic in it.
``cosine_candidates`` is the other way for collections where all blocks against all is too much: vectors meet in the cells of the pivots nearest to them, at a recall that ``candidate_recall`` measures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint, release, stored
from .blocks import best_scores, cell_scores, every_score

BLOCK = 4096
# Records of one keyword that meet in one task at most (twice); more are cut into blocks that meet pairwise.
HOT = 20_000


def keyword_sets(tabs: DataFrame) -> DataFrame:
    """(id, domain, kw, n, dims): distinct non-null keywords, and the length of a usable embedding (0 without one)."""
    kw = F.array_distinct(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull()))
    rows = tabs.where("id is not null").select("id", F.coalesce("domain", F.lit("")).alias("domain"), kw.alias("kw"), usable_dims(tabs).alias("dims"))
    return rows.withColumn("n", F.size("kw"))


def usable_dims(tabs: DataFrame):
    """Length of the embedding where all its entries are finite and some isn't 0, else 0."""
    if "embedding" not in tabs.columns:
        return F.lit(0)
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0), F.size(e)).otherwise(0)


def jaccard_pairs(tabs: DataFrame, threshold: float, same_domain: bool | None = None) -> DataFrame:
    """(a, b, shared, jaccard) of all pairs a < b with at least this similarity, within domains, across them or (None) both.

    Prefix filter: with keywords ordered from rare to common, such pairs share one of the first n - ceil(t * n) + 1 of both, so common keywords are rarely joined on. A threshold
    of zero asks for every pair that shares a keyword.
    """
    return _jaccard(keyword_sets(tabs), threshold, same_domain, False)


def _jaccard(sets: DataFrame, threshold: float, same_domain: bool | None, without_cosine: bool) -> DataFrame:
    sets = sets.where("n > 0")
    items = sets.select("id", "domain", "n", "dims", F.explode("kw").alias("k"))
    df = items.groupBy("k").agg(F.count("*").alias("df"))
    ordered = items.join(df, "k").groupBy("id", "domain", "n", "dims").agg(F.sort_array(F.collect_list(F.struct("df", "k"))).alias("e"))
    length = F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1) if threshold > 0 else F.col("n")
    prefix = ordered.select("id", "domain", "n", "dims", F.explode(F.slice("e", F.lit(1), F.least(length, F.col("n")))).alias("e")).select("id", "domain", "n", "dims", F.col("e.k").alias("k"), F.ceil(F.col("e.df") / HOT).cast("int").alias("blocks"))
    prefix = prefix.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    prefix = prefix.select("id", "domain", "n", "dims", "k", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    x, y = prefix.alias("x"), prefix.alias("y")
    on = (F.col("x.k") == F.col("y.k")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high")) & (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9)
    on = on & ((F.col("x.low") == F.col("x.high")) | (F.col("x.own") != F.col("y.own")))  # two blocks meet in one cell only
    if same_domain is not None:
        equal = (F.col("x.domain") == F.col("y.domain")) & (F.col("x.domain") != "")
        on = on & (equal if same_domain else ~equal)
    if without_cosine:
        on = on & ((F.col("x.dims") == 0) | (F.col("x.dims") != F.col("y.dims")))
    pairs = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("kw").alias("ka")), sets.select(F.col("id").alias("b"), F.col("kw").alias("kb"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("ka", "kb")))
    scored = scored.withColumn("jaccard", F.col("shared") / (F.size("ka") + F.size("kb") - F.col("shared")))
    return scored.where(F.col("jaccard") >= threshold).select("a", "b", "shared", "jaccard")


# ---- cosines


def usable_vectors(rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", *keep: str) -> DataFrame:
    """(id, v, *keep): usable embeddings."""
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), *keep).where("id is not null")
    return some.where(usable_dims(some) > 0).select("id", F.col("embedding").alias("v"), *keep)


def unit_vectors(rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", *keep: str) -> DataFrame:
    """(id, v, *keep): usable embeddings; of a repeated id one counts."""
    return usable_vectors(rows, id_col, vector_col, *keep).dropDuplicates(["id"])


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _stacked(v: pa.Array, dims: int) -> np.ndarray:
    """A matrix of lists of one length."""
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dims)


def cosine_pairs(rows: DataFrame, threshold: float, bonus: float = 0.0, block_rows: int = BLOCK // 2, *, plain: bool = False) -> DataFrame:
    """(a, b, score, same_domain), a < b, of rows (id, v, domain, kw) whose cosine (without one the similarity of keywords) and bonus reach the threshold; ``plain``: also those of a domain with neither."""
    return every_score(rows, threshold, bonus, block_rows, plain)


def cosine_best(rows: DataFrame, k: int, threshold: float, bonus: float = 0.0, block_rows: int = BLOCK) -> DataFrame:
    """(a, b, score, rank): the k best scores at or above the threshold of every row (id, v, domain, kw), or of those with ``ask``, by cosine (without one by keywords) and bonus."""
    return best_scores(rows, k, threshold, bonus, block_rows)


def cosine_neighbors(vectors: DataFrame, id_col: str, vector_col: str, k: int, block_rows: int = BLOCK, asked=None) -> DataFrame:
    """(a, b, cosine, rank): exact k best cosines of every vector, or of those whose ``asked`` (of the column id) is true."""
    rows = usable_vectors(vectors, id_col, vector_col).select("id", F.lit("").alias("domain"), F.array().cast("array<string>").alias("kw"), "v")  # of a repeated id one counts there
    rows = rows if asked is None else rows.withColumn("ask", asked)
    return best_scores(rows, k, -2.0, 0.0, block_rows).withColumnRenamed("score", "cosine")


def pivots(vectors: DataFrame, count: int, sample: int = 20_000, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Centres of about equally spread cells, by a few rounds of spherical k-means over a sample of at most ``sample`` vectors (those with the smallest hashes)."""
    longest = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if longest is None:
        return np.empty((0, 0))
    rows = vectors.where(F.size("v") == longest.d).select(F.xxhash64(F.lit(seed), "id").alias("h"), "id", "v")
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes are sorted, not vectors
    taken = rows.where(F.col("h") <= last).toArrow().sort_by([("h", "ascending"), ("id", "ascending")]).slice(0, sample)
    m = _units(_stacked(taken["v"].combine_chunks(), longest.d))
    centres = m[np.random.default_rng(seed).permutation(len(m))[:count]]
    for _ in range(rounds):
        near = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres[filled] = sums[filled]
        centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-12)
    return centres


def cosine_candidates(vectors: DataFrame, k: int, cells: int = 64, probes: int = 6, block_rows: int = BLOCK, bonus: float = 0.0, threshold: float = -2.0, asked=None) -> DataFrame:
    """(a, b, cosine, rank): the k best cosines (with domain and kw columns: scores as in ``cosine_best``, at or above the threshold) among the vectors of the ``probes`` cells nearest to each, or to those whose ``asked`` (of the column id) is true.
    Every vector lies in one cell and asks in several; the pivots are fitted on a bounded sample, and all vectors of the commonest length are indexed. Vectors are written once, sorted by cell, however many cells and blocks they ask in. ``vectors`` is read several times."""
    centres = pivots(vectors, cells)
    if not centres.size:
        return vectors.sparkSession.createDataFrame([], "a long, b long, cosine double, rank int")
    held = vectors.sparkSession.sparkContext.broadcast(centres)  # cells x dimensions: bounded by its parameter

    def place(batches):
        c = held.value
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), c.shape[1]))
            if batch.num_rows:
                s = _units(_stacked(batch.column("v"), c.shape[1])) @ c.T
                near = np.argsort(-s, axis=1)[:, : max(1, probes)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ascontiguousarray(near[:, 0])), lists], names=[*batch.schema.names, "cell", "probes"])

    domain = F.col("domain") if "domain" in vectors.columns else F.lit("")
    kw = F.col("kw") if "kw" in vectors.columns else F.array().cast("array<string>")
    rows = vectors.select("id", domain.alias("domain"), kw.alias("kw"), "v", (F.lit(True) if asked is None else asked).alias("ask"))
    placed = rows.mapInArrow(place, "id long, domain string, kw array<string>, v array<double>, ask boolean, cell int, probes array<int>")
    return cell_scores(placed, k, threshold, bonus, block_rows).withColumnRenamed("score", "cosine")


def candidate_recall(vectors: DataFrame, k: int, queries_every: int = 20, **options) -> DataFrame:
    """(queries, exact, found, recall) of ``cosine_candidates`` for the vectors whose id is divisible by ``queries_every``, against all vectors."""
    vectors = stored(vectors.select("id", "v"))  # read several times
    release(vectors.sparkSession)
    asked = F.col("id") % queries_every == 0
    exact = cosine_neighbors(vectors.withColumnRenamed("v", "embedding"), "id", "embedding", k, asked=asked).select("a", "b")
    some = cosine_candidates(vectors, k, asked=asked, **options).select("a", "b", F.lit(1).alias("hit"))
    return exact.join(some.hint("merge"), ["a", "b"], "left").agg(F.count_distinct("a").alias("queries"), F.count("*").alias("exact"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


# ---- scores


def scored_pairs(tabs: DataFrame, threshold: float, bonus: float) -> DataFrame:
    """(a, b, score, same_domain) of all pairs that have a cosine or share a keyword and score at least the threshold."""
    return cosine_pairs(_scoring_rows(tabs), threshold, bonus)


def _scoring_vectors(tabs: DataFrame) -> DataFrame:
    """(id, v, domain, kw) of the tabs with a usable embedding."""
    kw = F.array_distinct(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull()))
    return unit_vectors(tabs.withColumns({"domain": F.coalesce("domain", F.lit("")), "kw": kw}), "id", "embedding", "domain", "kw")


def _scoring_rows(tabs: DataFrame) -> DataFrame:
    """(id, domain, kw, v) of all tabs; v is null where there is no usable embedding."""
    v = F.when(usable_dims(tabs) > 0, F.col("embedding").cast("array<double>")) if "embedding" in tabs.columns else F.lit(None).cast("array<double>")
    kw = F.array_distinct(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull()))
    return tabs.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("domain", F.lit("")).alias("domain"), kw.alias("kw"), v.alias("v"))


def domain_pairs(tabs: DataFrame) -> DataFrame:
    """(a, b) of all pairs within a domain (the empty one included): quadratic in the largest domain, for results that ask for every pair."""
    rows = keyword_sets(tabs).select("id", "domain")
    return rows.select(F.col("id").alias("a"), "domain").join(rows.select(F.col("id").alias("b"), "domain"), "domain").where("a < b")


def _plain_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b) of two sides (id, domain, kw, n, dims) within a domain whose pairs have neither a cosine nor a common keyword, so that they score just the bonus."""
    left = x.select(F.col("id").alias("a"), "domain", F.col("kw").alias("ka"), F.col("dims").alias("da"))
    right = y.select(F.col("id").alias("b"), "domain", F.col("kw").alias("kb"), F.col("dims").alias("db"))
    apart = (F.col("da") == 0) | (F.col("da") != F.col("db"))
    return left.join(right, "domain").where(apart & (F.col("a") != F.col("b")) & ~F.arrays_overlap("ka", "kb")).select("a", "b")


def similarity_edges(tabs: DataFrame, threshold: float = 0.2, bonus: float = 0.25, every_pair: bool = True, dialect: str = "batch") -> DataFrame:
    """(source, target, weight, reason). Where the bonus alone reaches the threshold every pair of a domain without a cosine is an edge; every_pair=False leaves out those that share no
    keyword: ``domain_cliques`` holds them as one row per domain instead of a quadratic number."""
    edges = cosine_pairs(_scoring_rows(tabs), threshold, bonus, plain=every_pair and bonus >= threshold)
    rounded = F.bround("score", 3) if dialect == "batch" else F.round("score", 3)
    return edges.select(F.col("a").alias("source"), F.col("b").alias("target"), rounded.alias("weight"), F.when(F.col("same_domain"), "similarity+domain").otherwise("similarity").alias("reason"))


def domain_cliques(tabs: DataFrame, bonus: float = 0.25) -> DataFrame:
    """(domain, members, pairs, weight): the pairs of a domain in compact form; those with a cosine or a common keyword are among the scored pairs with their own weight, or below the threshold."""
    return tabs.where("id is not null and domain <> ''").groupBy("domain").agg(F.count("*").alias("members")).where("members > 1").select("domain", "members", (F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("pairs"), F.lit(bonus).alias("weight"))


def nearest(tabs: DataFrame, threshold: float = 0.25, bonus: float = 0.25, k: int = 6, index: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, score, rank), stored: the k best scores of each tab at or above the threshold, ties by the smaller id. ``index`` (cells, probes) takes cosines from ``cosine_candidates`` instead of all pairs of blocks.

    A pair of one domain with neither a cosine nor a common keyword scores just the bonus. Such pairs are looked for among the first tabs of the domain by kind of embedding (its length, 0 without one): of each kind
    a tab has pairs with all tabs or, if it has that kind itself, with none, but for those that share a keyword, so of each kind 2k + 1 tabs are enough unless more than k + 1 of them share one; then those rank before.
    """
    if index is None:
        return cosine_best(_scoring_rows(tabs), k, threshold, bonus)
    sets = checkpoint(keyword_sets(tabs))
    half = _jaccard(sets, max(threshold, 0.0), False, True).select("a", "b", F.col("jaccard").alias("score"))
    within = _jaccard(sets, max(threshold - bonus, 0.0), True, True).select("a", "b", (F.col("jaccard") + bonus).alias("score")).where(F.col("score") >= threshold)
    half = checkpoint(half.unionByName(within))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    if "embedding" in tabs.columns:
        found = cosine_candidates(stored(_scoring_vectors(tabs)), k, *index, bonus=bonus, threshold=threshold)
        both = both.unionByName(found.select("a", "b", F.col("cosine").alias("score")))
    if bonus >= threshold:
        rows = sets.where("domain <> ''")
        head = rows.withColumn("r", F.row_number().over(Window.partitionBy("domain", "dims").orderBy("id"))).where(F.col("r") <= 2 * k + 1)
        both = both.unionByName(_plain_pairs(rows, head).select("a", "b", F.lit(bonus).alias("score")))
    order = Window.partitionBy("a").orderBy(F.desc(F.round("score", 12)), "b")
    return stored(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def mutual(neighbors: DataFrame) -> DataFrame:
    """(a, b), a < b, where each is among the other's neighbours."""
    back = neighbors.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return neighbors.select("a", "b").join(back, ["a", "b"], "left_semi").where("a < b")
