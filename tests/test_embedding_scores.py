import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.operators import blocks, grouping, navigation, similarity
from pagelattice.options import BATCH, Options
from pagelattice.plans import queries

SCHEMA = "id long, domain string, keywords array<string>, embedding array<double>"


def tabs_of(spark, n=160, seed=1, dims=12):
    r, g = random.Random(seed), np.random.default_rng(seed)
    centres = g.normal(size=(9, dims))
    rows = []
    for i in range(n):
        e = [float(x) for x in centres[r.randrange(9)] + g.normal(scale=0.5, size=dims)]
        kind = r.random()
        e = None if kind < 0.15 else [] if kind < 0.2 else e[:5] if kind < 0.3 else [0.0] * dims if kind < 0.33 else [float("nan")] + e[1:] if kind < 0.35 else e
        rows.append((i, r.choice(["", None, "a.test", "b.test", "c.test", f"s{i}.test"]), r.sample([f"k{x}" for x in range(30)], r.randrange(0, 6)) or None, e))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def score(x, y, bonus=0.25):
    """The definition: the cosine, the keywords where it is 0, and the bonus."""
    usable = lambda e: e and all(np.isfinite(e)) and any(e)
    a, b, s = x[3], y[3], 0.0
    if usable(a) and usable(b) and len(a) == len(b):
        s = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    if s == 0.0:
        p, q = set(x[2] or []), set(y[2] or [])
        s = len(p & q) / len(p | q) if p and q else 0.0
    return s + (bonus if x[1] and x[1] == y[1] else 0)


@pytest.mark.parametrize("block", [4096, 40])
def test_edges_are_those_of_all_pairs(spark, block, monkeypatch):
    rows, df = tabs_of(spark)
    monkeypatch.setattr(similarity.cosine_pairs, "__defaults__", (0.0, block))
    want = {(x[0], y[0]): round(score(x, y), 6) for i, x in enumerate(rows) for y in rows[i + 1 :] if score(x, y) >= 0.2}
    got = {(r.source, r.target): r.weight for r in similarity.similarity_edges(df).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 0.00051 for k in want)


@pytest.mark.parametrize("block", [4096, 40])
def test_neighbours_and_groups_are_those_of_all_pairs(spark, block, monkeypatch):
    rows, df = tabs_of(spark, seed=2)
    monkeypatch.setattr(similarity.cosine_best, "__defaults__", (0.0, block))
    near = {}
    for x in rows:
        found = sorted(((-round(score(x, y), 12), y[0]) for y in rows if y[0] != x[0] and score(x, y) >= 0.25))
        near[x[0]] = [b for _, b in found[:6]]
    got: dict[int, list] = {i: [] for i in near}
    for r in similarity.nearest(df).orderBy("a", "rank").collect():
        got[r.a].append(r.b)
    assert got == near


def test_groups_by_threshold_link_what_scores_just_the_bonus(spark):
    rows, df = tabs_of(spark, seed=3)
    options = Options(mutual_knn=False, domain_group=False, group_threshold=0.25)
    parent = {x[0]: x[0] for x in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if score(x, y) >= 0.25:
                p, q = find(x[0]), find(y[0])
                parent[max(p, q)] = min(p, q)
    got = {r.id: r.root for r in grouping.assign_groups(df, options).collect()}
    assert got == {x[0]: find(x[0]) for x in rows} and BATCH.mutual_knn


def test_candidates_reach_their_recall(spark):
    g = np.random.default_rng(7)
    centres = g.normal(size=(40, 16))
    v = [(i, [float(x) for x in centres[i % 40] + g.normal(scale=0.35, size=16)]) for i in range(1500)]
    vectors = similarity.unit_vectors(spark.createDataFrame(v, "id long, embedding array<double>"))
    r = similarity.candidate_recall(vectors, 6, cells=24, probes=4, block_rows=50).first()
    assert r.queries == 75 and r.exact == 450 and r.recall >= 0.9
    assert similarity.cosine_candidates(vectors.where("false"), 6).count() == 0


def test_no_embeddings_at_all(spark):
    _, df = tabs_of(spark, 40)
    assert similarity.similarity_edges(df.drop("embedding")).count() > 0
    assert similarity.nearest(df.where("false")).count() == 0


def test_hot_keywords_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 15)
    rows = [(i, None, ["hot", f"k{i % 7}", f"m{i % 11}"], None) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(df, 0.5).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(set(rows[i][2]) & set(rows[j][2])) >= 0.5 * len(set(rows[i][2]) | set(rows[j][2]))}
    assert got == want and similarity.jaccard_pairs(df, 0.5).count() == len(want)


def test_a_cosine_of_zero_leaves_it_to_the_keywords(spark):
    axis = lambda k: [1.0 if j == k else 0.0 for j in range(4)]
    rows = [(i, "a.test" if i % 5 == 0 else None, [f"k{i % 3}", f"m{i % 4}"] if i % 6 else [], axis(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(x[0], y[0]): score(x, y) for i, x in enumerate(rows) for y in rows[i + 1 :] if score(x, y) >= 0.2}
    got = {(r.source, r.target): r.weight for r in similarity.similarity_edges(df).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 0.00051 for k in want)
    near = {x[0]: [b for _, b in sorted((-round(score(x, y), 12), y[0]) for y in rows if y[0] != x[0] and score(x, y) >= 0.25)[:6]] for x in rows}
    found: dict[int, list] = {i: [] for i in near}
    for r in similarity.nearest(df).orderBy("a", "rank").collect():
        found[r.a].append(r.b)
    assert found == near


def test_neighbours_by_the_index(spark):
    _, df = tabs_of(spark, seed=6)
    df = df.where("embedding is null or size(embedding) <> 5")  # one length of vectors
    key = lambda d: {(r.a, r.b, r.rank) for r in d.collect()}
    exact = key(similarity.nearest(df))
    assert key(similarity.nearest(df, index=(1, 1))) == exact
    some = {(a, b) for a, b, _ in key(similarity.nearest(df, index=(9, 3)))}
    assert len(some & {(a, b) for a, b, _ in exact}) >= 0.8 * len(exact)


def shuffled_rows(spark, work):
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seen = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(seen.apply(i).shuffleWriteRecords() for i in range(seen.size()))

    before = written()
    work()
    return written() - before


def test_neighbours_are_found_without_copying_rows(spark):
    _, df = tabs_of(spark, 600)
    rows = similarity.unit_vectors(df.withColumn("domain", F.coalesce("domain", F.lit(""))).withColumn("kw", F.array().cast("array<string>")), "id", "embedding", "domain", "kw")
    few, many = (shuffled_rows(spark, lambda: similarity.cosine_best(rows, 6, 0.25, 0.25, b).count()) for b in (300, 20))
    assert many <= 1.2 * few  # however many blocks meet


def test_only_asked_vectors_ask_in_the_index(spark):
    _, df = tabs_of(spark, 600)
    vectors = similarity.unit_vectors(df)
    every, some = (shuffled_rows(spark, lambda: similarity.candidate_recall(vectors, 6, queries_every=e, cells=8, probes=8).collect()) for e in (1, 20))
    assert some <= 0.5 * every


def test_edges_are_found_without_a_shuffle_of_pairs(spark):
    _, df = tabs_of(spark, 600)
    edges = similarity.similarity_edges(df)
    assert shuffled_rows(spark, lambda: edges.foreach(lambda _: None)) < edges.count()


def test_navigations_take_their_place_without_a_shuffle_of_edges(spark):
    _, df = tabs_of(spark, 300)
    edges = similarity.similarity_edges(df).withColumn("ts", F.lit(None).cast("timestamp"))
    ends = edges.select("source", "target").limit(20).collect()
    rows = [(t, s, 1.0, "navigation") if i % 2 else (s, t, 1.0, "navigation") for i, (s, t) in enumerate(ends)] + [(0, 0, 1.0, "navigation"), (None, 1, 1.0, "navigation")]
    moves = spark.createDataFrame(rows, "source long, target long, weight double, reason string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    merged = navigation.merge_into(edges, moves)
    assert sorted(map(str, merged.collect())) == sorted(map(str, navigation.merge_edges(edges.unionByName(moves)).collect()))
    assert shuffled_rows(spark, lambda: merged.foreach(lambda _: None)) == 0


def test_the_index_writes_vectors_once(spark):
    _, df = tabs_of(spark, 600)
    vectors = similarity.unit_vectors(df)
    few, many = (shuffled_rows(spark, lambda: similarity.candidate_recall(vectors, 6, queries_every=1, cells=4, probes=4, block_rows=b).collect()) for b in (600, 20))
    assert many <= 1.2 * few  # however many blocks a cell has
    n = vectors.count()
    asked_once = shuffled_rows(spark, lambda: similarity.cosine_candidates(vectors.localCheckpoint(), 6, cells=8, probes=8).count())
    assert asked_once <= 5 * n  # not a copy for each of the eight cells


def held_in_folder(spark):
    at = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return {p for p in at.iterdir() if p.name.startswith(("rdd-", "table-", "blocks-"))}


def test_mutual_neighbours_are_written_once(spark, tmp_path):
    _, df = tabs_of(spark, 300)
    similarity.nearest(df.limit(1))  # there is a folder
    df.withColumn("duplicate_of", F.lit(None).cast("long")).write.parquet(f"{tmp_path}/tabs.parquet")
    before = held_in_folder(spark)
    assert queries.queries()["mutual_knn"](spark, str(tmp_path)).count() > 0
    assert len(held_in_folder(spark) - before) == 1


def test_links_of_groups_write_neighbours_once(spark):
    _, df = tabs_of(spark, 300)
    similarity.nearest(df.limit(1))
    before = held_in_folder(spark)
    assert grouping.group_links(df, Options(domain_group=False, group_threshold=0.5)).count() > 0
    assert len(held_in_folder(spark) - before) == 1


def test_joins_know_the_size_of_neighbours(spark):
    _, df = tabs_of(spark, 600)
    found = similarity.nearest(df)  # else they would be broadcast, however many there are
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 4 * found.count()


def test_both_sides_of_a_product_find_what_each_finds_alone(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    r, g = random.Random(5), np.random.default_rng(5)
    rows = [{"id": i, "domain": r.choice(["", "a.test", "b.test"]), "kw": r.sample([f"k{x}" for x in range(12)], r.randrange(5)), "v": [0.0, *g.normal(size=6)] if i % 7 else [1.0] + [0.0] * 6} for i in range(400)]  # some cosines are 0
    kind = pa.schema([("id", pa.int64()), ("domain", pa.string()), ("kw", pa.list_(pa.string())), ("v", pa.list_(pa.float64()))])
    files = [f"{tmp_path}/{n}.parquet" for n in "xy"]
    for n, f in enumerate(files):
        pq.write_table(pa.Table.from_pylist(sorted(rows[n::2], key=lambda t: (t["domain"], t["id"])), kind), f)
    x, y = blocks.Side(files[:1]), blocks.Side(files[1:])
    alone = []
    for p, q in ((x, blocks.Side(files[1:], x)), (y, blocks.Side(files[:1], y))):
        best = blocks.Best(len(p.ids), 4, 0.3)
        blocks._by_cosine(p, q, 7, 0.25, best)
        alone.append(sorted(zip(*best.rows(p.ids).to_pydict().values())))
    best, other = blocks.Best(len(x.ids), 4, 0.3), blocks.Side(files[1:], x)
    both = blocks.Both(best, x, np.full(len(other.ids), 0.3))
    blocks._by_cosine(x, other, 7, 0.25, both)
    assert sorted(zip(*best.rows(x.ids).to_pydict().values())) == alone[0]
    found = {}
    for a, b, s, _ in (row for batch in both.found for row in zip(*batch.to_pydict().values())):
        found.setdefault(a, []).append((-round(s, 12), b))
    ranked = sorted((a, b, n) for a, some in found.items() for n, (_, b) in enumerate(sorted(some)[:4], 1))
    assert ranked == sorted((a, b, n) for a, b, _, n in alone[1])


@pytest.mark.parametrize("options", [BATCH, Options(domain_group=False, group_threshold=0.5)])
def test_groups_of_products_made_once_equal_those_made_from_both_sides(spark, monkeypatch, options):
    _, df = tabs_of(spark, 500, seed=4)
    exact = lambda rows, k, threshold, bonus: blocks.best_scores(rows, k, threshold, bonus, 40)
    monkeypatch.setattr(similarity, "cosine_best", exact)
    results = []
    for kept in (1e9, -1):  # always, never
        monkeypatch.setattr(blocks, "KEPT", kept)
        results.append(sorted(map(tuple, grouping.assign_groups(df, options).collect())))
    monkeypatch.setattr(similarity, "cosine_best", lambda rows, k, threshold, bonus: blocks.best_scores(rows, k, threshold, bonus, 1000))  # one block
    results.append(sorted(map(tuple, grouping.assign_groups(df, options).collect())))
    assert results[0] == results[1] == results[2] and len({root for _, root in results[0]}) < 500
