import numpy as np
import pyarrow as pa

from pagelattice.llm import components, near_dup, vptree


def test_a_hub_with_most_links_is_cut_into_several_partitions(spark):
    rows = [(0, i) for i in range(1, 4001)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(300)]
    links = spark.createDataFrame(rows, "a long, b long")
    got = {(r.component_id, r.node) for r in components.components(links, "a", "b", task_edges=4000).collect()}
    assert got == {(0, i) for i in range(4001)} | {(10_000 + 2 * i, 10_000 + 2 * i + k) for i in range(300) for k in (0, 1)}
    parts = links.repartitionByRange(8, "a", "b").rdd.glom().map(len).collect()
    assert max(parts) < 2 * len(rows) / 8


def test_shards_are_read_in_bounded_tables():
    shards = np.repeat(np.arange(50), 37)
    batches = [pa.RecordBatch.from_arrays([pa.array(shards[i : i + 100])], names=["shard"]) for i in range(0, len(shards), 100)]
    tables = list(near_dup._shard_runs(iter(batches), least_rows=200))
    assert np.concatenate([t.column("shard").to_numpy() for t in tables]).tolist() == shards.tolist()
    assert max(t.num_rows for t in tables) <= 200 + 100 + 37
    for x, y in zip(tables, tables[1:]):
        assert x.column("shard")[-1] != y.column("shard")[0]


def test_one_token_in_most_records(spark):
    rows = [(i, ["everywhere"] + [f"t{(i * 7 + k) % 400}" for k in range(12)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    sets = [set(t) for _, t in rows]
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    assert {tuple(r) for r in near_dup.near_duplicate_pairs(df, block=64).collect()} == want


def test_relaxed_search_reports_its_recall_and_share(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(20, 64))[rng.integers(0, 20, 800)] + rng.normal(scale=0.3, size=(800, 64))).tolist()
    tabs = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>").coalesce(1)
    asked = vptree.stated_query_set(tabs)
    r = vptree.recall(tabs, asked, factor=0.5, leaf=16).first()
    s = vptree.compared_share(tabs, asked, factor=0.5, leaf=16).first()
    assert r.queries == 40 and r.exact == 200 and r.recall >= 0.9 and 0 < s.compared < s.pairs == 40 * 800
    assert vptree.recall(tabs, asked, factor=1.0, leaf=16).first().recall == 1.0


def test_frequent_tokens_meet_by_pairs(spark):
    rng = np.random.default_rng(11)
    base = [rng.choice(60, size=n, replace=False) for n in (10, 12, 14, 20, 30, 12, 11)]
    rows = []
    for i in range(420):
        b = base[i % 7].copy()
        for _ in range(rng.integers(0, 4)):
            b[rng.integers(len(b))] = rng.integers(60)
        rows.append((i, [f"t{x}" for x in b]))
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    sets = [set(t) for _, t in rows]
    for threshold, least in ((0.7, 10), (0.5, 1)):
        want = {(i, j) for i in range(420) for j in range(i + 1, 420) if min(len(sets[i]), len(sets[j])) >= least and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}
        for paired in (256, 12, 1):
            assert {tuple(r) for r in near_dup.near_duplicate_pairs(df, threshold=threshold, min_tokens=least, block=20, paired=paired).collect()} == want
