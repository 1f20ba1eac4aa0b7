import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import dedupe, grouping, similarity
from pagelattice.operators.components import connected_components
from pagelattice.operators.graph_views import adjacency, group_meta, tab_groups_of
from pagelattice.operators.search import ordered_results, parse_panel_query, parse_query, search_groups
from pagelattice.options import BATCH, LIVE, Options
from pagelattice.plans import pipeline
from pagelattice.sources.readers import WINDOWS, flatten_windows

WINDOW_ROWS = [
    ("chrome", 101, [("Apache Spark unified analytics engine", "https://www.github.com/apache/spark/?utm_source=x"), ("Apache Spark repository", "https://github.com/apache/spark"),
                     ("Apache Flink stream processing", "https://github.com/apache/flink"), ("New Tab", "chrome://newtab/"), ("dropped: no url", "")]),
    ("firefox", None, [("Spark analytics engine streaming guide", "https://streaming.example.net/guide"), ("World news daily", "https://news.example.org/a?b=2&a=1#top"),
                       ("Daily world news", "https://news.example.org/a?a=1&b=2&fbclid=zz"), ("World news daily", "http://news.example.org:80/b;v=1/"), ("Pasta recipe", "https://cooking.example.com/pasta")]),
]


def worked(spark, options=BATCH):
    windows = spark.createDataFrame([(i, *w) for i, w in enumerate(WINDOW_ROWS)], "window_pos long, " + WINDOWS)
    return pipeline.build_batch(flatten_windows(windows), options=options)


def test_worked_example(spark):
    g = worked(spark)
    tabs = {r.id: r for r in g.tabs.collect()}
    assert len(tabs) == 9
    assert {i: t.duplicate_of for i, t in tabs.items() if t.duplicate_of is not None} == {1: 0, 6: 5, 7: 5}
    assert tabs[1].keywords == ["apache", "spark", "unified", "analytics", "engine"] and tabs[3].error == "unsupported_url"
    assert tabs[0].simhash % 2**64 == 12173540061086554270 and tabs[8].simhash % 2**64 == 9660278426875073168 and tabs[3].simhash is None
    assert tabs[0].aliases == ["https://github.com/apache/spark"]
    assert tabs[5].aliases == ["http://news.example.org:80/b;v=1/", "https://news.example.org/a?a=1&b=2&fbclid=zz"]
    assert {(r.source, r.target, r.weight, r.reason) for r in g.edges.collect()} == {(0, 2, 0.375, "similarity+domain"), (0, 4, 0.429, "similarity")}
    assert {(r.id, r.label, tuple(r.tab_ids)) for r in g.groups.collect()} == {(0, "github.com", (0, 1, 2, 4)), (1, "newtab", (3,)), (2, "news.example.org", (5, 6, 7)), (3, "cooking.example.com", (8,))}


def test_worked_example_without_domains_and_adjacency(spark):
    g = worked(spark, Options(domain_group=False, group_threshold=0.5))
    assert sorted(tuple(r.tab_ids) for r in g.groups.collect()) == [(0, 1), (2,), (3,), (4,), (5, 6, 7), (8,)]
    ranked = adjacency(g.edges, tab_groups_of(g.groups, g.tabs)).where("group_id = 0").orderBy("rank").collect()
    assert [(r.neighbor_id, r.weight) for r in ranked] == [(3, 0.429), (1, 0.375)]


def test_worked_searches(spark):
    g = worked(spark)
    meta = group_meta(g.groups, g.tabs).cache()
    found = lambda q: [(r.group_id, round(r.score, 4)) for r in ordered_results(search_groups(meta, q)).collect()]
    assert found("#spark") == [(0, 1.0)]
    assert found("@news") == [(2, 1.0)]
    assert found("pasta") == [(3, 1.0), (0, 0.5455), (1, 0.5)]
    assert found("sprak engine") == [(0, 0.9)]
    assert found("#spark #flink @github") == [(0, 1.0)]
    assert found("recipes") == [(3, 0.9231), (0, 0.4706)]
    assert found("zzzz") == []


def test_query_languages():
    assert parse_query(" #Spark @a.com x  y") == {"tags": ["spark"], "domains": ["a.com"], "terms": ["x", "y"]}
    assert parse_panel_query("#c++ @github.com spark") == ("c", "github", "++ .com spark")


@pytest.mark.parametrize("task_links", [250_000, 60])
def test_components_are_an_equivalence(spark, task_links):
    random.seed(5)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(None, 3), (4, None), (7, 7)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b", task_links).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_similarity_join_finds_all_pairs(spark):
    random.seed(9)
    rows = [(i, random.choice(["a", "b", "", None]), [random.choice("uvwxyz") * 2 for _ in range(random.randrange(0, 5))] or None) for i in range(60)]
    tabs = spark.createDataFrame(rows, "id long, domain string, keywords array<string>")
    want = {}
    for i, d, k in rows:
        for j, e, m in rows:
            if i < j:
                a, b = set(k or []), set(m or [])
                score = (len(a & b) / len(a | b) if a and b else 0.0) + (0.25 if d and d == e else 0)
                if score >= 0.2:
                    want[i, j] = (round(score, 3), "similarity+domain" if (d or "") == (e or "") else "similarity")
    got = {(r.source, r.target): (r.weight, r.reason) for r in similarity.similarity_edges(tabs).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[p][0] - want[p][0]) < 0.0011 and got[p][1] == want[p][1] for p in want)
    neighbors = similarity.nearest(tabs, k=3)
    assert neighbors.groupBy("a").count().agg(F.max("count")).first()[0] <= 3
    pairs = {(r.a, r.b) for r in neighbors.collect()}
    assert {(r.a, r.b) for r in similarity.mutual(neighbors).collect()} == {(a, b) for a, b in pairs if a < b and (b, a) in pairs}


def test_banded_near_duplicates_equal_a_scan(spark):
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(20)]
    rows = []
    for i in range(200):
        h = random.choice(base)
        for _ in range(random.randrange(5)):
            h ^= 1 << random.randrange(64)
        rows.append((i, random.choice(["a", "b", None, ""]), h - 2**64 if h >= 2**63 else h))
    rows.append((300, "a", None))
    got = {(r.id_a, r.id_b): r.distance for r in dedupe.near_duplicate_pairs(spark.createDataFrame(rows, "id long, domain string, simhash long")).collect()}
    want = {(i, j): bin((x ^ y) & (2**64 - 1)).count("1") for i, d, x in rows for j, e, y in rows if i < j and d and d == e and x is not None and y is not None and bin((x ^ y) & (2**64 - 1)).count("1") <= 3}
    assert got == want


def test_empty_tables(spark):
    tabs = spark.createDataFrame([], "id long, url string, title string, domain string, canonical_url string, keywords array<string>, tokens array<string>, simhash long, embedding array<double>")
    g = pipeline.build(tabs, BATCH)
    assert g.groups.count() == 0 and g.edges.count() == 0 and g.tabs.count() == 0
    assert pipeline.build(tabs, LIVE).groups.count() == 0


def test_live_groups_hold_primaries_only(spark):
    rows = [(0, "https://a.com/x", "t", "a.com", "https://a.com/x", ["k1", "k2"], [], 5, None), (1, "https://a.com/x?utm_a=1", "t", "a.com", "https://a.com/x", ["k1", "k2"], [], 5, None), (2, "https://b.com", "u", "b.com", "https://b.com/", ["k9"], [], 9, None)]
    tabs = spark.createDataFrame(rows, "id long, url string, title string, domain string, canonical_url string, keywords array<string>, tokens array<string>, simhash long, embedding array<double>")
    assert sorted(tuple(r.tab_ids) for r in pipeline.build(tabs, LIVE).groups.collect()) == [(0,), (2,)]
    assert sorted(tuple(r.tab_ids) for r in pipeline.build(tabs, BATCH).groups.collect()) == [(0, 1), (2,)]


def test_numbering_is_dense(spark):
    roots = spark.createDataFrame([(x, x) for x in (5, 900, 7, 10**12, 11)], "id long, root long")
    assert {r.root: r.group_id for r in grouping.numbered(roots).collect()} == {5: 0, 7: 1, 11: 2, 900: 3, 10**12: 4}


def test_a_build_writes_its_rows_once_and_compact(spark):
    rows = [(i, f"http://s{i % 40}.test/p{i}", f"page {i}", f"s{i % 40}.test", "", [f"k{i % 30}"], [f"k{i % 30}", "page"], i * 7919, [float((i * j) % 11) for j in range(64)]) for i in range(600)]
    tabs = spark.createDataFrame(rows, "id long, url string, title string, domain string, canonical_url string, keywords array<string>, tokens array<string>, simhash long, embedding array<double>")
    similarity.nearest(tabs.limit(1))  # there is a folder
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.iterdir())
    assert pipeline.build(tabs).groups.count() > 0
    new = set(folder.iterdir()) - before
    assert not [p for p in new if p.name.startswith("blocks-")]  # nobody asked for edges
    assert sum(f.stat().st_size for p in new if p.name.startswith("rdd-") for f in p.rglob("part-*")) < 600 * 64 * 8  # and no checkpoint holds the embeddings
