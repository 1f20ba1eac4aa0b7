import datetime as dt
import sys
import types

import pytest
from pyspark.sql import functions as F

from pagelattice import __main__ as cli
from pagelattice.functions import html
from pagelattice.operators import navigation, search, store
from pagelattice.sources import readers, writers
from pagelattice.streaming import navigation as live

PAGES = "canonical_url string, url string, title string, text string, keywords array<string>, simhash long, browser_tab long, ts timestamp"


def at(minute):
    return dt.datetime(2025, 1, 1, 0, minute)


def test_pages_take_the_browser_tab_and_contents_enrich_them(spark, tmp_path):
    path = str(tmp_path / "pages")
    row = lambda u, tab, m: (f"https://{u}.test/", f"https://{u}.test/", u, None, None, None, tab, at(m))
    put = live.upsert_pages(path)
    put(spark.createDataFrame([row("a", 1, 1), row("b", 2, 2)], PAGES), 1)
    put(spark.createDataFrame([row("c", 1, 3)], PAGES), 2)
    shown = {r.title: r.browser_tab for r in live.read_version(spark, path).collect()}
    assert shown == {"a": None, "b": 2, "c": 1}
    content = [(1, "Kilns", "Kilns firing porcelain, porcelain glazes " * 300, None, at(4)), (9, "nobody", "x", None, at(4)), (2, "", None, "https://B.test/?utm_source=x", at(4))]
    arrive = live.enrich_pages(path)
    batch = spark.createDataFrame(content, "browser_tab long, title string, text string, canonical_url string, ts timestamp")
    arrive(batch, 3)
    rows = {r.browser_tab: r for r in live.read_version(spark, path).where("browser_tab is not null").collect()}
    assert rows[1].title == "Kilns" and len(rows[1].text) == 5000 and rows[1].keywords[0] == "porcelain" and rows[1].simhash is not None
    assert rows[2].title == "b" and rows[2].canonical_url == "https://b.test/" and rows[2].text == "" and live.read_version(spark, path).count() == 3


def test_left_addresses_open_sessions(spark):
    step = lambda s, *e: live.step(s, *e)
    s = {"visited": set(), "last": None, "seen": 0}
    assert step(s, "before_navigate", "a", None, 1) is None and step(s, "committed", "b", "link", 2) == ("a", "b", "link")
    assert step(s, "before_navigate", "z", None, 3) is None and s["last"] == "b" and "z" not in s["visited"]
    schema = "event string, tab_id long, ts timestamp, url string, title string, frame_id int, transition_type string, qualifiers array<string>, status string, received_at timestamp"
    rows = [("before_navigate", 1, at(1), "https://a.test/", None, 0, None, [], None, at(1)), ("committed", 1, at(2), "https://b.test/", None, 0, "link", [], None, at(2)), ("before_navigate", 1, at(3), "https://c.test/", None, 0, None, [], None, at(3)), ("committed", 1, at(4), "https://d.test/", None, 0, "link", [], None, at(4))]
    df = spark.createDataFrame(rows, schema)
    moved = lambda seed: [(r.source_url[8], r.target_url[8]) for r in navigation.first_visits(df, seed=seed).orderBy("ts").collect()]
    assert moved(True) == [("a", "b"), ("b", "d")] and moved(False) == [("b", "d")]


def test_open_tabs_and_failing_sources(spark):
    tabs = spark.createDataFrame([(1, "https://www.a.test/x?utm_a=1", "A"), (2, "https://a.test/x", "A2"), (3, "chrome://newtab", "n")], "tab_id long, url string, title string")
    assert [(r.canonical_url, r.title, r.browser_tab) for r in readers.open_tabs(tabs).collect()] == [("https://a.test/x", "A2", 2)]
    found, errors = readers.read_some([lambda: tabs, lambda: 1 / 0])
    assert len(found) == 1 and errors == ["division by zero"]


@pytest.mark.parametrize(("kind", "yes"), [("text/html; charset=utf-8", True), ("application/xhtml+xml", True), ("application/pdf", False), (None, False)])
def test_content_types(kind, yes):
    assert readers.is_html(kind) is yes


def test_second_choices_of_sites():
    page = '<meta property="og:title" content="T"><div id="channel-name"><a>Kiln TV</a></div><div id="description-inline-expander">A much longer description of it</div><meta property="og:description" content="short">'
    assert html.page_content(page, "https://www.youtube.com/watch?v=1")["text"] == "T | Channel: Kiln TV | A much longer description of it"
    assert "A repo" in html.page_content('<title>R</title><p class="f4 my-3">A repo</p>', "https://github.com/a/b")["text"]


def test_ids_exports_and_panel_order(spark):
    ids = spark.createDataFrame([("https://a.test/",), ("https://b.test/",), ("https://a.test/",)], "u string").select(store.page_id(F.col("u")).alias("i"))
    assert ids.distinct().count() == 2 and ids.first().i.startswith("tab_")
    tabs = spark.createDataFrame([(10, "https://a.test/", "A", "a.test", "https://a.test/", ["k"], 5, "g12"), (20, "https://b.test/", "B", "b.test", None, None, None, "none")], "id long, url string, title string, domain string, canonical_url string, keywords array<string>, simhash long, group_id string")
    groups = spark.createDataFrame([(7, "x", [20, 99, 10])], "id long, label string, tab_ids array<long>")
    edges = spark.createDataFrame([(10, 20, 0.5, "similarity"), (10, 99, 0.5, "similarity")], "source long, target long, weight double, reason string")
    t, g, e = store.export_tables(tabs, groups, edges)
    assert sorted((r.id, r.group_id) for r in t.collect()) == [(0, 12), (1, None)] and [tuple(r.tab_ids) for r in g.collect()] == [(1, 0)] and [(r.source, r.target) for r in e.collect()] == [(0, 1)]
    found = spark.createDataFrame([(1, 2), (3, 9), (2, 9)], "group_id long, size int")
    assert [r.group_id for r in search.panel_order(found).collect()] == [2, 3, 1]


def test_one_pointer_for_the_graph(spark, tmp_path):
    graph = types.SimpleNamespace(**{n: spark.range(k) for k, n in enumerate(writers.TABLES)})
    assert writers.read_graph_tables(spark, str(tmp_path)) is None
    assert writers.replace_graph(graph, str(tmp_path)) == 1 and writers.replace_graph(graph, str(tmp_path)) == 2
    assert {n: t.count() for n, t in writers.read_graph_tables(spark, str(tmp_path)).items()} == {"tabs": 0, "groups": 1, "edges": 2}


def test_build_with_pages_cache_and_models(spark, tmp_path, monkeypatch):
    models = types.ModuleType("some_models")
    models.summarizer = lambda: lambda prompt: "A summary on kilns."
    models.embedder = lambda: lambda texts: [[1.0, float(len(t) % 3)] for t in texts]
    monkeypatch.setitem(sys.modules, "some_models", models)
    (tmp_path / "w.json").write_text('[{"browser": "chrome", "windowId": 1, "tabs": [{"title": "Kiln", "url": "https://a.test/k"}, {"title": "Fern", "url": "https://b.test/f"}, {"title": "n", "url": "chrome://x"}]}]')
    spark.createDataFrame([("https://a.test/k", "Kilns are hot. They glow."), ("https://b.test/f", "Ferns grow. Slowly.")], "url string, text string").write.parquet(str(tmp_path / "pages"))
    assert cli._named("some_models:embedder") is models.embedder and cli._named(None) is None
    from pagelattice.options import Options
    from pagelattice.plans.pipeline import build_batch

    tabs = readers.flatten_windows(readers.read_windows(spark, str(tmp_path / "w.json")))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    options = Options(store_embeddings=True)
    g = build_batch(tabs, pages, options)
    first = {r.id: r for r in g.tabs.collect()}
    assert first[0].summary == "Kilns are hot. They glow." and first[2].error == "unsupported_url"
    cache = store.cache_from(g.tabs.where("error is null").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5))))
    again = {r.id: r for r in build_batch(tabs, None, options, cache=cache).tabs.collect()}
    assert again[0].summary == first[0].summary and again[0].keywords == first[0].keywords and again[0].simhash == first[0].simhash and again[1].embedding == [1.0, 0.5] and again[2].error == "unsupported_url"
    fresh = {r.id: r for r in build_batch(tabs, None, Options(refresh=True), cache=cache).tabs.collect()}
    assert fresh[0].summary == ""


def test_large_graphs_are_written_by_the_executors(spark, tmp_path):
    tabs = spark.createDataFrame([(i, f"https://a.test/{i}", None, 5, None, None, "a.test") for i in range(30)], "id long, url string, error string, simhash long, embedding_error string, duplicate_of long, domain string")
    groups = spark.createDataFrame([(0, "x", [1, 2], 2)], "id long, label string, tab_ids array<long>, size int")
    edges = spark.createDataFrame([(1, 2, 0.5, "similarity")], "source long, target long, weight double, reason string")
    small = readers.write_graph(tabs, groups, edges, str(tmp_path / "g.json"), "now")
    large = readers.write_graph(tabs, groups, edges, str(tmp_path / "h.json"), "now", max_rows=10)
    assert small.endswith("g.json") and large.endswith("h.json.d")
    assert spark.read.json(f"{large}/tabs").count() == 30 and spark.read.json(f"{large}/edges").first().target == 2
