import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import navigation, store
from pagelattice.sources import lz4, readers
from pagelattice.streaming.navigation import navigation_stream, read_version, step, upsert_pages
from pagelattice.streaming.runner import run_once

EVENTS = "event string, tab_id long, ts timestamp, url string, title string, frame_id int, transition_type string, qualifiers array<string>, status string, received_at timestamp"


def events(spark, rows):
    t0 = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(e, tab, t0 + dt.timedelta(hours=h), u, None, 0 if e == "committed" else None, "link" if e == "committed" else None, [], None, t0) for h, e, tab, u in rows], EVENTS)


U = {x: f"https://h.com/{x}" for x in "abcdefgh"}


def test_first_visits_and_sessions(spark):
    rows = [(i, "committed", 1, U[x]) for i, x in enumerate("abacd")] + [(100, "removed", 1, None), (130, "committed", 1, U["a"]), (160, "committed", 1, U["b"])]
    got = [(r.source_url[-1], r.target_url[-1], r.session) for r in navigation.first_visits(events(spark, rows + rows[:2])).orderBy("ts").collect()]
    assert got == [("a", "b", 0), ("a", "c", 0), ("c", "d", 0), ("a", "b", 1)]


def test_stream_equals_batch(spark, tmp_path):
    random.seed(4)
    rows = [(h, random.choice(["committed", "updated", "committed", "removed"]), random.randrange(4), U[random.choice("abcdefgh")]) for h in range(160)]
    rows = [(h, e, t, None if e == "removed" else u) for h, e, t, u in rows]
    df = events(spark, rows)
    df.unionByName(df.limit(20)).coalesce(1).write.parquet(str(tmp_path / "events"))
    streamed = run_once(spark, str(tmp_path / "events"), df.schema, lambda s: navigation_stream(s, "90 days"), "test", 120)
    key = lambda d: sorted((r.tab_id, r.source_url, r.target_url, r.ts, r.transition_type) for r in d.collect())
    assert key(streamed) == key(navigation.first_visits(df)) and streamed.count() > 10


def test_late_events_only_mark_visits():
    s = {"visited": set(), "last": None, "seen": 0}
    assert step(s, "committed", "a", "link", 10) is None and step(s, "committed", "b", "typed", 20) == ("a", "b", "typed")
    assert step(s, "committed", "z", "link", 5) is None and s["last"] == "b" and "z" in s["visited"]
    assert step(s, "removed", None, None, 30) is None and s["visited"] == set()


def test_edge_merge(spark):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    rows = [(1, 2, 0.4, "similarity", None), (3, 4, 0.5, "similarity", None), (1, 2, 1.0, "navigation", t(1)), (2, 1, 1.0, "navigation", t(2)), (4, 3, 1.0, "navigation", t(3)), (5, 6, 1.0, "navigation", t(4)), (6, 5, 1.0, "navigation", t(5)), (None, 1, 1.0, "navigation", t(1)), (8, 8, 1.0, "similarity", None)]
    df = spark.createDataFrame(rows, "source long, target long, weight double, reason string, ts timestamp")
    pick = lambda d: {(r.source, r.target, r.reason) for r in d.collect()}
    assert pick(navigation.merge_edges(df)) == {(1, 2, "navigation"), (4, 3, "navigation"), (5, 6, "navigation")}
    assert pick(navigation.merge_edges(df, strict_live=True)) == {(1, 2, "navigation"), (4, 3, "navigation"), (5, 6, "navigation"), (3, 4, "similarity")}


def test_cache_overlay(spark):
    schema = "id long, url string, title string, summary string, summary_source string, text_excerpt string, keywords array<string>, canonical_url string, simhash long, embedding array<double>"
    cache = store.cache_from(spark.createDataFrame([(0, "https://a.com/?utm_x=1", "t", "s", "llm", "e", ["k"], None, 7, [1.0])], schema))
    fresh = spark.createDataFrame([(1, "https://a.com", "t"), (2, "https://b.com", "t")], "id long, url string, title string")
    got = {r.id: r for r in store.overlay_cache(fresh, cache, "nomic-embed-text").collect()}
    assert got[1].cached and got[1].summary == "s" and got[1].embedding == [1.0] and got[1].simhash == 7
    assert not got[2].cached and got[2].summary is None
    assert {r.id: r.embedding for r in store.overlay_cache(fresh, cache, "other").collect()}[1] is None


def test_run_fill_and_upserts(spark):
    rows = spark.createDataFrame([(0, "u", None), (1, "u", 5), (2, "u", 6), (3, "v", None), (4, None, 9)], "id long, c string, h long")
    assert {r.id: r.value for r in store.fill_within_run(rows, "c", "h").collect()} == {0: None, 1: 5, 2: 5, 3: None, 4: None}
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string")
    once = store.upsert(table, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, store.upsert(once, new, ["id"]).collect()))
    assert sorted(r.id for r in store.delete(once, new).collect()) == [1]


def test_versioned_upsert(spark, tmp_path):
    path = str(tmp_path / "pages")
    write = upsert_pages(path)
    t = dt.datetime(2025, 1, 1)
    rows = lambda *x: spark.createDataFrame([(u, v, t + dt.timedelta(hours=h)) for u, v, h in x], "canonical_url string, title string, ts timestamp")
    assert read_version(spark, path) is None
    write(rows(("a", "1", 0), ("a", "2", 1), ("b", "1", 0)), 0)
    write(rows(("b", "2", 2), ("c", "1", 2)), 1)
    assert sorted((r.canonical_url, r.title) for r in read_version(spark, path).collect()) == [("a", "2"), ("b", "2"), ("c", "1")]


def test_lz4_round_trip_and_matches():
    text = json.dumps({"windows": []}) + "é" * 400
    assert lz4.decode_session(lz4.encode_literal(text)) == text
    block = bytes([0x14, ord("a"), 1, 0, 0x10, ord("b")])  # 'a', then eight copies from offset one, then 'b'
    assert lz4.decode_block(block, 10) == b"a" * 9 + b"b"
    for bad in (b"", b"\x10", bytes([0x04, 9, 0])):
        with pytest.raises(ValueError):
            lz4.decode_block(bad, 5)
    with pytest.raises(ValueError):
        lz4.decode_session(b"nope")


def test_session_files(spark, tmp_path):
    doc = {"windows": [{"tabs": [{"index": 2, "entries": [{"url": "https://a.com", "title": "A"}, {"url": "https://b.com", "title": None}]}, {"index": 9, "entries": [{"url": "https://c.com"}]}, {"entries": [{"url": "https://d.com", "title": "D"}]}]}, {"tabs": []}]}
    folder = tmp_path / "p1" / "sessionstore-backups"
    folder.mkdir(parents=True)
    (folder / "recovery.jsonlz4").write_bytes(lz4.encode_literal(json.dumps(doc)))
    (tmp_path / "p2").mkdir()
    (tmp_path / "p2" / "sessionstore.jsonlz4").write_bytes(b"broken")
    files = readers.session_files(spark, str(tmp_path))
    assert files.count() == 2
    got = readers.read_sessions(files).collect()
    assert sorted([(t.title, t.url) for r in got if r.tabs for t in r.tabs]) == [("", "https://b.com"), ("D", "https://d.com")]
    assert [r.error for r in got if r.error] == ["not a session file"]


def test_graph_document_round_trip(spark, tmp_path):
    tabs = spark.createDataFrame([(0, "https://a.com", "é", -5, ["k"], None, 0), (1, "https://b.com", "b", 7, None, 0, 0)], "id long, url string, title string, simhash long, keywords array<string>, duplicate_of long, group_id long")
    tabs = tabs.withColumn("domain", F.lit("a.com")).withColumn("error", F.lit(None).cast("string")).withColumn("embedding_error", F.lit(None).cast("string"))
    groups = spark.createDataFrame([(0, "a.com", [0, 1], 2)], "id long, label string, tab_ids array<long>, size int")
    edges = spark.createDataFrame([(0, 1, 0.5, "similarity")], "source long, target long, weight double, reason string")
    readers.write_graph(tabs, groups, edges, str(tmp_path / "g.json"), "2025-01-01T00:00:00Z")
    assert "é" in (tmp_path / "g.json").read_text(encoding="utf-8")
    t, g, e = readers.read_graph(spark, str(tmp_path / "g.json"))
    assert {r.id: r.simhash for r in t.collect()} == {0: -5, 1: 7} and g.first().tab_ids == [0, 1] and e.first().weight == 0.5


def test_export_positions_and_import(spark):
    tabs = spark.createDataFrame([(10, 0), (20, 0), (35, -1)], "id long, group_id long").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("canonical_url", "string"), ("title", "string"), ("domain", "string"), ("keywords", "array<string>"))])
    edges = spark.createDataFrame([(10, 35, 0.5, "similarity"), (10, 99, 0.5, "similarity"), (10, 35, 0.5, "similarity")], "source long, target long, weight double, reason string")
    assert {(r.source, r.target) for r in store.reindex_export(tabs, edges).collect()} == {(0, 2)}
    t, _, e = store.rekey_import(tabs, spark.createDataFrame([(0, "x", [10])], "id long, label string, tab_ids array<long>"), edges)
    assert {r.group_id for r in t.collect()} == {"import_0", None} and e.count() == 2


def test_fetch_and_join(spark):
    tabs = spark.createDataFrame([(0, "https://a.com"), (1, "ftp://x"), (2, "https://bad.com"), (3, "https://a.com")], "id long, url string")

    def fetch(url):
        if "bad" in url:
            raise OSError("timeout")
        return f"<p>{url}</p>"

    got = {r.url: (r.html, r.error) for r in readers.fetch_pages(tabs, fetch, 2).collect()}
    assert got == {"https://a.com": ("<p>https://a.com</p>", None), "https://bad.com": (None, "fetch_failed: timeout")}
    pages = spark.createDataFrame([("https://a.com", "<p>")], "url string, html string")
    assert {r.id: r.error for r in readers.join_pages(tabs, pages).collect()} == {0: None, 1: "unsupported_url", 2: "fetch_failed: not stored", 3: None}
