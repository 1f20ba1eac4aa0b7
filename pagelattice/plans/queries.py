"""Queries of the engine's own operators, each over its whole tables. All results are plain columns; arrays are joined by blanks or commas."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import dedupe, graph_views, grouping, navigation, search, similarity, store
from ..options import BATCH, LIVE

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(c, by: str = " "):
    return F.array_join(c, by)


# ---- addresses


@query
def url_canonical(spark, d):
    return _t(spark, d, "tabs").select("id", urls.canonical_url(F.col("url")).alias("canonical"))


@query
def url_canonical_live(spark, d):
    return _t(spark, d, "tabs").select("id", urls.canonical_url(F.col("url"), "live").alias("canonical"))


@query
def url_domain(spark, d):
    return _t(spark, d, "tabs").select("id", urls.domain(F.col("url")).alias("domain"), urls.domain(F.col("url"), "live").alias("live_domain"))


@query
def http_filter(spark, d):
    return _t(spark, d, "tabs").where(urls.is_http(F.col("url")) & (F.length(F.trim("url")) > 0)).select("id", "url", urls.favicon_url(F.col("url")).alias("favicon"))


# ---- texts


@query
def tokenize(spark, d):
    return _t(spark, d, "documents").select("doc_id", _joined(text.tokens(F.col("text"))).alias("tokens"))


@query
def tokenize_live(spark, d):
    return _t(spark, d, "documents").select("doc_id", _joined(text.tokens(F.col("text"), "live")).alias("tokens"))


def _doc_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


@query
def term_frequency(spark, d):
    return text.term_frequencies(_doc_tokens(spark, d), "doc_id", "tokens").select("id", "term", "tf", "first_pos")


@query
def doc_keywords(spark, d):
    return text.keywords(_doc_tokens(spark, d), "doc_id", "tokens", 8).select(F.col("id").alias("doc_id"), _joined("keywords").alias("keywords"))


@query
def simhash(spark, d):
    return text.simhash(_doc_tokens(spark, d), "doc_id", "tokens").select(F.col("id").alias("doc_id"), "simhash")


@query
def simhash_live(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", text.tokens(F.col("text"), "live").alias("tokens"))
    return text.simhash(rows, "doc_id", "tokens", "live").select(F.col("id").alias("doc_id"), "simhash")


@query
def fallback_summary(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.fallback_summary(F.col("text")).alias("summary"))


@query
def truncate_words(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", text.truncate_words(F.col("text"), 600).alias("clipped"))


@query
def strip_tags(spark, d):
    html = F.concat(F.lit("<p class='x'>"), F.coalesce("title", F.lit("")), F.lit("</p>\n <b>"), F.coalesce("summary", F.lit("")), F.lit("</b>"))
    return _t(spark, d, "tabs").where("error is null").select("id", text.strip_tags(html).alias("stripped"))


@query
def summary_prompt(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.prompt(F.col("title"), F.col("text")).alias("prompt"))


@query
def embedding_text(spark, d):
    return _t(spark, d, "tabs").select("id", text.embedding_text(F.col("title"), F.col("summary"), F.col("domain"), F.col("text_excerpt")).alias("text"))


@query
def fuzzy_words(spark, d):
    return _t(spark, d, "tabs").select("id", text.fuzzy_words("stale trigger ideas", F.col("title")).alias("score"))


@query
def idf(spark, d):
    return grouping.idf(_doc_tokens(spark, d)).select("term", "df", F.round("idf", 9).alias("idf"))


@query
def enrich(spark, d):
    """The enrichment stage over whole texts: the documents stand for the stored texts of the pages."""
    from . import pipeline

    pages = _t(spark, d, "documents").where("url is not null").select("url", "text")
    tabs = _t(spark, d, "tabs").where("id is not null").select("id", "url", "title", "domain")
    return pipeline.enrich(tabs, BATCH, pages).select("id", "summary", "summary_source", "text_excerpt", "error", _joined("keywords").alias("keywords"), "simhash")


@query
def export_groups(spark, d):
    _, groups, _ = store.export_tables(_t(spark, d, "tabs").where("duplicate_of is null"), _t(spark, d, "tab_groups"), _t(spark, d, "edges"))
    return groups.select("id", "label", _joined(F.col("tab_ids").cast("array<string>"), ",").alias("tab_ids"))


@query
def page_ids(spark, d):
    page = urls.canonical_url(F.col("url"), "live")
    return _t(spark, d, "tabs").where(urls.is_http(F.col("url"))).select(page.alias("p"), store.page_id(page).alias("i")).agg(F.count_distinct("p").alias("pages"), F.count_distinct("i").alias("ids"))


@query
def escaped_titles(spark, d):
    return _t(spark, d, "tabs").where("title is not null").select("id", graph_views.escape_html(F.col("title")).alias("shown"))


@query
def enrich_columns(spark, d):
    rows = _t(spark, d, "tabs").where("id is not null")
    whole = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("text_excerpt", F.lit("")))
    return rows.select("id", F.substring(F.coalesce("text_excerpt", F.lit("")), 1, 100).alias("excerpt"), F.size(text.tokens(whole)).alias("n_tokens"), F.when(~urls.is_http(F.col("url")), "unsupported_url").alias("error_found"))


# ---- duplicates


def _canonical_tabs(spark, d):
    return dedupe.with_canonical(_t(spark, d, "tabs").select("id", "url", "title", "domain", "canonical_url", "keywords", "simhash", "tokens", "group_id"))


@query
def canonical_duplicates(spark, d):
    return dedupe.canonical_links(_canonical_tabs(spark, d)).select(F.col("a").alias("first_id"), F.col("b").alias("id"))


@query
def near_dup_pairs(spark, d):
    return dedupe.near_duplicate_pairs(_canonical_tabs(spark, d), 3)


@query
def dedupe_primary(spark, d):
    return dedupe.dedupe(_canonical_tabs(spark, d), 3)


@query
def dedupe_aliases(spark, d):
    rows = _canonical_tabs(spark, d)
    return dedupe.aliases(rows, dedupe.dedupe(rows, 3)).select("primary", "duplicates", _joined("aliases", "\n").alias("aliases"))


# ---- similarity and groups


def _primaries(spark, d):
    from ..checkpoints import checkpoint

    rows = _canonical_tabs(spark, d)
    return checkpoint(rows.join(dedupe.dedupe(rows, 3).where("id = primary").select("id"), "id"))


@query
def jaccard_pairs(spark, d):
    return similarity.jaccard_pairs(_t(spark, d, "tabs"), 0.5).select("a", "b", "shared", F.round("jaccard", 9).alias("jaccard"))


@query
def similarity_edges(spark, d):
    return similarity.similarity_edges(_t(spark, d, "tabs").where("duplicate_of is null"))


@query
def similarity_edges_compact(spark, d):
    return similarity.similarity_edges(_t(spark, d, "tabs").where("duplicate_of is null"), every_pair=False)


@query
def domain_cliques(spark, d):
    return similarity.domain_cliques(_t(spark, d, "tabs").where("duplicate_of is null"))


@query
def knn_neighbors(spark, d):
    return similarity.nearest(_t(spark, d, "tabs").where("duplicate_of is null")).select("a", "b", F.round("score", 9).alias("score"), "rank")


@query
def mutual_knn(spark, d):
    return similarity.mutual(similarity.nearest(_t(spark, d, "tabs").where("duplicate_of is null")))


@query
def cosine_topk(spark, d):
    return similarity.cosine_neighbors(_t(spark, d, "embeddings"), "vec_id", "embedding", 6).select("a", "b", F.round("cosine", 6).alias("cosine"), "rank")


@query
def cosine_index_recall(spark, d):
    """What the index of pivots finds of the exact neighbours of the tabs whose id is divisible by 20, against all tabs."""
    vectors = similarity.unit_vectors(_t(spark, d, "tabs"))
    return similarity.candidate_recall(vectors, 6, cells=64, probes=6)


@query
def domain_counts(spark, d):
    return grouping.domain_counts(_t(spark, d, "tabs"), 2)


@query
def groups(spark, d):
    assigned = grouping.assign_groups(_t(spark, d, "tabs").where("duplicate_of is null"))
    return assigned.join(grouping.numbered(assigned), "root").select("id", "group_id")


@query
def groups_without_domains(spark, d):
    from dataclasses import replace

    assigned = grouping.assign_groups(_t(spark, d, "tabs").where("duplicate_of is null"), replace(BATCH, domain_group=False, group_threshold=0.5))
    return assigned.join(grouping.numbered(assigned), "root").select("id", "group_id")


def _own_groups(spark, d):
    tabs = _t(spark, d, "tabs").where("id is not null and group_id >= 0")
    return tabs.select("group_id", "id", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


@query
def domain_share(spark, d):
    return grouping.domain_shares(_own_groups(spark, d)).select("group_id", "domain", F.round("share", 9).alias("share"))


@query
def tfidf_top3(spark, d):
    rows = _own_groups(spark, d)
    return grouping.top_terms(rows.select("group_id", "id", F.posexplode("tokens").alias("pos", "term")), grouping.idf(rows)).select("group_id", _joined("terms", " / ").alias("terms"))


@query
def group_labels(spark, d):
    rows = _own_groups(spark, d)
    return grouping.labels(rows.select("group_id", "id", "domain"), rows.select("group_id", "id", F.posexplode("tokens").alias("pos", "term")), grouping.idf(rows))


@query
def graph_build(spark, d):
    from . import pipeline

    g = pipeline.build(_t(spark, d, "tabs").select("id", "url", "title", "domain", "canonical_url", "keywords", "tokens", "simhash", "embedding"), BATCH)
    return g.groups.select("id", "label", "size", F.array_join("tab_ids", ",").alias("members"))


@query
def graph_rebuild_live(spark, d):
    from . import pipeline

    moves = navigation.first_visits(_t(spark, d, "browser_events"))
    g = pipeline.rebuild_live(_t(spark, d, "tabs").select("id", "url", "title", "domain", "canonical_url", "keywords", "tokens", "simhash", "embedding"), moves, LIVE)
    return g.edges.select("source", "target", "weight", "reason")


# ---- views over the stored graph


def _of_tab(spark, d):
    return graph_views.tab_groups_of(_t(spark, d, "tab_groups"), _t(spark, d, "tabs"))


@query
def group_adjacency(spark, d):
    return graph_views.adjacency(_t(spark, d, "edges"), _of_tab(spark, d)).select("group_id", "neighbor_id", F.round("weight", 6).alias("weight"), "rank")


@query
def mini_map(spark, d):
    return graph_views.mini_map(graph_views.adjacency(_t(spark, d, "edges"), _of_tab(spark, d)))


def _meta(spark, d):
    return graph_views.group_meta(_t(spark, d, "tab_groups"), _t(spark, d, "tabs"))


@query
def group_meta(spark, d):
    return _meta(spark, d).select("group_id", "size", "domain", _joined("keywords", ",").alias("keywords"), "blob")


@query
def group_details(spark, d):
    return graph_views.group_details(_meta(spark, d), graph_views.adjacency(_t(spark, d, "edges"), _of_tab(spark, d)))


@query
def group_list(spark, d):
    return graph_views.group_list(_t(spark, d, "tab_groups"))


@query
def group_members(spark, d):
    return graph_views.group_members(_t(spark, d, "tab_groups"), _t(spark, d, "tabs"))


@query
def group_urls(spark, d):
    return store.group_urls(_t(spark, d, "tab_groups"), _t(spark, d, "tabs"), browser="firefox")


@query
def tab_details(spark, d):
    return graph_views.tab_details(_t(spark, d, "tabs"), _t(spark, d, "tab_groups"))


@query
def render_nodes(spark, d):
    return graph_views.render_nodes(_t(spark, d, "tabs"))


@query
def visible_edges(spark, d):
    return graph_views.visible_edges(_t(spark, d, "edges"), _t(spark, d, "tabs").where("duplicate_of is null"))


@query
def graph_stats(spark, d):
    return graph_views.graph_stats(_t(spark, d, "tabs"), _t(spark, d, "tab_groups"), _t(spark, d, "edges"))


# ---- searches


@query
def search_words(spark, d):
    return search.search_groups(_meta(spark, d), "copperfen ideas").select("group_id", "size", "score")


@query
def search_tags_domains(spark, d):
    return search.search_groups(_meta(spark, d), "#guide #re @example @fen").select("group_id", "size", "score")


@query
def search_fuzzy(spark, d):
    return search.search_groups(_meta(spark, d), "glazw kilm").select("group_id", "size", F.round("score", 9).alias("score"))


@query
def search_panel_groups(spark, d):
    return search.search_panel_groups(_t(spark, d, "tab_groups"), _t(spark, d, "tabs"), "#guide @example the")


@query
def search_panel_tabs(spark, d):
    return search.search_panel_tabs(_t(spark, d, "tabs"), "#review @test review")


# ---- navigation


@query
def nav_first_visits(spark, d):
    return navigation.first_visits(_t(spark, d, "browser_events")).withColumn("ts", F.unix_micros("ts"))


@query
def nav_seeded(spark, d):
    """First visits where the address that a tab leaves opens its session."""
    return navigation.first_visits(_t(spark, d, "browser_events"), seed=True).withColumn("ts", F.unix_micros("ts"))


@query
def nav_edges(spark, d):
    return navigation.navigation_edges(navigation.first_visits(_t(spark, d, "browser_events")), _t(spark, d, "tabs")).withColumn("ts", F.unix_micros("ts"))


@query
def edge_merge(spark, d):
    return navigation.merge_edges(_t(spark, d, "edges")).select("source", "target", "weight", "reason")


@query
def nav_stream(spark, d):
    """The streaming operator over the events as one bounded stream, read back from its sink (file source, available now)."""
    from ..streaming.navigation import navigation_stream
    from ..streaming.runner import run_once

    schema = _t(spark, d, "browser_events").schema
    found = run_once(spark, f"{d}/browser_events.parquet", schema, lambda events: navigation_stream(events, watermark="60 days"), "nav_stream")
    return found.withColumn("ts", F.unix_micros("ts"))


# ---- stores


@query
def cache_overlay(spark, d):
    tabs = _t(spark, d, "tabs")
    cache = store.cache_from(tabs.where("error is null"))
    fresh = tabs.where("id is not null").select("id", "url", "title")
    return store.overlay_cache(fresh, cache).select("id", "cached", "summary", "summary_source", _joined("keywords").alias("keywords"), "simhash")


@query
def run_cache_fill(spark, d):
    return store.fill_within_run(_canonical_tabs(spark, d), "canonical_url", "simhash").select("id", F.col("value").alias("simhash"))


@query
def open_pages(spark, d):
    return store.open_pages(_t(spark, d, "browser_events"), "batch").select("canonical_url", "title", "domain", F.unix_micros("created_at").alias("created_at"), F.unix_micros("closed_at").alias("closed_at"), "browser_tab")


@query
def import_rekey(spark, d):
    _, _, edges = store.rekey_import(_t(spark, d, "tabs"), _t(spark, d, "tab_groups"), _t(spark, d, "edges"))
    return edges


@query
def export_reindex(spark, d):
    return store.reindex_export(_t(spark, d, "tabs").where("duplicate_of is null"), _t(spark, d, "edges"))


@query
def upsert_tabs(spark, d):
    tabs = _t(spark, d, "tabs").select("id", "url", "title", "group_id")
    changed = _t(spark, d, "tabs").where("duplicate_of is not null").select("id", "url", F.concat(F.lit("again: "), F.coalesce("title", F.lit(""))).alias("title"), "group_id")
    gone = _t(spark, d, "tabs").where("error = 'unsupported_url'").select("id")
    return store.delete(store.upsert(tabs, changed, ["id"]), gone)


@query
def props_json(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---- sources


def _windows(spark, d):
    tabs = _t(spark, d, "tabs").where("id is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "title", "url"))), lambda t: F.struct(t["title"].alias("title"), t["url"].alias("url")))
    return tabs.groupBy("browser", F.col("window_id").alias("windowId")).agg(F.min("id").alias("window_pos"), listed.alias("tabs"))


@query
def windows_flatten(spark, d):
    from ..sources.readers import flatten_windows

    return flatten_windows(_windows(spark, d)).select("id", "url", "title", "browser", "window_id", "domain")


@query
def html_pages(spark, d):
    """Documents put into pages with a menu and a canonical link, and read back by the HTML functions."""
    from ..functions import html

    safe = lambda c: graph_views.escape_html(F.coalesce(c, F.lit("")))
    page = F.concat(
        F.lit("<html><head><title>"), safe(F.col("title")), F.lit('</title><link rel="canonical" href="'), safe(F.col("url")), F.lit('"></head><body><nav>Home | About</nav><script>var x = "<p>";</script><main><p>'),
        safe(F.col("text")), F.lit("</p></main><footer>Imprint</footer></body></html>"),
    )
    pages = _t(spark, d, "documents").where("url is not null").select("doc_id", "url", page.alias("html"))
    read = pages.select("doc_id", html.page_content_udf("html", "url")["title"].alias("title"), html.readable_text_udf("html").alias("readable"), html.canonical_link_udf("html", "url").alias("canonical"))
    return read


@query
def session_tabs(spark, d):
    """Tabs packed into compressed session files, one per window, and read back with the history entry each tab shows."""
    from ..sources import lz4, readers

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lz4.encode_literal)

    tabs = _t(spark, d, "tabs").where("id is not null and url <> ''")
    shown = F.struct(F.lit(2).alias("index"), F.array(F.struct(F.lit("https://before.test/").alias("url"), F.lit("before").alias("title")), F.struct("url", F.coalesce("title", F.lit("")).alias("title"))).alias("entries"))
    files = tabs.groupBy("browser", "window_id").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(shown).alias("tabs"))).alias("windows"))).alias("text"))
    files = files.select(F.concat_ws("/", "browser", "window_id").alias("profile"), packed("text").alias("content"))
    return readers.read_sessions(files).select(F.explode("tabs").alias("t")).groupBy(F.col("t.url").alias("url"), F.col("t.title").alias("title")).agg(F.count("*").alias("times"))


def _scratch(spark, name: str) -> str:
    """A new folder beside the checkpoints, for what a query writes and reads back."""
    from ..checkpoints import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def backup_round_trip(spark, d):
    """Window lists written as a backup, read again and flattened."""
    from ..sources import readers, writers

    path = _scratch(spark, "backup")
    writers.write_backup(_windows(spark, d), path)
    return readers.flatten_windows(spark.read.schema(readers.WINDOWS).json(path)).select("url", "title", "browser", "window_id", "domain").groupBy("url", "title", "browser", "window_id", "domain").agg(F.count("*").alias("times"))


@query
def graph_document(spark, d):
    """The stored graph written as documents and its tabs read back from them."""
    from ..sources import readers

    tabs = _t(spark, d, "tabs").where("id is not null")
    groups = _t(spark, d, "tab_groups").select("id", "label", "tab_ids", F.size("tab_ids").alias("size"))
    path = readers.write_graph(tabs.drop("embedding"), groups, _t(spark, d, "edges").drop("ts"), f"{_scratch(spark, 'graph')}/graph.json", "2025-01-01T00:00:00Z")
    read = readers.read_graph(spark, path)[0] if path.endswith(".json") else readers.read_graph_lines(spark, path)[0]
    return read.select("id", "url", "summary", "simhash", "group_id")


@query
def graph_tables(spark, d):
    """Tabs, groups and edges put in place of an older graph, and what the pointer shows then."""
    from types import SimpleNamespace

    from ..sources import writers

    path = _scratch(spark, "tables")
    tables = {"tabs": _t(spark, d, "tabs"), "groups": _t(spark, d, "tab_groups"), "edges": _t(spark, d, "edges")}
    writers.replace_graph(SimpleNamespace(**{n: t.where("false") for n, t in tables.items()}), path)
    writers.replace_graph(SimpleNamespace(**tables), path)
    writers.truncate(spark, f"{path}/groups")
    now = {n: writers.read_current(spark, f"{path}/{n}") for n in tables}
    return now["tabs"].agg(F.count("*").alias("tabs")).crossJoin(now["groups"].agg(F.count("*").alias("groups"))).crossJoin(now["edges"].agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")))  # one row each


@query
def model_summaries(spark, d):
    """Summaries by a model that says how long its prompt is and fails at prompts of an odd length."""
    from ..operators import plugins

    def make():
        def summarize(prompt: str) -> str:
            if len(prompt) % 2:
                raise ValueError("odd")
            return f"{len(prompt)} characters"

        return summarize

    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body"))
    return plugins.with_summaries(rows, make).select("id", "summary", "summary_source", "error")


@query
def model_embeddings(spark, d):
    """Embeddings, by a model that counts characters, of the tabs that have none."""
    from ..operators import plugins

    tabs = _t(spark, d, "tabs").select("id", "title", "summary", "domain", "text_excerpt", "embedding", "embedding_error")
    made = plugins.with_embeddings(tabs, lambda: lambda texts: [[float(len(t))] for t in texts])
    return made.select("id", F.size("embedding").alias("dims"), F.when(F.size("embedding") == 1, F.col("embedding")[0]).alias("characters"), "embedding_error")


@query
def tab_totals(spark, d):
    return _windows(spark, d).groupBy("browser").agg(F.sum(F.size("tabs")).alias("tabs"), F.count("*").alias("windows"))


@query
def input_limit(spark, d):
    return store.run_limit(_t(spark, d, "tabs").where("id is not null"), 100).select("id", "url")


@query
def lookup_by_address(spark, d):
    return store.first_of(_t(spark, d, "tabs"), "canonical_url", ["title"])


@query
def update_groups(spark, d):
    tabs = _t(spark, d, "tabs").select("id", "group_id")
    return store.update_group(tabs, tabs.where("group_id = -1").select("id", F.col("id").alias("group_id"))).select("id", "group_id")


@query
def non_duplicates(spark, d):
    return store.non_duplicates(_t(spark, d, "tabs")).select("id", "domain")


@query
def union_edges(spark, d):
    stored = _t(spark, d, "edges").select("source", "target", "weight", "reason", "ts")
    moves = navigation.navigation_edges(navigation.first_visits(_t(spark, d, "browser_events")), _t(spark, d, "tabs"))
    return navigation.merge_edges(stored.where("reason <> 'navigation'").unionByName(moves.select(stored.columns))).select("source", "target", "weight", "reason")


@query
def tracking_parameters(spark, d):
    rows = _t(spark, d, "tabs").select("id", F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("p"))
    name = F.lower(F.substring_index("p", "=", 1))
    return rows.where(name.isin(urls.TRACKING_PARAMETERS) | name.startswith("utm_")).groupBy(name.alias("name")).agg(F.count("*").alias("times"))
