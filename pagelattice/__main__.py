"""Command line: build a graph from window lists or sessions, search one, or report on one."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .checkpoints import checkpoint
from .functions import html
from .operators.graph_views import graph_stats, group_meta
from .operators.search import ordered_results, search_groups
from .operators.store import cache_from, upsert
from .options import Options
from .plans.pipeline import build_batch
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelattice")
    commands = p.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="window lists or session files to a graph")
    b.add_argument("input", help="JSON of window lists, a folder with one, or with --sessions a folder of profiles")
    b.add_argument("--out", default="graph.json")
    b.add_argument("--tables", help="folder for versioned tables")
    b.add_argument("--sessions", action="store_true")
    b.add_argument("--edge-threshold", type=float, default=0.2)
    b.add_argument("--group-threshold", type=float, default=0.25)
    b.add_argument("--domain-bonus", type=float, default=0.25)
    b.add_argument("--no-domain-group", action="store_true")
    b.add_argument("--domain-group-min", type=int, default=2)
    b.add_argument("--knn-k", type=int, default=6)
    b.add_argument("--no-mutual-knn", action="store_true")
    b.add_argument("--dedupe-hamming", type=int, default=3)
    b.add_argument("--keyword-count", type=int, default=8)
    b.add_argument("--limit", type=int, default=0)
    b.add_argument("--pages", help="Parquet of stored page texts (url, text)")
    b.add_argument("--fetch", action="store_true", help="fetch pages that aren't stored")
    b.add_argument("--fetch-timeout", type=int, default=20)
    b.add_argument("--user-agent")
    b.add_argument("--no-crawl", action="store_true", help="titles only")
    b.add_argument("--cache", help="folder of a versioned cache; read before and written after the build")
    b.add_argument("--refresh", action="store_true", help="don't read the cache")
    b.add_argument("--summarizer", help="module:function giving summarize(prompt)")
    b.add_argument("--embedder", help="module:function giving embed(texts)")
    b.add_argument("--embed-model", default=Options.embed_model)
    b.add_argument("--store-embeddings", action="store_true")
    e = commands.add_parser("explore", help="search the groups of a graph document")
    e.add_argument("graph")
    e.add_argument("query", nargs="?", default="")
    e.add_argument("--top", type=int, default=20)
    return p


def _named(place: str | None):
    """The function at module:function, None without a place."""
    if not place:
        return None
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pagelattice").getOrCreate()
    if a.command == "build":
        windows = readers.read_sessions(readers.session_files(spark, a.input)).where("error is null") if a.sessions else readers.read_windows(spark, readers.backup_path(a.input))
        tabs = readers.flatten_windows(windows)
        tabs = tabs.orderBy("id").limit(a.limit) if a.limit else tabs
        texts = None
        if a.pages:
            texts = spark.read.parquet(a.pages).select("url", "text")
        if a.fetch and not a.no_crawl:
            wanted = tabs if texts is None else tabs.join(texts.select("url"), "url", "left_anti")
            got = readers.fetch_pages(wanted, readers.http_fetcher(a.fetch_timeout, a.user_agent)).select("url", html.readable_text_udf("html").alias("text"))
            got = checkpoint(got.where("text <> ''"))
            texts = got if texts is None else texts.unionByName(got)
        cache = writers.read_current(spark, a.cache) if a.cache and not a.refresh else None
        options = Options(no_crawl=a.no_crawl, refresh=a.refresh, embed_model=a.embed_model, store_embeddings=a.store_embeddings, edge_threshold=a.edge_threshold, group_threshold=a.group_threshold, domain_bonus=a.domain_bonus, domain_group=not a.no_domain_group, domain_group_min=a.domain_group_min,
                          knn_k=a.knn_k, mutual_knn=not a.no_mutual_knn, dedupe_hamming=a.dedupe_hamming, keyword_count=a.keyword_count)
        graph = build_batch(tabs, texts, options, cache=cache, summarizer=_named(a.summarizer), embedder=_named(a.embedder))
        if a.cache:
            kept = graph.tabs if "embedding" in graph.tabs.columns else graph.tabs.withColumn("embedding", F.lit(None).cast("array<double>"))
            fresh = cache_from(kept.where("error is null"), a.embed_model)
            writers.write_version(fresh if cache is None else upsert(cache, fresh, ["cache_key"]), a.cache)
        if a.tables:
            writers.replace_graph(graph, a.tables)
        if "embedding_error" not in graph.tabs.columns:
            graph.tabs = graph.tabs.withColumn("embedding_error", F.lit(None).cast("string"))
        readers.write_graph(graph.tabs, graph.groups, graph.edges, a.out, dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
        print(graph_stats(graph.tabs, graph.groups, graph.edges).first().asDict())
        return
    tabs, groups, _ = readers.read_graph(spark, a.graph)
    for r in ordered_results(search_groups(group_meta(groups, tabs), a.query)).limit(a.top).collect():
        print(f"[{r.group_id}] {r.label} ({r.size})  score:{r.score:.2f}")


if __name__ == "__main__":
    main()
