"""The whole graph build in both dialects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpoint, release, stored
from ..functions import text, urls
from ..operators import dedupe, grouping, navigation, plugins, similarity, store
from ..options import BATCH, LIVE, Options


@dataclass
class Graph:
    tabs: DataFrame
    groups: DataFrame
    find_edges: Callable[[], DataFrame]

    @cached_property
    def edges(self) -> DataFrame:
        """Found when they are asked for: the rows that meet are written for them once more."""
        return self.find_edges()


def enrich(tabs: DataFrame, options: Options = BATCH, pages_text: DataFrame | None = None, summarizer=None) -> DataFrame:
    """Summary, excerpt, keywords, tokens and simhash of every http(s) tab; others get the error unsupported_url and nothing else.

    ``pages_text`` (url, text) holds readable texts; without it (or with no_crawl) only titles are used. A later tab of a page inherits what the first one found."""
    rows = tabs.withColumn("http", urls.is_http(F.col("url")))
    crawled = pages_text is not None and not options.no_crawl
    if crawled:
        stored = pages_text.groupBy("url").agg(F.min("text").alias("text"))
        rows = rows.join(stored, "url", "left")
    else:
        rows = rows.withColumn("text", F.lit(None).cast("string"))
    body = text.truncate_words(F.coalesce("text", F.lit("")), options.max_chars) if options.dialect == "batch" else F.substring(F.coalesce("text", F.lit("")), 1, options.live_chars)
    title = F.coalesce("title", F.lit(""))
    rows = rows.withColumn("body", body)
    summary = text.fallback_summary(F.col("body"), options.summary_sentences) if crawled else F.lit("")
    rows = rows.withColumn("summary", summary).withColumn("summary_source", F.when(F.col("http"), F.lit("fallback" if crawled else "none")))
    failed = F.lit(None).cast("string")
    if crawled and summarizer is not None:
        made = plugins.with_summaries(rows.where("http and body <> ''").select("id", "title", "body"), summarizer, options)
        made = made.select("id", F.col("summary").alias("made"), F.col("summary_source").alias("made_by"), F.col("error").alias("made_error"))
        rows = rows.join(made, "id", "left").withColumn("summary", F.coalesce("made", "summary")).withColumn("summary_source", F.coalesce("made_by", "summary_source"))
        failed = F.col("made_error")
    rows = rows.withColumn("text_excerpt", F.when(F.col("http"), F.substring("body", 1, options.excerpt_chars))).withColumn("error", F.when(~F.col("http"), "unsupported_url").otherwise(failed)).drop("made", "made_by", "made_error")
    if options.dialect == "live":
        key_text = analysis = F.concat_ws(" ", title, F.col("body"))
    else:
        key_text, analysis = F.concat_ws(" ", title, F.col("summary")), F.concat_ws(" ", title, F.col("summary"), F.coalesce("text_excerpt", F.lit("")))
    cut = lambda c: text.tokens(c, options.dialect, options.extra_stopwords)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("key_tokens", F.when(F.col("http"), cut(key_text)).otherwise(none)).withColumn("tokens", F.when(F.col("http"), cut(analysis)).otherwise(none))
    rows = checkpoint(rows.drop("http", "body", "text"))
    kw = text.keywords(rows, "id", "key_tokens", options.keyword_count)
    hashes = text.simhash(rows, "id", "tokens", options.dialect)
    return rows.drop("key_tokens").join(kw, "id", "left").join(hashes, "id", "left").withColumn("keywords", F.coalesce("keywords", none))


def inherit(tabs: DataFrame) -> DataFrame:
    """Keywords and simhash of the first tab of the same canonical address that has any (a build reads what it has just cached)."""
    from ..operators.store import fill_within_run

    web = tabs.where("error is null or error <> 'unsupported_url'")
    kw = fill_within_run(web, "canonical_url", "keywords", F.size("keywords") <= 0).withColumnRenamed("value", "kw")
    sh = fill_within_run(web, "canonical_url", "simhash").withColumnRenamed("value", "sh")
    out = tabs.join(kw, "id", "left").join(sh, "id", "left")
    return out.withColumn("keywords", F.coalesce("kw", "keywords")).withColumn("simhash", F.coalesce("sh", "simhash")).drop("kw", "sh")


def build(tabs: DataFrame, options: Options = BATCH, navigations: DataFrame | None = None, every_pair: bool = True) -> Graph:
    """Dedupe, similarity, groups and labels of enriched tabs (id, url, title, domain, canonical_url, keywords, tokens, simhash).

    ``every_pair`` also writes the edges that only a common domain makes, which are quadratic in a domain's tabs; without it they are implied by ``similarity.domain_cliques``."""
    rows = dedupe.with_canonical(tabs, options.dialect)
    primary = checkpoint(dedupe.dedupe(rows, options.dedupe_hamming))
    release(rows.sparkSession)
    rows = stored(rows.drop("duplicate_of", "aliases", "group_id").join(primary, "id").withColumn("duplicate_of", F.when(F.col("primary") != F.col("id"), F.col("primary"))))
    release(rows.sparkSession)  # whole rows were shuffled
    mains = rows.where("duplicate_of is null")

    def find_edges() -> DataFrame:
        edges = similarity.similarity_edges(mains, options.edge_threshold, options.domain_bonus, every_pair, options.dialect).withColumn("ts", F.lit(None).cast("timestamp"))
        return edges if navigations is None else navigation.merge_into(edges, navigation.navigation_edges(navigations, rows))

    assigned = checkpoint(grouping.assign_groups(mains, options))
    numbers = checkpoint(grouping.numbered(assigned))
    members = checkpoint(grouping.group_members(assigned, numbers, primary))
    words = "tokens" if options.dialect == "batch" else "keywords"
    weights = grouping.idf(mains.select("id", F.coalesce(words, F.array().cast("array<string>")).alias("tokens")))
    own = mains.select("id", F.coalesce("domain", F.lit("")).alias("domain"), words).join(members, "id")
    placed = own.select("group_id", "id", F.posexplode(words).alias("pos", "term"))
    names = grouping.labels(own.select("group_id", "id", "domain"), placed, weights, options.label_share)
    listed = members if options.dialect == "batch" else own.select("id", "group_id")
    groups = grouping.group_rows(listed).join(names, "group_id").select(F.col("group_id").alias("id"), "label", "tab_ids", "size")
    named = dedupe.aliases(rows, primary).select(F.col("primary").alias("id"), "aliases")
    out = rows.drop("primary", "tokens").join(members, "id", "left")
    out = out.join(named, "id", "left") if options.dialect == "batch" else out
    return Graph(out if options.store_embeddings else out.drop("embedding"), groups, find_edges)


def from_cache(tabs: DataFrame, cache: DataFrame, options: Options = BATCH) -> tuple[DataFrame, DataFrame]:
    """(found, left): tabs enriched by a cache's entries, with their tokens, and those without an entry as they are."""
    rows = checkpoint(store.overlay_cache(tabs, cache, options.embed_model))  # read twice
    found = rows.where("cached").drop("cached").withColumn("error", F.when(~urls.is_http(F.col("url")), "unsupported_url"))
    analysis = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("text_excerpt", F.lit("")))
    none = F.array().cast("array<string>")
    found = found.withColumn("tokens", F.when(urls.is_http(F.col("url")), text.tokens(analysis, options.dialect, options.extra_stopwords)).otherwise(none)).withColumn("keywords", F.coalesce("keywords", none))
    return found, tabs.join(rows.where("cached").select("id"), "id", "left_anti")


def build_batch(tabs: DataFrame, pages_text: DataFrame | None = None, options: Options = BATCH, every_pair: bool = True, cache: DataFrame | None = None, summarizer=None, embedder=None) -> Graph:
    """A whole build: entries of a cache (unless options.refresh), texts of pages for the others, summaries and embeddings from models where they are given (see ``operators.plugins``)."""
    if cache is not None and not options.refresh:
        found, left = from_cache(tabs, cache, options)
        rows = found.unionByName(enrich(left, options, pages_text, summarizer), allowMissingColumns=True)
    else:
        rows = enrich(tabs, options, pages_text, summarizer)
    rows = inherit(rows)
    if embedder is not None:
        rows = rows if "embedding" in rows.columns else rows.withColumn("embedding", F.lit(None).cast("array<double>"))
        rows = checkpoint(plugins.with_embeddings(rows.withColumn("embedding_error", F.lit(None).cast("string")), embedder, options))
    return build(rows, options, every_pair=every_pair)


def rebuild_live(tabs: DataFrame, navigations: DataFrame, options: Options = LIVE, every_pair: bool = True) -> Graph:
    return build(tabs, options, navigations, every_pair)
