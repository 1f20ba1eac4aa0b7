"""Views over a graph of tabs, edges and groups: adjacency of groups, their descriptions, listings and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded_groups(groups: DataFrame) -> DataFrame:
    """(group_id, label, pos, tab_id) of groups (id, label, tab_ids)."""
    return groups.select(F.col("id").alias("group_id"), "label", F.posexplode("tab_ids").alias("pos", "tab_id")).where("tab_id is not null")


def tab_groups_of(groups: DataFrame, tabs: DataFrame) -> DataFrame:
    """(id, group_id): by the groups' lists (the largest group id where several list a tab), else by the tab's own mark."""
    listed = exploded_groups(groups).groupBy("tab_id").agg(F.max("group_id").alias("listed"))
    return tabs.select("id", F.col("group_id").alias("own")).join(listed, F.col("id") == F.col("tab_id"), "left").select("id", F.coalesce("listed", "own").alias("group_id"))


def group_pairs(edges: DataFrame, of_tab: DataFrame) -> DataFrame:
    """(group_a, group_b, weight), group_a < group_b: summed weights of the edges between two groups."""
    a, b = of_tab.select(F.col("id").alias("source"), F.col("group_id").alias("ga")), of_tab.select(F.col("id").alias("target"), F.col("group_id").alias("gb"))
    met = edges.where("source is not null and target is not null").join(a, "source").join(b, "target").where("ga <> gb")
    return met.groupBy(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b")).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def adjacency(edges: DataFrame, of_tab: DataFrame) -> DataFrame:
    """(group_id, neighbor_id, weight, rank) in both directions, the heaviest first, ties by the smaller id."""
    half = group_pairs(edges, of_tab)
    both = half.select(F.col("group_a").alias("group_id"), F.col("group_b").alias("neighbor_id"), "weight").unionByName(half.select(F.col("group_b").alias("group_id"), F.col("group_a").alias("neighbor_id"), "weight"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(F.round("weight", 9)), "neighbor_id")))


def mini_map(ranked: DataFrame, limit: int = 8) -> DataFrame:
    """(group_id, rank, neighbor_id, mark): the first neighbours with a mark for their weight."""
    w = F.col("weight")
    mark = F.when(w >= 0.8, "#").when(w >= 0.6, "+").when(w >= 0.4, "-").otherwise(".")
    return ranked.where(F.col("rank") <= limit).select("group_id", "rank", "neighbor_id", mark.alias("mark"))


def group_meta(groups: DataFrame, tabs: DataFrame, top: int = 12, titles: int = 10) -> DataFrame:
    """(group_id, label, size, domain, keywords, blob, tokens): what a group can be searched by. Ties go to what occurs first in the group's list."""
    rows = exploded_groups(groups).join(tabs.select(F.col("id").alias("tab_id"), "domain", "keywords", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(F.col("url") != "", F.col("url"))).alias("shown")), "tab_id")
    domains = rows.where("domain <> ''").groupBy("group_id", "domain").agg(F.count("*").alias("c"), F.min("pos").alias("p")).groupBy("group_id").agg(F.max_by("domain", F.struct("c", -F.col("p"))).alias("domain"))
    words = rows.select("group_id", "pos", F.posexplode("keywords").alias("kpos", "k")).where("k is not null").groupBy("group_id", "k").agg(F.count("*").alias("c"), F.min(F.struct("pos", "kpos")).alias("first"))
    ranked = words.withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("c"), "first"))).where(F.col("r") <= top)
    keywords = ranked.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("r", "k"))).alias("k")).select("group_id", F.col("k.k").alias("keywords"))
    shown = rows.where("shown is not null").withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy("pos"))).where(F.col("r") <= titles)
    first = shown.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("r", "shown"))).alias("t")).select("group_id", F.col("t.shown").alias("titles"))
    out = groups.select(F.col("id").alias("group_id"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce(F.size("tab_ids"), F.lit(0)).alias("size"))
    out = out.join(domains, "group_id", "left").join(keywords, "group_id", "left").join(first, "group_id", "left")
    none = F.array().cast("array<string>")
    out = out.select("group_id", "label", "size", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("keywords", none).alias("keywords"), F.coalesce("titles", none).alias("titles"))
    blob = F.lower(F.concat_ws(" ", F.col("group_id").cast("string"), "label", "domain", F.array_join("keywords", " "), F.array_join("titles", " ")))
    return out.withColumn("blob", blob).withColumn("tokens", F.filter(F.split(F.regexp_replace("blob", "[^a-z0-9]+", " "), " "), lambda t: t != ""))


def group_details(meta: DataFrame, ranked: DataFrame) -> DataFrame:
    """(group_id, label, tabs, neighbors, domain, keywords, sample): six keywords, five titles."""
    counts = ranked.groupBy("group_id").agg(F.count("*").alias("neighbors"))
    shown = lambda c: F.when(c == "", "(none)").otherwise(c)
    return meta.join(counts, "group_id", "left").select(
        "group_id", "label", F.col("size").alias("tabs"), F.coalesce("neighbors", F.lit(0)).alias("neighbors"), shown(F.col("domain")).alias("domain"),
        shown(F.array_join(F.slice("keywords", 1, 6), ", ")).alias("keywords"), F.array_join(F.slice("titles", 1, 5), " | ").alias("sample"),
    )


def group_list(groups: DataFrame) -> DataFrame:
    """(group_id, shown): groups by size, then label, both descending."""
    rows = groups.select(F.col("id").alias("group_id"), F.coalesce("label", F.lit("group")).alias("label"), F.coalesce(F.size("tab_ids"), F.lit(0)).alias("size"))
    return rows.orderBy(F.desc("size"), F.desc("label"), "group_id").select("group_id", F.format_string("[%d] %s (%d)", "group_id", "label", "size").alias("shown"))


def tab_details(tabs: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, title, summary, keywords, group_label) with defaults for what is missing."""
    text = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    names = groups.select(F.col("id").alias("group_id"), F.col("label").alias("group_label"))
    return tabs.join(names, "group_id", "left").select(
        "id", text("title", text("url", F.lit("(untitled)"))).alias("title"), text("summary", F.lit("(no summary)")).alias("summary"),
        F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", ").alias("keywords"), F.coalesce("group_label", F.lit("Ungrouped")).alias("group_label"),
    )


def render_nodes(tabs: DataFrame, length: int = 30, colors: int = 10) -> DataFrame:
    """(id, shown, color): primaries with a short title and the number of their group's color."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"), F.lit(""))
    short = F.when(F.length(title) > length, F.concat(F.substring(title, 1, length), F.lit("..."))).otherwise(title)
    return tabs.where("duplicate_of is null").select("id", short.alias("shown"), F.when(F.col("group_id") >= 0, F.pmod("group_id", F.lit(colors))).alias("color"))


def escape_html(text) -> object:
    """Text as it may stand in a page."""
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def group_members(groups: DataFrame, tabs: DataFrame) -> DataFrame:
    """(group_id, pos, tab_id, shown): the tabs of every group in its order, with what names them."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    named = tabs.select(F.col("id").alias("tab_id"), F.coalesce(text("title"), text("url"), F.lit("(untitled)")).alias("shown"))
    return exploded_groups(groups).join(named, "tab_id").select("group_id", "pos", "tab_id", "shown")


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes, with the width they are drawn in."""
    ids = nodes.select(F.col("id").alias("node")).distinct()
    kept = edges.join(ids, F.col("source") == F.col("node"), "left_semi").join(ids, F.col("target") == F.col("node"), "left_semi")
    return kept.select("source", "target", "weight", "reason", F.when(F.col("reason") == "navigation", 2).otherwise(1).alias("width"))


def graph_stats(tabs: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts over tabs, groups and edges."""
    t = tabs.agg(
        F.count("*").alias("tab_count"), F.count_if(F.coalesce(F.col("error"), F.lit("")).startswith("fetch_failed")).alias("errors"), F.count_if(F.col("embedding_error").isNotNull()).alias("embed_errors"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"), F.count_if(F.col("duplicate_of").isNull()).alias("primary_tabs"), 
    )
    domains = tabs.where("duplicate_of is null").select(F.coalesce("domain", F.lit("")).alias("d")).distinct().agg(F.count("*").cast("int").alias("domains"))
    e = edges.agg(F.count("*").alias("edge_count"), F.count_if(F.col("reason") == "navigation").alias("navigation_edges"), F.count_if(F.col("reason") != "navigation").alias("similarity_edges"))
    return t.crossJoin(domains).crossJoin(groups.agg(F.count("*").alias("group_count"))).crossJoin(e)  # one row each
