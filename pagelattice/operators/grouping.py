"""Groups of tabs and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import BATCH, Options
from . import similarity
from .components import connected_components
from .prefix import running_before


def domain_counts(tabs: DataFrame, least: int = 1) -> DataFrame:
    """(domain, tabs) of the domains with at least so many tabs."""
    return tabs.where("domain <> ''").groupBy("domain").agg(F.count("*").alias("tabs")).where(F.col("tabs") >= least)


def domain_stars(tabs: DataFrame, least: int = 2) -> DataFrame:
    """(a, b): every tab of a domain with at least so many tabs, linked with the domain's first."""
    first = tabs.where("id is not null and domain <> ''").groupBy("domain").agg(F.min("id").alias("a"), F.count("*").alias("n")).where(F.col("n") >= max(2, least))
    return tabs.where("id is not null").select("domain", F.col("id").alias("b")).join(first.select("domain", "a"), "domain").where("a < b").select("a", "b")


def score_stars(tabs: DataFrame) -> DataFrame:
    """(a, b): links that connect what the pairs of one domain that score just the bonus connect. Such pairs have no cosine: one of them has no embedding, or theirs differ in length.

    Tabs without an embedding pair with all others, tabs of one length with all of another: per domain a star around the first tab without an embedding, or else
    one around the first tab of each of the two smallest lengths."""
    rows = similarity.keyword_sets(tabs).where("domain <> ''").select("id", "domain", "dims")
    kinds = rows.groupBy("domain", "dims").agg(F.min("id").alias("first")).groupBy("domain").agg(F.slice(F.sort_array(F.collect_list(F.struct("dims", "first"))), 1, 2).alias("k"))  # a few lengths
    one, two = F.col("k")[0], F.try_element_at("k", F.lit(2))
    centre = F.when(one["dims"] == 0, one["first"]).when(F.col("dims") != one["dims"], one["first"]).otherwise(two["first"])
    met = rows.join(kinds, "domain").select(F.col("id"), centre.alias("c")).where("c is not null and c <> id")
    return met.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))


def group_links(tabs: DataFrame, options: Options = BATCH) -> DataFrame:
    """(a, b): the links that make groups, by domain and by mutual nearest neighbours (or by threshold)."""
    unlimited = not options.mutual_knn or (options.knn_k <= 0 and options.dialect == "batch")
    if unlimited:
        links = similarity.scored_pairs(tabs, options.group_threshold, options.domain_bonus).select("a", "b")
        if options.domain_bonus >= options.group_threshold:
            links = links.unionByName(score_stars(tabs))
    elif options.knn_k <= 0:
        links = tabs.sparkSession.createDataFrame([], "a long, b long")
    else:
        links = similarity.mutual(similarity.nearest(tabs, options.group_threshold, options.domain_bonus, options.knn_k, options.index))
    return links.unionByName(domain_stars(tabs, options.domain_group_least)) if options.domain_group else links


def assign_groups(tabs: DataFrame, options: Options = BATCH) -> DataFrame:
    """(id, root): every tab with the first tab of its group; a tab linked with none is a group of its own."""
    roots = connected_components(group_links(tabs, options), "a", "b")
    return tabs.where("id is not null").select("id").join(roots.select(F.col("node").alias("id"), F.col("component").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def numbered(assigned: DataFrame) -> DataFrame:
    """(root, group_id): roots in ascending order numbered from 0, by counts per range of roots rather than one sort in one task."""
    return running_before(assigned.select("root").distinct().withColumn("one", F.lit(1)), "root", "one", "group_id").select("root", "group_id")


def group_members(assigned: DataFrame, numbers: DataFrame, primary: DataFrame) -> DataFrame:
    """(id, group_id): every tab, duplicates with the group of their primary; -1 where there is none."""
    of_primary = assigned.join(numbers, "root").select(F.col("id").alias("primary"), "group_id")
    return primary.join(of_primary, "primary", "left").select("id", F.coalesce("group_id", F.lit(-1)).alias("group_id"))


def group_rows(members: DataFrame) -> DataFrame:
    """(group_id, tab_ids, size): members in ascending order. An array per group is what the graph document holds; joins should use members."""
    return members.where("group_id >= 0").groupBy("group_id").agg(F.sort_array(F.collect_list("id")).alias("tab_ids"), F.count("*").cast("int").alias("size"))


def idf(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(term, df, idf), idf = ln((1 + N) / (1 + df)) + 1 with N counting documents without tokens as well."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokens_col)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1.0).alias("idf"))  # one row on the right


def top_terms(tokens: DataFrame, weights: DataFrame, n: int = 3) -> DataFrame:
    """(group_id, terms) from (group_id, id, pos, term): the n largest tf * idf, ties by first occurrence in the order of tabs and places."""
    tf = tokens.groupBy("group_id", "term").agg(F.count("*").alias("tf"), F.min(F.struct("id", "pos")).alias("first"))
    scored = tf.join(weights.select("term", "idf"), "term", "left").withColumn("score", F.col("tf") * F.coalesce("idf", F.lit(0.0)))
    order = Window.partitionBy("group_id").orderBy(F.desc("score"), "first")
    best = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return best.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("r", "term"))).alias("t")).select("group_id", F.col("t.term").alias("terms"))


def domain_shares(members: DataFrame) -> DataFrame:
    """(group_id, domain, share) from (group_id, id, domain): the most frequent domain, ties by first occurrence; blank domains count in the whole only."""
    whole = members.groupBy("group_id").agg(F.count("*").alias("whole"))
    counts = members.where("domain <> ''").groupBy("group_id", "domain").agg(F.count("*").alias("c"), F.min("id").alias("first"))
    best = counts.groupBy("group_id").agg(F.max_by(F.struct("domain", "c"), F.struct("c", -F.col("first"))).alias("b"))
    return best.join(whole, "group_id").select("group_id", F.col("b.domain").alias("domain"), (F.col("b.c") / F.col("whole")).alias("share"))


def labels(members: DataFrame, tokens: DataFrame, weights: DataFrame, share: float = 0.55) -> DataFrame:
    """(group_id, label): the dominant domain, else the three strongest terms, else 'group'. Domain shares with at least ``share`` win."""
    named = domain_shares(members).where(F.col("share") >= share).select("group_id", "domain")
    terms = top_terms(tokens, weights).select("group_id", F.array_join("terms", " / ").alias("joined"))
    return members.select("group_id").distinct().join(named, "group_id", "left").join(terms, "group_id", "left").select("group_id", F.coalesce("domain", "joined", F.lit("group")).alias("label"))
