"""Queries of the nine problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import addresses, components, mixing, near_dup, packing, residue, set_join, toxicity, vptree
from .common import checkpoint, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.repeated_addresses(table(spark, d, "tabs"))


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    return addresses.collapse_addresses(table(spark, d, "tabs")).select("first_id", "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return set_join.similar_pairs(table(spark, d, "tabs"), threshold=0.6)


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return set_join.link_counts(table(spark, d, "tabs"), threshold=0.6)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.tab_components(table(spark, d, "edges"), table(spark, d, "tabs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_fields(table(spark, d, "tabs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(table(spark, d, "tabs"), threshold=0.7, min_tokens=10)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, d, "tabs"), threshold=0.7, min_tokens=10)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vptree.probe_neighbors(table(spark, d, "tabs"), table(spark, d, "knn_probes")).select(F.col("query_id").alias("probe_id"), "neighbor_id")


def p6_every_twentieth(spark: SparkSession, d: str) -> DataFrame:
    tabs = table(spark, d, "tabs")
    return vptree.nearest(tabs, vptree.stated_query_set(tabs)).select("query_id", "neighbor_id", F.round("cosine", 6).alias("cosine"), "rank")


def p6_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """The relaxed search, below factor one."""
    tabs = table(spark, d, "tabs")
    found = vptree.nearest(tabs, vptree.stated_query_set(tabs), factor=vptree.RELAXED_FACTOR, leaf=vptree.RELAXED_LEAF)
    return found.select("query_id", "neighbor_id", F.round("cosine", 6).alias("cosine"), "rank")


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the relaxed search finds of the exact neighbours, and the share of all pairs it compares."""
    tabs = table(spark, d, "tabs")
    asked = vptree.stated_query_set(tabs)
    share = vptree.compared_share(tabs, asked).select((F.col("compared") / F.col("pairs")).alias("compared_share"))
    return vptree.recall(tabs, asked).crossJoin(share)  # one row each


def p7_contents(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_pieces(table(spark, d, "documents"), table(spark, d, "pack_plans"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "pack_plans")
    return packing.containers(packing.packed_pieces(table(spark, d, "documents"), plans), plans)


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "pack_plans")
    return packing.faults(checkpoint(packing.packed_pieces(table(spark, d, "documents"), plans)), plans)


def _limited(spark: SparkSession, d: str) -> DataFrame:
    """Under all three limits at once: 95 % of the capacity for loss-bearing tokens, a segment for every 64 tokens."""
    return packing.packed_pieces(table(spark, d, "documents"), table(spark, d, "pack_plans"), segment_tokens=64, loss_share=0.95)


def p7_limited(spark: SparkSession, d: str) -> DataFrame:
    return _limited(spark, d)


def p7_limited_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_limited(spark, d), table(spark, d, "pack_plans"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_total(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as the targeted sources are: caps bind, and sources fall short."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sized = mixing.targeted_documents(documents, targets)
    return mixing.mixture(documents, targets, sized=sized, total=mixing.available_tokens(sized))


def p8_total_shares(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.reached_shares(documents, targets, total=mixing.available_tokens(mixing.targeted_documents(documents, targets)))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """(source, short, repeated) for every source with a target and documents: whether it misses as many tokens as its longest document has (less can't be helped where documents aren't cut), and whether a document is repeated beyond the cap."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    longest = mixing.targeted_documents(documents, targets).groupBy("source").agg(F.max("tokens").alias("longest"))
    rows = mixing.reached_shares(documents, targets).join(longest, "source")
    return rows.select("source", (F.col("missing_tokens") >= F.col("longest")).alias("short"), (F.col("most_repeats") > F.col("max_repeats")).alias("repeated"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.harmful_documents(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1].isdigit()}
