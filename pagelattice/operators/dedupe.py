"""Exact and near duplicates of tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .components import connected_components


def with_canonical(tabs: DataFrame, dialect: str = "batch") -> DataFrame:
    """Fill canonical_url where it is null or empty."""
    given = F.when(F.col("canonical_url") != "", F.col("canonical_url"))
    return tabs.withColumn("canonical_url", F.coalesce(given, urls.canonical_url(F.col("url"), dialect)))


def canonical_links(tabs: DataFrame) -> DataFrame:
    """(a, b): every tab with the first tab of its canonical address; a grouped minimum joined back, so a hot address is never sorted in one task."""
    keyed = tabs.where("id is not null and canonical_url <> ''").select("id", "canonical_url")
    first = keyed.groupBy("canonical_url").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("canonical_url", "a")
    return keyed.join(first, "canonical_url").where("id > a").select("a", F.col("id").alias("b"))


def near_duplicate_links(tabs: DataFrame, radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """(same, near): stars of equal hashes (a, b), and pairs (a, b, distance) of different hashes within the radius, in one domain each.

    Equal hashes of a domain are one class. Two hashes within the radius agree in one of radius + 1 bands, so classes meet by domain, band and its bits; the pairs
    are those a scan of all pairs would find.
    """
    hashed = tabs.where("id is not null and simhash is not null and domain <> ''").select("id", "domain", "simhash")
    classes = hashed.groupBy("domain", "simhash").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    same = hashed.join(classes.where("a < z"), ["domain", "simhash"]).where("id > a").select("a", F.col("id").alias("b"))
    bands = radius + 1
    cuts = [64 * k // bands for k in range(bands + 1)]
    parts = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("simhash", cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1 if bands > 1 else -1).alias("bits")) for k in range(bands)])
    banded = classes.select("domain", "simhash", F.col("a").alias("id"), F.explode(parts).alias("p")).select("domain", "simhash", "id", "p.band", "p.bits")
    x, y = banded.alias("x"), banded.alias("y")
    distance = F.bit_count(F.col("x.simhash").bitwiseXOR(F.col("y.simhash")))
    met = x.join(y, (F.col("x.domain") == F.col("y.domain")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.id") < F.col("y.id")) & (distance <= radius) & (distance > 0))
    near = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), distance.alias("distance")).distinct()
    return same, near


def near_duplicate_pairs(tabs: DataFrame, radius: int = 3) -> DataFrame:
    """(id_a, id_b, distance) of all tabs within the radius in one domain, copies expanded."""
    same, near = near_duplicate_links(tabs, radius)
    hashed = tabs.where("id is not null and simhash is not null and domain <> ''").select("id", "domain", "simhash")
    first = hashed.groupBy("domain", "simhash").agg(F.min("id").alias("a"))
    members = hashed.join(first, ["domain", "simhash"]).select("a", "id")
    left, right = members.select("a", F.col("id").alias("x")), members.select(F.col("a").alias("b"), F.col("id").alias("y"))
    own = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y", F.lit(0).alias("distance"))
    other = near.join(left, "a").join(right, "b").select("x", "y", "distance")
    return own.unionByName(other).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "distance")


def dedupe(tabs: DataFrame, radius: int = 3) -> DataFrame:
    """(id, primary): every tab with the first tab of its duplicates, linked by canonical address or near-equal hash, chains included."""
    same, near = near_duplicate_links(tabs, radius)
    links = canonical_links(tabs).unionByName(same).unionByName(near.select("a", "b"))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("primary"))
    return tabs.where("id is not null").select("id").join(groups, "id", "left").select("id", F.coalesce("primary", "id").alias("primary"))


def aliases(tabs: DataFrame, primary: DataFrame) -> DataFrame:
    """(primary, duplicates, aliases): how many tabs a primary stands for besides itself and their addresses, sorted and without repeats."""
    other = primary.where("primary <> id").join(tabs.select("id", "url"), "id")
    return other.groupBy("primary").agg(F.count("*").alias("duplicates"), F.array_sort(F.collect_set(F.when(F.col("url") != "", F.col("url")))).alias("aliases"))
