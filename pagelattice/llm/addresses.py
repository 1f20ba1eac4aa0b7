"""Problem 1: records that differ only in how their address is written.

An address is read as a small tree: scheme, host and port, an *ordered* node of path segments and an *unordered* node of
parameters, each leaf normalised to its runs of a-z and 0-9. Digests are built bottom-up (the child digests of the unordered
node are sorted), rows are grouped by the digest of the root, and a group holds only rows whose whole normalised structure is
equal, so a collision of digests can't merge two addresses. Everything is a built-in expression: one shuffle of
(digest, structure) with map-side partial aggregation, then one join that adaptive execution may split where an address is hot.

Defined cases: null or non-http(s) addresses and null ids take no part; an address that occurs once gives a group of one; repeated
rows count as copies; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import TRACKING_PARAMETERS

_ADDRESS = r"(?s)^[\s\p{Z}]*([Hh][Tt][Tt][Pp][Ss]?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _decoded(part: Column) -> Column:
    """Percent-decoding that leaves malformed escapes as they are; bytes that aren't UTF-8 become replacement characters."""
    whole = F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(part.contains("%"), F.coalesce(F.try_url_decode(whole), part)).otherwise(part)


def _runs(part: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_decoded(part)), "[^a-z0-9]+", " "))


def _parameter(pair: Column) -> Column:
    name, value = F.substring_index(pair, "=", 1), F.when(pair.contains("="), F.expr("null")).otherwise(F.lit(""))
    value = F.coalesce(value, F.substring(pair, F.length(name) + 2, F.length(pair)))
    runs = _runs(name)
    tracking = runs.isin([p.replace("_", " ") for p in TRACKING_PARAMETERS]) | runs.startswith("utm ")
    return F.struct(runs.alias("name"), _runs(value).alias("value"), tracking.alias("tracking"))


def address_tree(address: Column) -> Column:
    """STRUCT<scheme, host, port, path ARRAY, params ARRAY<STRUCT<name, value>>>, or null where the address isn't http(s)."""
    part = lambda i: F.regexp_extract(address, _ADDRESS, i)
    authority = F.lower(F.regexp_replace(part(2), "^.*@", ""))
    scheme = F.lower(part(1))
    port = F.regexp_extract(authority, r":(\d+)[\s\p{Z}]*$", 1)
    port = F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(port)
    host = F.regexp_replace(F.regexp_replace(authority, r":\d*[\s\p{Z}]*$", ""), r"^[\s\p{Z}]+|[\s\p{Z}.]+$", "")
    path = F.filter(F.transform(F.split(part(3), "/"), _runs), lambda s: s != "")
    params = F.filter(F.transform(F.split(part(4), "&"), _parameter), lambda p: ~p["tracking"] & ((p["name"] != "") | (p["value"] != "")))
    params = F.transform(params, lambda p: F.struct(p["name"], p["value"]))
    tree = F.struct(scheme.alias("scheme"), F.regexp_replace(host, r"^www\.", "").alias("host"), port.alias("port"), path.alias("path"), params.alias("params"))
    return F.when(address.rlike(_ADDRESS), tree)


def root_digest(tree: Column) -> Column:
    """Merkle-style digest: leaves, then the ordered path node, the sorted children of the parameter node, then the root."""
    path = F.xxhash64(F.lit("path"), F.transform(tree["path"], lambda s: F.xxhash64(s)))
    params = F.xxhash64(F.lit("params"), F.array_sort(F.transform(tree["params"], lambda p: F.xxhash64(p["name"], p["value"]))))
    return F.xxhash64(tree["scheme"], tree["host"], tree["port"], path, params)


def structure(tree: Column) -> Column:
    """The whole normalised tree as text, equal exactly where the trees are equal up to the order of parameters."""
    params = F.array_sort(F.transform(tree["params"], lambda p: F.concat(p["name"], F.lit("="), p["value"])))
    return F.concat_ws("|", tree["scheme"], tree["host"], tree["port"], F.array_join(tree["path"], "/"), F.array_join(params, "&"))


def digested(tabs: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (tab_id, digest, form) for every row of tabs that has an http(s) address."""
    rows = tabs.select(F.col(id_col).alias("tab_id"), F.coalesce("canonical_url", "url").alias("address"))
    rows = rows.where(F.col("tab_id").isNotNull() & F.col("address").rlike(_ADDRESS)).withColumn("tree", address_tree(F.col("address")))
    return rows.select("tab_id", root_digest(F.col("tree")).alias("digest"), structure(F.col("tree")).alias("form"))


def collapse_addresses(tabs: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per page: (first_id, form, copies)."""
    groups = digested(tabs, id_col).groupBy("digest", "form").agg(F.min("tab_id").alias("first_id"), F.count("*").alias("copies"))
    return groups.select("first_id", "form", "copies")


def repeated_addresses(tabs: DataFrame, id_col: str = "id") -> DataFrame:
    """(first_id, tab_id) for every tab whose address occurred at a smaller id."""
    rows = digested(tabs, id_col)
    groups = rows.groupBy("digest", "form").agg(F.min("tab_id").alias("first_id"), F.max("tab_id").alias("last_id"))
    groups = groups.where(F.col("first_id") < F.col("last_id"))
    return rows.join(groups, ["digest", "form"]).where(F.col("first_id") < F.col("tab_id")).select("first_id", "tab_id")
