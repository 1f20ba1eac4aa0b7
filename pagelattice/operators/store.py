"""Keyed tables: cache overlay, upserts, imports and exports. Every operation returns the new table; writers write it beside the old one and swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .navigation import delivered_once

CACHE_FIELDS = ["summary", "summary_source", "text_excerpt", "keywords", "canonical_url", "simhash", "embedding", "embedding_model"]


def cache_from(tabs: DataFrame, embed_model: str = "nomic-embed-text", fingerprint: str | None = None) -> DataFrame:
    """(cache_key, *CACHE_FIELDS): entries under the page's canonical address and the address's own canonical form, the last tab winning."""
    own = urls.canonical_url(F.col("url"))
    rows = tabs.where("id is not null").withColumn("embedding_model", F.lit(embed_model))
    keyed = rows.select("id", F.explode(F.array_distinct(F.filter(F.array(F.coalesce("canonical_url", own), own), lambda k: k.isNotNull()))).alias("cache_key"), *CACHE_FIELDS)
    out = keyed.groupBy("cache_key").agg(F.max_by(F.struct(*CACHE_FIELDS), "id").alias("e")).select("cache_key", "e.*")
    return out if fingerprint is None else out.withColumn("fingerprint", F.lit(fingerprint))


def overlay_cache(tabs: DataFrame, cache: DataFrame, embed_model: str | None = None) -> DataFrame:
    """Tabs with the fields of their cache entry, looked up by address, then by canonical address; ``cached`` tells whether there was one.

    An entry with an embedding of another model lends everything but the embedding."""
    fields = F.struct(*CACHE_FIELDS)
    direct = cache.select(F.col("cache_key").alias("url"), fields.alias("by_url"))
    canonical = cache.select(F.col("cache_key").alias("own_canonical"), fields.alias("by_canonical"))
    rows = tabs.withColumn("own_canonical", urls.canonical_url(F.col("url"))).join(direct, "url", "left").join(canonical, "own_canonical", "left")
    entry = F.coalesce("by_url", "by_canonical")
    same_model = (F.size(entry["embedding"]) > 0) & (entry["embedding_model"] == embed_model) if embed_model else F.lit(False)
    out = {f: F.when(entry.isNotNull(), F.coalesce(entry[f], F.lit("")) if f in ("summary", "summary_source", "text_excerpt") else entry[f]) for f in CACHE_FIELDS[:6]}
    kept = [c for c in tabs.columns if c not in CACHE_FIELDS]
    given = lambda f: F.col(f) if f in tabs.columns else F.lit(None)
    columns = [F.when(entry.isNotNull(), F.coalesce(out[f], given(f)) if f == "canonical_url" else out[f]).otherwise(given(f)).alias(f) for f in CACHE_FIELDS[:6]]
    vector = F.when(entry.isNotNull() & same_model, entry["embedding"]).otherwise(given("embedding") if "embedding" in tabs.columns else F.lit(None).cast("array<double>")).alias("embedding")
    return rows.select(*kept, *columns, vector, entry.isNotNull().alias("cached"))


def fill_within_run(tabs: DataFrame, key: str, field: str, empty: Column | None = None) -> DataFrame:
    """(id, value): the field of the first tab so far with the same key that has one. A later tab of a key inherits what an earlier one found."""
    value = F.when(~empty, F.col(field)) if empty is not None else F.col(field)
    first = tabs.where(value.isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(F.col("id").alias("since"), value.alias("v")), "id").alias("f"))
    # The first non-empty value of a key is a grouped minimum; a tab before it has none yet.
    return tabs.join(first, key, "left").select("id", F.when(F.col("f.since") <= F.col("id"), F.col("f.v")).alias("value"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows put in by key: those of the table whose key comes again are replaced."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def update_group(tabs: DataFrame, changes: DataFrame) -> DataFrame:
    """Tabs with the group of changes (id, group_id) where there is one."""
    new = changes.select("id", F.col("group_id").alias("new_group"))
    return tabs.join(new, "id", "left").withColumn("group_id", F.coalesce("new_group", "group_id")).drop("new_group")


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """The row with the smallest id among those with the value."""
    return table.where(F.col(column) == value).orderBy("id").limit(1)


def open_pages(events: DataFrame, dialect: str = "live") -> DataFrame:
    """(canonical_url, url, title, domain, created_at, closed_at, browser_tab): pages known from events, one row per canonical address.

    A page keeps the last address and title seen; it is open in the browser tab that showed it last, unless that tab was closed or shows another page since."""
    rows = delivered_once(events).where("tab_id is not null and ts is not null")
    shown = rows.where((F.col("event") == "updated") & (F.col("status") == "complete") & urls.is_http(F.col("url"))).withColumn("canonical_url", urls.canonical_url(F.col("url"), dialect))
    place = F.struct("ts", "tab_id", "url", F.coalesce("title", F.lit("")))
    pages = shown.groupBy("canonical_url").agg(F.max_by(F.struct("url", "tab_id", "ts"), place).alias("l"), F.max_by("title", F.when(F.col("title") != "", place)).alias("title"), F.min("ts").alias("created_at"))
    latest = shown.groupBy("tab_id").agg(F.max_by(F.struct("canonical_url", "ts"), place).alias("now"))
    gone = rows.where("event = 'removed'").groupBy("tab_id").agg(F.max("ts").alias("gone"))
    out = pages.select("canonical_url", "l.url", "title", "created_at", F.col("l.tab_id").alias("tab_id"), F.col("l.ts").alias("seen")).join(latest, "tab_id", "left").join(gone, "tab_id", "left")
    closed = F.when((F.col("gone") >= F.col("seen")) & (F.col("now.canonical_url") == F.col("canonical_url")), F.col("gone"))
    is_open = closed.isNull() & (F.col("now.canonical_url") == F.col("canonical_url"))
    return out.select("canonical_url", "url", F.coalesce("title", F.lit("")).alias("title"), urls.domain(F.col("url"), dialect).alias("domain"), "created_at", closed.alias("closed_at"), F.when(is_open, F.col("tab_id")).alias("browser_tab"))


def rekey_import(tabs: DataFrame, groups: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of an imported graph with ids import_<id>; edges are keyed by ends and reason, so a second import changes nothing."""
    key = lambda c: F.concat(F.lit("import_"), F.col(c).cast("string"))
    t = tabs.select(key("id").alias("id"), "url", F.coalesce("canonical_url", "url").alias("canonical_url"), "title", "domain", "keywords", F.when(F.col("group_id") >= 0, key("group_id")).alias("group_id"), F.lit("import").alias("source"))
    g = groups.select(key("id").alias("id"), "label", F.transform("tab_ids", lambda x: F.concat(F.lit("import_"), x.cast("string"))).alias("tab_ids"), F.size("tab_ids").alias("size"))
    e = edges.where("source is not null and target is not null").groupBy(key("source").alias("source"), key("target").alias("target"), "reason").agg(F.max("weight").alias("weight"))
    return t, g, e


def positions(tabs: DataFrame) -> DataFrame:
    """(id, position): ids in ascending order numbered from 0, by counts per range of ids."""
    from .grouping import numbered

    return numbered(tabs.where("id is not null").select(F.col("id").alias("root"))).select(F.col("root").alias("id"), F.col("group_id").alias("position"))


def reindex_export(tabs: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, weight, reason) by position; edges with an unknown end don't come out."""
    at = positions(tabs)
    a, b = at.select(F.col("id").alias("source"), F.col("position").alias("s")), at.select(F.col("id").alias("target"), F.col("position").alias("t"))
    return edges.join(a, "source").join(b, "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "weight", "reason")


def group_number(group_id: Column) -> Column:
    """The digits of a group's id as a number, null without any."""
    return F.regexp_replace(group_id.cast("string"), "[^0-9]", "").try_cast("long")


def group_urls(groups: DataFrame, tabs: DataFrame, browser: str | None = None, group_id: int | None = None) -> DataFrame:
    """(group_id, pos, url): the addresses to open per group in its order, of one browser or group if asked."""
    from .graph_views import exploded_groups

    rows = exploded_groups(groups).join(tabs.select(F.col("id").alias("tab_id"), "url", "browser"), "tab_id").where("url <> ''")
    rows = rows if browser is None else rows.where(F.col("browser") == browser)
    rows = rows if group_id is None else rows.where(F.col("group_id") == group_id)
    return rows.select("group_id", "pos", "url")


def run_limit(tabs: DataFrame, n: int) -> DataFrame:
    """The first n tabs in order of input; 0 keeps all."""
    return tabs.orderBy("id").limit(n) if n > 0 else tabs


def page_id(canonical_url: Column) -> Column:
    """The id of a live page: made from its address, so that a page captured twice, or by a task that runs again, keeps it."""
    return F.concat(F.lit("tab_"), F.lower(F.hex(F.xxhash64(canonical_url))))


def first_of(table: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """For every value of a column the row with the smallest id: ``lookup`` for all values at once."""
    return table.where(F.col("id").isNotNull() & F.col(column).isNotNull()).groupBy(column).agg(F.min_by(F.struct("id", *keep), "id").alias("t")).select(column, "t.*")


def non_duplicates(tabs: DataFrame) -> DataFrame:
    """Tabs that are no duplicate of another."""
    return tabs.join(tabs.where("duplicate_of is not null").select("id"), "id", "left_anti")


def export_tables(tabs: DataFrame, groups: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tabs, groups, edges) of an export document: ids are positions, groups' ids their digits, members and ends that aren't known don't come out."""
    at = positions(tabs)
    t = tabs.join(at, "id").select(F.col("position").alias("id"), "url", "title", "domain", "canonical_url", "keywords", "simhash", group_number(F.col("group_id")).alias("group_id"))
    listed = groups.select(F.col("id").alias("group"), F.posexplode("tab_ids").alias("place", "id")).join(at, "id")
    members = listed.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "position"))), lambda x: x["position"]).alias("tab_ids"))
    places = positions(groups)
    g = groups.select("id", "label").join(places, "id").join(members, F.col("id") == F.col("group"), "left").select(F.col("position").alias("id"), "label", F.coalesce("tab_ids", F.array().cast("array<bigint>")).alias("tab_ids"))
    return t, g, reindex_export(tabs, edges)
