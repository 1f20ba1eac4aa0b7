"""Navigations within tab sessions, as a batch query, and the edges made of them.

A session is what one browser tab shows until it is closed. Every first visit of an address in a session, other than the session's first, is a navigation from the address
before it. One tab may hold a large part of all events, so nothing is sorted per tab: running counts and previous rows are taken inside (tab, day) and carried from day
to day by one row per tab and day; first visits are a grouped minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint
from ..functions import urls

# The kinds of transitions that start a visit.
TRANSITIONS = ["link", "typed", "form_submit", "auto_bookmark", "generated"]
_ORDER = ["ts", "event", "canonical", "transition_type"]


def delivered_once(events: DataFrame) -> DataFrame:
    """Events without repeated deliveries (rows equal in all but the time of receipt)."""
    return events.drop("received_at").distinct()


def visits(events: DataFrame, dialect: str = "batch", seed: bool = False) -> DataFrame:
    """(tab_id, ts, event, canonical, transition_type, closed) of the events that show an address in a main frame, and of closings; with ``seed`` also of the addresses that are left (before_navigate)."""
    rows = delivered_once(events).where("tab_id is not null and ts is not null")
    committed = (F.col("event") == "committed") & (F.col("frame_id") == 0) & F.col("transition_type").isin(TRANSITIONS) & ~F.coalesce(F.array_contains("qualifiers", "forward_back"), F.lit(False))
    left = (F.col("event") == "before_navigate") & (F.coalesce("frame_id", F.lit(0)) == 0)
    shown = urls.is_http(F.col("url")) & (committed | (F.col("event") == "updated") | (left if seed else F.lit(False)))
    closed = F.col("event") == "removed"
    rows = rows.where(shown | closed)
    return rows.select("tab_id", "ts", "event", F.when(~closed, urls.canonical_url(F.col("url"), dialect)).alias("canonical"), "transition_type", closed.alias("closed"))


def first_visits(events: DataFrame, dialect: str = "batch", seed: bool = False) -> DataFrame:
    """(tab_id, session, source_url, target_url, ts, transition_type): one row per navigation.

    With ``seed`` the address that a tab leaves (before_navigate) opens a session that has shown none yet; in others it changes nothing."""
    rows = visits(events, dialect, seed).withColumn("day", F.to_date("ts"))
    in_day = Window.partitionBy("tab_id", "day").orderBy(*_ORDER)
    per_day = rows.groupBy("tab_id", "day").agg(F.sum(F.col("closed").cast("long")).alias("closings"))
    days = Window.partitionBy("tab_id").orderBy("day")
    before = per_day.select("tab_id", "day", (F.sum("closings").over(days) - F.col("closings")).alias("closed_before"))
    own = F.sum(F.col("closed").cast("long")).over(in_day) - F.col("closed").cast("long")
    numbered = rows.withColumn("closed_today", own).join(before, ["tab_id", "day"]).withColumn("session", F.col("closed_before") + F.col("closed_today")).where("not closed")
    place = F.struct(*_ORDER)
    if seed:
        opened = numbered.groupBy("tab_id", "session").agg(F.min(place).alias("opened"))
        numbered = numbered.join(opened, ["tab_id", "session"]).where((F.col("event") != "before_navigate") | (place == F.col("opened"))).drop("opened")
    last = numbered.groupBy("tab_id", "day").agg(F.max_by(F.struct("session", "canonical"), place).alias("last"))
    carried = last.select("tab_id", "day", F.lag("last").over(days).alias("carried"))
    lagged = numbered.withColumn("here", F.lag(F.struct("session", "canonical")).over(in_day)).join(carried, ["tab_id", "day"])
    previous = F.coalesce("here", "carried")
    lagged = lagged.withColumn("source_url", F.when(previous["session"] == F.col("session"), previous["canonical"]))
    first = lagged.groupBy("tab_id", "session", "canonical").agg(F.min(F.struct(*_ORDER, "source_url")).alias("f"))
    found = first.where("f.source_url is not null and f.source_url <> canonical")
    kind = F.when(F.col("f.event") == "committed", F.col("f.transition_type")).otherwise("spa_navigation")
    return found.select("tab_id", "session", F.col("f.source_url").alias("source_url"), F.col("canonical").alias("target_url"), F.col("f.ts").alias("ts"), kind.alias("transition_type"))


def url_map(tabs: DataFrame) -> DataFrame:
    """(address, tab_id): canonical and raw addresses, the tab written last winning."""
    rows = tabs.where("id is not null")
    both = rows.select(F.coalesce("canonical_url", "url").alias("address"), "id").unionByName(rows.select(F.col("url").alias("address"), "id"))
    return both.where("address is not null").groupBy("address").agg(F.max("id").alias("tab_id"))


def navigation_edges(navigations: DataFrame, tabs: DataFrame) -> DataFrame:
    """(source, target, weight, reason, ts) where both addresses are known and belong to different tabs."""
    known = url_map(tabs)
    a, b = known.select(F.col("address").alias("source_url"), F.col("tab_id").alias("source")), known.select(F.col("address").alias("target_url"), F.col("tab_id").alias("target"))
    met = navigations.select("source_url", "target_url", "ts").join(a, "source_url").join(b, "target_url").where("source <> target")
    return met.select("source", "target", F.lit(1.0).alias("weight"), F.lit("navigation").alias("reason"), "ts")


def merge_into(similar: DataFrame, moves: DataFrame, most: int = 1_000_000) -> DataFrame:
    """What ``merge_edges`` makes of both, where ``similar`` has each unordered pair once, the smaller end first: navigations are merged among themselves and take the place of what they meet.

    Up to ``most`` of them are sent to all tasks, so that the similar pairs, which may be quadratic, aren't shuffled."""
    best = checkpoint(merge_edges(moves))
    pairs = best.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    left = similar.where("source <> target").join(F.broadcast(pairs) if best.count() <= most else pairs, ["source", "target"], "left_anti")
    return best.unionByName(left.select(*best.columns))


def merge_edges(edges: DataFrame, strict_live: bool = False) -> DataFrame:
    """One edge per unordered pair: a navigation before a similarity, the earliest navigation first. ``strict_live`` also keeps a similarity edge whose
    navigation runs the other way, as the live extension does."""
    rows = edges.where("source is not null and target is not null and source <> target")
    order = F.struct((F.col("reason") != "navigation").alias("o"), F.coalesce(F.col("ts").cast("double"), F.lit(0.0)).alias("t"), "source", "target", F.col("reason").alias("r"), -F.coalesce("weight", F.lit(0.0)))
    best = rows.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min_by(F.struct("source", "target", "weight", "reason", "ts"), order).alias("e")).select("e.*")
    if not strict_live:
        return best
    turned = best.where("reason = 'navigation'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    similar = rows.where("reason <> 'navigation'").join(turned, ["source", "target"], "left_semi").groupBy("source", "target").agg(F.max_by(F.struct("weight", "reason", "ts"), F.coalesce("weight", F.lit(0.0))).alias("e"))
    return best.unionByName(similar.select("source", "target", "e.*"))
