"""Navigations of a stream of browser events, with the state of a tab's session kept by key.

Late policy: events of a micro-batch are applied in the order of their event time; one that is older than what its session has already seen marks its address as visited but
neither emits nor moves the session. A closing ends the session; a session whose last event lies ``idle_ms`` behind the watermark is dropped.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text, urls
from ..operators.navigation import TRANSITIONS

OUT = "tab_id long, source_url string, target_url string, ts timestamp, transition_type string"
STATE = "visited string, last string, seen long"
MAX_OPEN = 100_000
ORDER = ["ts", "event", "canonical", "transition_type"]


def step(session: dict, event: str, canonical: str | None, transition: str | None, seen: int) -> tuple[str, str, str] | None:
    """Apply one event to a session {visited, last, seen}; returns (source, target, transition) where it is a navigation."""
    if event == "removed":
        session.update(visited=set(), last=None, seen=max(session["seen"], seen))
        return None
    if event == "before_navigate":  # the address that is left: it only opens a session that has shown none
        if session["last"] is None and canonical is not None:
            session["visited"].add(canonical)
            session.update(last=canonical, seen=max(session["seen"], seen))
        return None
    late = seen < session["seen"]
    known = canonical in session["visited"]
    session["visited"].add(canonical)
    if late:
        return None
    source, session["last"], session["seen"] = session["last"], canonical, seen
    if known or source is None or source == canonical:
        return None
    return source, canonical, transition if event == "committed" else "spa_navigation"


def _shown(events: DataFrame, seed: bool) -> DataFrame:
    left = (F.col("event") == "before_navigate") & (F.coalesce("frame_id", F.lit(0)) == 0) if seed else F.lit(False)
    committed = (F.col("event") == "committed") & (F.col("frame_id") == 0) & F.col("transition_type").isin(TRANSITIONS) & ~F.coalesce(F.array_contains("qualifiers", "forward_back"), F.lit(False))
    shown = urls.is_http(F.col("url")) & (committed | (F.col("event") == "updated") | left)
    rows = events.where(F.col("tab_id").isNotNull() & F.col("ts").isNotNull() & (shown | (F.col("event") == "removed")))
    return rows.select("tab_id", "ts", "event", F.when(F.col("event") != "removed", urls.canonical_url(F.col("url"))).alias("canonical"), "transition_type")


def navigation_stream(events: DataFrame, watermark: str = "10 minutes", idle_ms: int = 90 * 24 * 3600 * 1000, dedupe: bool = True, seed: bool = False, opened: DataFrame | None = None) -> DataFrame:
    """Stream of navigations (OUT) from a stream of browser events; rows delivered twice within the watermark count once.

    ``seed`` takes the addresses that tabs leave (before_navigate) into account. ``opened`` is a batch of tabs open at the start (tab_id, url): each opens its session."""
    initial = None
    if opened is not None:
        known = opened.where(urls.is_http(F.col("url")) & F.col("tab_id").isNotNull()).select("tab_id", urls.canonical_url(F.col("url")).alias("last")).groupBy("tab_id").agg(F.max("last").alias("last"))
        initial = known
    rows = _shown(events, seed).withWatermark("ts", watermark)
    if dedupe:
        rows = rows.dropDuplicatesWithinWatermark(["tab_id", "ts", "event", "canonical", "transition_type"])

    # The tabs that a browser has open: a list of bounded length.
    start = {} if initial is None else {r.tab_id: r.last for r in initial.limit(MAX_OPEN + 1).collect()}
    if len(start) > MAX_OPEN:
        raise ValueError(f"more than {MAX_OPEN} open tabs; replay them as updated events before the stream instead")

    def run(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        visited, last, seen = state.get if state.exists else ("[]", None, 0)
        if not state.exists and key[0] in start:
            visited, last = json.dumps([start[key[0]]]), start[key[0]]
        session = {"visited": set(json.loads(visited)), "last": last, "seen": seen}
        found = []
        batch = pd.concat(list(parts))
        for r in batch.sort_values(ORDER, na_position="first").itertuples(index=False):
            moved = step(session, r.event, r.canonical, r.transition_type, r.ts.value // 1000)
            if moved:
                found.append((key[0], moved[0], moved[1], r.ts, moved[2]))
        state.update((json.dumps(sorted(session["visited"])), session["last"], session["seen"]))
        state.setTimeoutTimestamp(max(session["seen"] // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(found, columns=["tab_id", "source_url", "target_url", "ts", "transition_type"])

    return rows.groupBy("tab_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def upsert_pages(path: str):
    """A foreachBatch function that merges captured pages (canonical_url, ts, ...) into a Parquet table of versions, newest row per page winning.

    A page that a browser tab (``browser_tab``, where the rows have one) shows takes the tab from the page it showed before. Every batch writes a new version beside the old one and moves a pointer file last, so a failed batch leaves the table as it was and a repeated one changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        current = read_version(batch.sparkSession, path)
        newest = batch.groupBy("canonical_url").agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        merged = newest if current is None else current.join(newest.select("canonical_url"), "canonical_url", "left_anti").unionByName(newest)
        if "browser_tab" in batch.columns:
            shown = merged.where("browser_tab is not null").groupBy("browser_tab").agg(F.max_by("canonical_url", F.struct("ts", "canonical_url")).alias("now"))
            merged = merged.join(shown, "browser_tab", "left").withColumn("browser_tab", F.when(F.col("now") == F.col("canonical_url"), F.col("browser_tab"))).select(*batch.columns)
        _put(merged, path, number)

    return write


def enrich_pages(path: str, keyword_count: int = 8, kept_chars: int = 5000):
    """A foreachBatch function for arriving contents (browser_tab, title, text, canonical_url, ts): the page its browser tab shows now gets title, text, keywords and simhash.

    Contents of a tab that shows no known page are dropped, as is all but the newest content of a tab in a batch. A canonical address that the page names replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        current = read_version(batch.sparkSession, path)
        if current is None:
            return
        got = batch.where("browser_tab is not null").groupBy("browser_tab").agg(F.max_by(F.struct("title", "text", "canonical_url"), "ts").alias("c"))
        met = current.join(got, "browser_tab", "left").withColumn("hit", F.col("c").isNotNull())
        met = met.withColumn("title", F.when(F.col("hit") & (F.coalesce("c.title", F.lit("")) != ""), F.col("c.title")).otherwise(F.col("title")))
        met = met.withColumn("text", F.when(F.col("hit"), F.substring(F.coalesce("c.text", F.lit("")), 1, kept_chars)).otherwise(F.col("text")))
        named = F.when(F.col("hit") & (F.coalesce("c.canonical_url", F.lit("")) != ""), urls.canonical_url(F.col("c.canonical_url"), "live"))
        met = met.withColumn("page", F.col("canonical_url")).withColumn("canonical_url", F.coalesce(named, F.col("canonical_url")))
        fresh = met.where("hit").select("page", text.tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), "text"), "live").alias("tokens"))
        words = text.keywords(fresh, "page", "tokens", keyword_count).select(F.col("id").alias("page"), F.col("keywords").alias("kw"))
        hashes = text.simhash(fresh, "page", "tokens", "live").select(F.col("id").alias("page"), F.col("simhash").alias("sh"))
        out = met.join(words, "page", "left").join(hashes, "page", "left")
        none = F.array().cast("array<string>")
        out = out.withColumn("keywords", F.when(F.col("hit"), F.coalesce("kw", none)).otherwise(F.col("keywords"))).withColumn("simhash", F.when(F.col("hit"), F.col("sh")).otherwise(F.col("simhash")))
        _put(out.select(*current.columns), path, number)

    return write


def _put(table: DataFrame, path: str, number: int) -> None:
    table.write.mode("overwrite").parquet(f"{path}/v={number:020d}")
    table.sparkSession.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").json(f"{path}/_pointer")


def read_version(spark, path: str) -> DataFrame | None:
    """The table as the last finished batch left it, None before the first."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    version = spark.read.schema("version long").json(f"{path}/_pointer").agg(F.max("version")).first()[0]
    return None if version is None else spark.read.parquet(f"{path}/v={version:020d}")
