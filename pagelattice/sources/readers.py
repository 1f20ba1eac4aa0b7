"""Readers of window lists, session files, graph documents and page stores. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.prefix import running_before
from .lz4 import decode_session

WINDOWS = "browser string, windowId long, tabs array<struct<title: string, url: string>>"
SESSION = "windows array<struct<tabs: array<struct<index: int, entries: array<struct<url: string, title: string>>>>>>"
GRAPH = (
    "schema_version int, generated_at string, source string, stats map<string, long>, "
    "tabs array<struct<id: long, url: string, title: string, browser: string, window_id: long, domain: string, canonical_url: string, summary: string, summary_source: string, text_excerpt: string, "
    "keywords: array<string>, simhash: string, error: string, duplicate_of: long, aliases: array<string>, group_id: long>>, "
    "groups array<struct<id: long, label: string, tab_ids: array<long>, size: int>>, edges array<struct<source: long, target: long, weight: double, reason: string, timestamp: long>>"
)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Window lists: one JSON array or object per file."""
    return spark.read.schema(WINDOWS).option("multiLine", True).json(path)


def backup_path(path: str) -> str:
    """A file itself; of a folder tabs_backup.json or else its first JSON file."""
    p = Path(path)
    if p.is_file():
        return str(p)
    named = p / "tabs_backup.json"
    found = [named] if named.exists() else sorted(p.glob("*.json"))
    if not found:
        raise FileNotFoundError(f"no backup in {path}")
    return str(found[0])


def _stripped(column: str):
    """Text without white space of any kind at its ends, null giving an empty text."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def flatten_windows(windows: DataFrame) -> DataFrame:
    """(id, url, title, browser, window_id, domain, canonical_url): tabs with an address, numbered densely in the order of windows and tabs.

    ``windows`` may carry ``window_pos``; without it the order of the rows is taken. Numbers come from counts per window, not from one sort in one task."""
    rows = windows if "window_pos" in windows.columns else windows.withColumn("window_pos", F.monotonically_increasing_id())
    tabs = rows.select("window_pos", "browser", F.col("windowId").alias("window_id"), F.posexplode("tabs").alias("pos", "tab"))
    tabs = tabs.select("window_pos", "browser", "window_id", "pos", _stripped("tab.url").alias("url"), _stripped("tab.title").alias("title")).where("url <> ''")
    per_window = running_before(tabs.groupBy("window_pos").agg(F.count("*").alias("c")), "window_pos", "c", "before").select("window_pos", "before")
    place = F.row_number().over(Window.partitionBy("window_pos").orderBy("pos")) - 1
    numbered = tabs.withColumn("place", place).join(per_window, "window_pos")
    return numbered.select((F.col("before") + F.col("place")).alias("id"), "url", "title", "browser", "window_id", urls.domain(F.col("url")).alias("domain"), urls.canonical_url(F.col("url")).alias("canonical_url"))


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """(profile, path, modificationTime, content) of the newest session file per profile folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonlz4,baklz4}*").load(root)
    profile = F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), r"/sessionstore-backups$", "")
    named = files.where(F.col("path").rlike(r"/(recovery|previous|upgrade[^/]*|sessionstore)\.(jsonlz4|baklz4)[^/]*$"))
    return named.groupBy(profile.alias("profile")).agg(F.max_by(F.struct("path", "modificationTime", "content"), F.struct("modificationTime", "path")).alias("f")).select("profile", "f.*")


def newest_profile(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("modificationTime"), "path").limit(1)


def read_sessions(sessions: DataFrame) -> DataFrame:
    """Windows (browser, windowId, tabs, error) of session files; of every tab the history entry it shows."""

    @F.pandas_udf("struct<text: string, error: string>")
    def decoded(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            try:
                out.append((decode_session(data), None))
            except (ValueError, UnicodeDecodeError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["text", "error"])

    rows = sessions.withColumn("d", decoded("content")).withColumn("s", F.from_json("d.text", SESSION))
    shown = lambda t: F.when(F.coalesce(t["index"], F.lit(1)).between(1, F.coalesce(F.size(t["entries"]), F.lit(0))), F.try_element_at(t["entries"], F.coalesce(t["index"], F.lit(1))))
    entries = lambda w: F.filter(F.transform(w["tabs"], shown), lambda e: e.isNotNull() & (e["url"] != ""))
    tabs = lambda w: F.transform(entries(w), lambda e: F.struct(F.coalesce(e["title"], F.lit("")).alias("title"), e["url"].alias("url")))
    windows = rows.select(F.explode_outer("s.windows").alias("w"), "d.error").select(F.lit("firefox").alias("browser"), F.lit(None).cast("long").alias("windowId"), F.when(F.col("w").isNotNull(), tabs(F.col("w"))).alias("tabs"), "error")
    return windows.where("size(tabs) > 0 or error is not null")


def union_windows(parts: list[DataFrame]) -> DataFrame:
    """All windows of several browsers; repeats stay."""
    out = parts[0].select("browser", "windowId", "tabs")
    for p in parts[1:]:
        out = out.unionByName(p.select("browser", "windowId", "tabs"))
    return out


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tabs, groups, edges) of a graph document; hashes are read as unsigned text and kept as BIGINT in two's complement."""
    doc = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    tabs = doc.select(F.explode("tabs").alias("t")).select("t.*")
    groups, edges = doc.select(F.explode("groups").alias("g")).select("g.*"), doc.select(F.explode("edges").alias("e")).select("e.*")
    return tabs.withColumn("simhash", signed(F.col("simhash"))), groups, edges.withColumn("ts", F.timestamp_millis("timestamp")).drop("timestamp")


def read_graph_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tabs, groups, edges) of a folder of JSON lines as ``write_graph`` leaves it for large graphs."""
    kinds = {f.name: f.dataType.elementType for f in spark.createDataFrame([], GRAPH).schema if f.name in ("tabs", "groups", "edges")}
    tabs, groups, edges = (spark.read.schema(kinds[name]).json(f"{folder}/{name}") for name in ("tabs", "groups", "edges"))
    return tabs.withColumn("simhash", signed(F.col("simhash"))), groups, edges.withColumn("ts", F.timestamp_millis("timestamp")).drop("timestamp")


def signed(simhash):
    """A hash in unsigned decimal text as BIGINT in two's complement."""
    whole = simhash.cast("decimal(20,0)")
    return F.when(whole >= F.lit("9223372036854775808").cast("decimal(20,0)"), whole - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(whole).cast("long")


def unsigned(simhash) -> object:
    """A hash as unsigned decimal text."""
    whole = simhash.cast("decimal(20,0)")
    return F.when(simhash < 0, whole + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(whole).cast("string")


def write_graph(tabs: DataFrame, groups: DataFrame, edges: DataFrame, path: str, generated_at: str, source: str = "pagelattice", max_rows: int = 300_000) -> str:
    """One JSON document for graphs that a browser can show; beyond ``max_rows`` tabs and edges, which no driver should hold, a folder of JSON lines per table (``path``.d), written by the executors. Returns where it is."""
    from ..operators.graph_views import graph_stats

    shown = tabs.drop("tokens", "embedding").withColumn("simhash", unsigned(F.col("simhash")))
    stats = graph_stats(tabs, groups, edges).first().asDict()
    head = {"schema_version": 1, "generated_at": generated_at, "source": source, "stats": stats}
    if stats["tab_count"] + stats["edge_count"] > max_rows:
        spark = tabs.sparkSession
        for name, table in (("tabs", shown), ("groups", groups), ("edges", edges), ("head", spark.createDataFrame([(json.dumps(head),)], "document string"))):
            table.write.mode("overwrite").json(f"{path}.d/{name}")
        return f"{path}.d"
    as_json = lambda df: [json.loads(x) for x in df.toJSON().toLocalIterator()]
    doc = {**head, "tabs": as_json(shown.orderBy("id")), "groups": as_json(groups.orderBy("id")), "edges": as_json(edges.orderBy("source", "target"))}
    put_text(tabs.sparkSession, path, json.dumps(doc, ensure_ascii=False, indent=2))
    return path


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one file wherever the cluster's file systems can, folders included."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def join_pages(tabs: DataFrame, pages: DataFrame) -> DataFrame:
    """Tabs with the stored html of their address; error where there is none. Stands for fetching."""
    stored = pages.groupBy("url").agg(F.first("html", ignorenulls=True).alias("html"))
    missing = F.when(~urls.is_http(F.col("url")), "unsupported_url").when(F.col("html").isNull(), "fetch_failed: not stored")
    return tabs.join(stored, "url", "left").withColumn("error", missing)


def fetch_pages(tabs: DataFrame, fetch, partitions: int = 64) -> DataFrame:
    """(url, html, error) by ``fetch(url) -> html``, one call per distinct http(s) address, a bounded number of partitions at a time."""
    wanted = tabs.where(urls.is_http(F.col("url"))).select("url").distinct().repartition(partitions, "url")

    def run(batches):
        for batch in batches:
            html, errors = [], []
            for url in batch["url"]:
                try:
                    html.append(fetch(url))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 — any failure of a page is that page's error
                    html.append(None)
                    errors.append(f"fetch_failed: {e}")
            yield pd.DataFrame({"url": batch["url"], "html": html, "error": errors})

    return wanted.mapInPandas(run, "url string, html string, error string")


def is_html(content_type: str | None) -> bool:
    """Whether a content type says that a page is HTML."""
    kind = (content_type or "").lower()
    return "text/html" in kind or "application/xhtml+xml" in kind


def http_fetcher(timeout: int = 20, user_agent: str | None = None):
    """fetch(url) -> html for ``fetch_pages``, by the standard library: other content types give an empty text, failures raise."""

    def fetch(url: str) -> str:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": user_agent} if user_agent else {}), timeout=timeout) as answer:  # noqa: S310 — only http(s) addresses reach this
            if not is_html(answer.headers.get("content-type")):
                return ""
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")

    return fetch


def open_tabs(tabs: DataFrame) -> DataFrame:
    """(canonical_url, url, title, domain, browser_tab): the snapshot of tabs (tab_id, url, title) open at the start, http(s) only, one row per page; the tab given last shows it."""
    rows = tabs.where(urls.is_http(F.col("url"))).select(urls.canonical_url(F.col("url"), "live").alias("canonical_url"), "url", "title", urls.domain(F.col("url"), "live").alias("domain"), F.col("tab_id").alias("browser_tab"))
    return rows.groupBy("canonical_url").agg(F.max_by(F.struct("url", "title", "domain", "browser_tab"), "browser_tab").alias("p")).select("canonical_url", "p.*")


def read_some(sources: list) -> tuple[list[DataFrame], list[str]]:
    """What several sources (functions without arguments that give a DataFrame) give, and the errors of those that fail: one browser's failure doesn't stop the others."""
    found, errors = [], []
    for source in sources:
        try:
            found.append(source())
        except Exception as e:  # noqa: BLE001 — any failure of a source is that source's error
            errors.append(str(e))
    return found, errors
