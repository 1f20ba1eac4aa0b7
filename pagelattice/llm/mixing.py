"""Problem 8: combining sources to target weights with a low-discrepancy schedule.

The total is given, or the largest at which no source has to be repeated more than its cap. A source that a given total asks for more than its tokens times its cap gives all it may and falls short; the report says by how much. The total is cut into equal-token slots, and slot i goes to the source whose interval of
cumulative weights holds the golden-ratio point frac(i * phi), so every stretch of the schedule has nearly the target shares. The slots of a source are ranked,
and its r-th slot takes the r-th block of equal size of its stream: its documents shuffled by a seeded hash, once per epoch, end to end. A document is never cut: it belongs to the
block in which it begins. The last, partial epoch is a prefix of the shuffled documents that fit the rest of the source's goal; what then is still missing is closed by
``closers`` documents at most, each the longest unused one that fits.

Places in a stream come from two levels of sums (per hash bucket of about ``bucket_rows`` documents, then inside a bucket), so no source is ever sorted in one
task; a slot holds at most ``most_slot_tokens`` tokens, so the schedule stays as fine when the corpus grows, and is ranked in ranges of slots. Only a few rows per target reach the driver.

Defined cases: sources are compared trimmed and in lower case; documents without id, source, text or tokens can't be chosen; targets that are null, not positive or
without documents reach 0 and the others share the whole by their weights; a null or negative max_repeats counts as 1; targets given
twice add up, with the smaller cap; repeated document rows count as documents of their own; empty tables give an empty mixture; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, squeezed
from .tokens import DEFAULT_TOKENIZER, measured

PHI = 0.6180339887498949


def source_name(column) -> object:
    return F.lower(squeezed(column))


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row per source."""
    rows = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("w"), F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1))).alias("r")).where("source is not null")
    return rows.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("w"))), F.lit(0.0)).alias("target_share"), F.min("r").cast("int").alias("max_repeats"))


def targeted_documents(documents: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, source, tokens) of the documents that may be chosen, measured once."""
    rows = documents.withColumn("source", source_name(F.col("source")))
    wanted = rows.join(clean_targets(targets).where("target_share > 0").select("source"), "source", "left_semi")
    return checkpoint(measured(wanted, "doc_id", "text", keep=("source",), tokenizer=tokenizer).where("tokens > 0").select("id", "source", "tokens"))


def plan_sources(sized: DataFrame, targets: DataFrame, slots: int, max_targets: int = 10_000, total: int | None = None, most_slot_tokens: int = 1 << 20) -> tuple[list[dict], int]:
    """(per source: source, share, tokens, documents, goal; tokens per slot). The goals are what each source has to give."""
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = [r.asDict() for r in clean_targets(targets).join(have, "source").orderBy("source").limit(max_targets + 1).collect()]
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    whole = sum(r["target_share"] for r in rows)
    if not rows or whole <= 0:
        return [], 1
    for r in rows:
        r["share"] = r["target_share"] / whole
    whole = total if total is not None else min(r["tokens"] * r["max_repeats"] / r["share"] for r in rows)
    for r in rows:
        r["asked"] = int(round(whole * r["share"]))
        r["goal"] = min(r["asked"], r["tokens"] * r["max_repeats"])
    return rows, min(max(1, -(-int(whole) // slots)), most_slot_tokens)


def schedule(spark, rows: list[dict], slot_tokens: int) -> DataFrame:
    """(slot, source, rank): the source of every slot and the slot's rank among those of its source; the weights are what the sources can give."""
    given = sum(r["goal"] for r in rows)
    count = max(1, -(-given // slot_tokens))
    point = (F.col("id") + 1) * F.lit(PHI)
    frac, chosen, upto = point - F.floor(point), None, 0.0
    for r in rows[:-1]:
        upto += r["goal"] / max(1, given)
        chosen = F.when(frac < upto, r["source"]) if chosen is None else chosen.when(frac < upto, r["source"])
    source = F.lit(rows[0]["source"]) if chosen is None else chosen.otherwise(rows[-1]["source"])
    slots = spark.range(count).select(F.col("id").alias("slot"), source.alias("source"), F.shiftright("id", 16).alias("range"))
    counts = slots.groupBy("source", "range").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("source").orderBy("range")) - F.col("c")).select("source", "range", "before")
    inside = F.row_number().over(Window.partitionBy("source", "range").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(before, ["source", "range"]).select("slot", "source", (F.col("before") + F.col("inside")).alias("rank"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows (source, epoch, id, tokens, h, buckets) with the number of tokens before each in its source's epoch."""
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) * F.col("buckets")).cast("long"))
    sums = rows.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("s")).select("source", "epoch", "bucket", "before")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["source", "epoch", "bucket"])
    return rows.withColumn("start", F.col("before") + F.col("within"))


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, slots: int = 65_536, bucket_rows: int = 20_000, seed: int = 11, closers: int = 5, total: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """(slot, source, doc_id, epoch, tokens): the chosen documents, a row for every repeat, in the order of the schedule's slots."""
    spark = documents.sparkSession
    sized = targeted_documents(documents, targets, tokenizer) if sized is None else sized
    rows, slot_tokens = plan_sources(sized, targets, slots, total=total)
    rows = [r for r in rows if r["goal"] > 0]
    if not rows:
        return spark.createDataFrame([], "slot long, source string, doc_id long, epoch int, tokens long")
    for r in rows:
        r["full"], r["rest"] = divmod(r["goal"], r["tokens"])
        r["buckets"] = max(1, -(-r["documents"] // bucket_rows))
    plan = F.broadcast(spark.createDataFrame([(r["source"], r["tokens"], r["full"], r["rest"], r["buckets"]) for r in rows], "source string, whole long, full int, rest long, buckets long"))
    streams = sized.join(plan, "source")
    key = lambda df: df.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "id"))
    whole = key(streams.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))))
    partial = key(streams.where("tokens <= rest").withColumn("epoch", F.col("full")))
    part = checkpoint(_placed(partial).select("source", "epoch", "id", "tokens", "whole", "rest", "start", (F.col("start") + F.col("tokens") <= F.col("rest")).alias("in_prefix")))
    missing = {r["source"]: r["rest"] for r in rows}
    for r in part.where("in_prefix").groupBy("source").agg(F.sum("tokens").alias("s")).collect():
        missing[r["source"]] -= r["s"]
    extra: list[tuple] = []
    for _ in range(closers):
        gaps = spark.createDataFrame([(k, g) for k, g in missing.items() if g > 0], "source string, gap long")
        used = spark.createDataFrame([(x[0], x[1]) for x in extra], "source string, id long")
        fitting = part.where("not in_prefix").join(F.broadcast(gaps), "source").where("tokens <= gap").join(F.broadcast(used), ["source", "id"], "left_anti")
        best = fitting.groupBy("source").agg(F.max_by(F.struct("id", "epoch", "tokens", "whole", "rest"), F.struct("tokens", -F.col("id"))).alias("x")).collect()
        if not best:
            break
        for r in best:
            extra.append((r["source"], r.x["id"], r.x["epoch"], r.x["tokens"], r.x["epoch"] * r.x["whole"] + r.x["rest"] - missing[r["source"]]))
            missing[r["source"]] -= r.x["tokens"]
    columns = ["source", "id", "epoch", "tokens", "start"]
    offset = F.col("epoch") * F.col("whole") + F.col("start")
    taken = _placed(whole).withColumn("start", offset).select(*columns).unionByName(part.where("in_prefix").withColumn("start", offset).select(*columns))
    taken = taken.unionByName(spark.createDataFrame(extra, "source string, id long, epoch int, tokens long, start long"))
    order = schedule(spark, rows, slot_tokens)
    last = order.groupBy("source").agg(F.max("rank").alias("last"))
    ranked = taken.join(F.broadcast(last), "source").withColumn("rank", F.least(F.floor(F.col("start") / F.lit(slot_tokens)), F.col("last")))
    return ranked.join(order, ["source", "rank"]).select("slot", "source", F.col("id").alias("doc_id"), "epoch", "tokens")


def reached_shares(documents: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, total: int | None = None) -> DataFrame:
    """(source, target_share, reached_share, asked_tokens, tokens, missing_tokens, documents, most_repeats, max_repeats) for every target; asked is its part of the total."""
    sized = targeted_documents(documents, targets, tokenizer)
    rows, _ = plan_sources(sized, targets, 1, total=total)
    asked = documents.sparkSession.createDataFrame([(r["source"], r["asked"]) for r in rows], "source string, asked long")  # a row per target
    chosen = mixture(documents, targets, tokenizer, total=total, sized=sized)
    by_doc = chosen.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("repeats"))
    reached = by_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    out = clean_targets(targets).join(reached, "source", "left").join(F.broadcast(asked), "source", "left").withColumn("whole", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # targets only
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0))
    return out.select("source", "target_share", share.alias("reached_share"), zero("asked").alias("asked_tokens"), zero("tokens").alias("tokens"), (zero("asked") - zero("tokens")).alias("missing_tokens"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"), "max_repeats")


def available_tokens(sized: DataFrame) -> int:
    """All tokens of the targeted sources, each document once."""
    return sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
