"""Problem 7: filling containers of fixed capacity, as vector bin packing with the dot-product heuristic.

A piece demands a vector (tokens, one segment, loss-bearing tokens) and a container offers (capacity, max_segments, max_loss). Containers are filled one after
another: of all pieces that still fit in every dimension the one with the largest weighted dot product of its demand and the container's remaining
room goes in, the weights being the mean demand over the mean offer. Pieces are kept in lists by tokens, sorted by loss, so a choice looks at a few lists only.
Only a document longer than the capacity is split: into full pieces and one rest.

Pieces are sharded by a hash into shards of about ``shard_rows`` pieces, whatever the cluster and however long the documents, and a shard packs by itself; containers that stay
below ``reopen_below`` of the capacity are opened again and their pieces are packed once more, in shards of the same size. No shuffle ever carries text.

Defined cases: null and empty texts (no tokens) need no place; null ids take no part; a repeated id is packed once per row; ties go to the smaller id; an empty
table gives an empty result; further columns are ignored. Plans with a null or non-positive capacity are refused.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .tokens import DEFAULT_TOKENIZER, measured

PIECES = "plan_id int, capacity long, id long, piece int, start_token long, tokens long, loss_tokens long"
PACKED = PIECES + ", bin long, filled long"


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: int) -> np.ndarray:
    """Container of every piece (numbered from 0); every piece must fit an empty container."""
    n = len(tokens)
    where = np.full(n, -1, np.int64)
    if not n:
        return where
    if tokens.max() > capacity or loss.max() > max_loss or max_segments < 1:
        raise ValueError("a piece doesn't fit an empty container")
    order = np.lexsort((loss, tokens))
    sizes, first = np.unique(tokens[order], return_index=True)
    bounds = np.append(first, n)
    lists = [order[bounds[k] : bounds[k + 1]].tolist() for k in range(len(sizes))]
    losses = [loss[x].tolist() for x in lists]
    sizes = sizes.tolist()
    parent = list(range(len(sizes) + 1))  # union-find over emptied lists: list k is number k + 1, 0 is none

    def live(k: int) -> int:
        k += 1
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k - 1

    weight_t = tokens.mean() / capacity / capacity
    weight_l = loss.mean() / max_loss / max_loss
    container, left = -1, n
    while left:
        container += 1
        room, room_l, segments = capacity, max_loss, max_segments
        while segments and left:
            k = live(bisect_right(sizes, room) - 1)
            best, at, pos = -1.0, -1, -1
            while k >= 0:
                size = sizes[k]
                most = weight_t * size * room + weight_l * min(size, room_l) * room_l
                if most <= best:
                    break
                j = bisect_right(losses[k], room_l) - 1
                if j >= 0:
                    score = weight_t * size * room + weight_l * losses[k][j] * room_l
                    if score > best:
                        best, at, pos = score, k, j
                k = live(k - 1) if k else -1
            if at < 0:
                break
            piece = lists[at].pop(pos)
            room, room_l, segments, left = room - sizes[at], room_l - losses[at].pop(pos), segments - 1, left - 1
            if not lists[at]:
                parent[at + 1] = at
            where[piece] = container
    return where


def _packer(segment_tokens: int, loss_share: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "piece", "start_token"], ignore_index=True)
        capacity = int(part["capacity"].iloc[0])
        where = pack(part["tokens"].to_numpy(), part["loss_tokens"].to_numpy(), capacity, max(8, capacity // segment_tokens), max(1, int(capacity * loss_share)))
        filled = np.bincount(where, part["tokens"].to_numpy())[where].astype(np.int64)
        return part[["plan_id", "capacity", "id", "piece", "start_token", "tokens", "loss_tokens"]].assign(bin=where, filled=filled)

    return run


def split_pieces(items: DataFrame, plans: list[tuple[int, int]], loss_share: float) -> DataFrame:
    """Pieces of every document for every plan; of a document over the capacity the loss-bearing tokens are its last ones.

    A piece with more loss-bearing tokens than a container takes is a document beyond the capacity in that dimension, and is split there too."""
    offers = F.array(*[F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(c).cast("long").alias("capacity")) for p, c in plans])
    rows = items.where("tokens > 0").select("id", "tokens", "loss_tokens", F.explode(offers).alias("plan")).select("id", F.col("plan.*"), F.col("tokens").alias("total"), F.col("loss_tokens").alias("loss"))
    most = F.greatest(F.lit(1), F.floor(F.col("capacity") * F.lit(loss_share))).cast("long")
    step = F.when((F.col("total") > F.col("capacity")) | (F.col("loss") > most), F.least("capacity", most)).otherwise(F.col("capacity"))
    count = F.ceil(F.col("total") / step).cast("int")
    pieces = rows.withColumn("step", step).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece") * F.col("step")
    end = F.least(start + F.col("step"), F.col("total"))
    loss = F.greatest(F.lit(0), end - F.greatest(start, F.col("total") - F.col("loss")))
    return pieces.select("plan_id", "capacity", "id", "piece", start.alias("start_token"), (end - start).alias("tokens"), loss.cast("long").alias("loss_tokens"))


def packed_pieces(documents: DataFrame, plans: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, shard_rows: int = 16_384, segment_tokens: int = 32, loss_share: float = 1.0, reopen_below: float = 0.98, max_plans: int = 64) -> DataFrame:
    """(plan_id, container_id, doc_id, piece, start_token, tokens, loss_tokens): the content of all containers."""
    chosen = [(r.plan_id, r.capacity_tokens) for r in plans.select("plan_id", "capacity_tokens").distinct().orderBy("plan_id").limit(max_plans + 1).collect()]
    if len(chosen) > max_plans or any(p is None or c is None or c <= 0 for p, c in chosen):
        raise ValueError(f"plans must be at most {max_plans}, each with an id and a positive capacity")
    empty = documents.sparkSession.createDataFrame([], "plan_id int, container_id long, doc_id long, piece int, start_token long, tokens long, loss_tokens long")
    if not chosen:
        return empty
    items = checkpoint(measured(documents, "doc_id", "text", tokenizer=tokenizer))  # sizes only, read twice
    pieces = split_pieces(items, chosen, loss_share)

    def sharded(rows: DataFrame, key: Column) -> DataFrame:
        """rows with a shard per plan, of about ``shard_rows`` pieces each however many a document has."""
        counts = {r.plan_id: r.n for r in rows.groupBy("plan_id").agg(F.count("*").alias("n")).collect()}
        shards = F.create_map(*[F.lit(x) for p, n in counts.items() for x in (p, max(1, round(n / shard_rows)))]) if counts else F.create_map(F.lit(0), F.lit(1))
        return rows.withColumn("shard", F.pmod(key, shards[F.col("plan_id")]).cast("int"))

    run = _packer(segment_tokens, loss_share)
    schema = PACKED + ", shard int"

    def first(part: pd.DataFrame) -> pd.DataFrame:
        return run(part).assign(shard=part["shard"].iloc[0])

    once = checkpoint(sharded(pieces, F.xxhash64("id", "piece")).groupBy("plan_id", "shard").applyInPandas(first, schema))
    closed = F.col("filled") >= F.col("capacity") * F.lit(reopen_below)
    done = once.where(closed).select("*", F.lit(0).alias("level"))
    # Shards that were packed apart are mixed: a container's pieces may go to any of the new shards.
    rest = sharded(once.where(~closed).drop("shard", "bin", "filled"), F.xxhash64(F.lit(1), "id", "piece")).groupBy("plan_id", "shard").applyInPandas(first, schema).select("*", F.lit(1).alias("level"))
    # Numbers are unique in a plan: level, shard and number in the shard.
    number = F.shiftleft(F.col("level").cast("long"), 60) + F.shiftleft(F.col("shard").cast("long"), 32) + F.col("bin")
    return done.unionByName(rest).select("plan_id", number.alias("container_id"), F.col("id").alias("doc_id"), "piece", "start_token", "tokens", "loss_tokens")


def containers(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, container_id, segments, tokens, loss_tokens, unused) of every container."""
    filled = packed.groupBy("plan_id", "container_id").agg(F.count("*").alias("segments"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
    return filled.join(plans.select("plan_id", "capacity_tokens").distinct(), "plan_id").select("plan_id", "container_id", "segments", "tokens", "loss_tokens", (F.col("capacity_tokens") - F.col("tokens")).alias("unused"))


def faults(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, documents, overfull, misplaced, split): how many documents a plan holds, and what must be 0: containers beyond the capacity, pieces that overlap or leave a gap in their document, documents within the capacity that were split."""
    by_doc = packed.groupBy("plan_id", "doc_id").agg(F.count("*").alias("pieces"), F.count_distinct("start_token").alias("starts"), F.sum("tokens").alias("tokens"), F.max(F.col("start_token") + F.col("tokens")).alias("end"))
    by_doc = by_doc.join(plans.select("plan_id", "capacity_tokens").distinct(), "plan_id")
    wrong = (F.col("starts") != F.col("pieces")) | (F.col("end") != F.col("tokens"))
    docs = by_doc.groupBy("plan_id").agg(F.count("*").alias("documents"), F.count_if(wrong).alias("misplaced"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split"))
    over = containers(packed, plans).groupBy("plan_id").agg(F.count_if(F.col("unused") < 0).alias("overfull"))
    return docs.join(over, "plan_id").select("plan_id", "documents", "overfull", "misplaced", "split")
