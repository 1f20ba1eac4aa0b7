"""Text functions as column expressions: tokens, hashes, similarity of sets, summaries.

Two dialects exist. ``batch`` keeps tokens of three letters and more and hashes them with MD5; ``live`` keeps four and more, drops further
words and anything that looks like a number or code, and uses two 32-bit hashes. Their hashes aren't comparable.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no tokens.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until "
    "up very was we were what when where which while who whom why with would you your yours yourself yourselves"
).split()
# Further English words of the live dialect.
LIVE_STOPWORDS = (
    "get got also like new one two use way well will even back make want see know take come could good look think say much really still thing things need first "
    "going right something using best every find give many made"
).split()


def tokens(text: Column, dialect: str = "batch", extra_stopwords: Sequence[str] = ()) -> Column:
    """ARRAY<STRING> of the tokens of a text in order, null and empty texts giving none. The live dialect's web vocabulary is ``extra_stopwords``."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    stop = STOPWORDS + (LIVE_STOPWORDS if dialect == "live" else []) + list(extra_stopwords)
    least = 4 if dialect == "live" else 3
    kept = F.filter(words, lambda t: (F.length(t) >= least) & ~t.isin(stop))
    return F.filter(kept, lambda t: ~is_code(t)) if dialect == "live" else kept


def is_code(token: Column) -> Column:
    """Whether a token is a number, a hexadecimal code, mostly digits or one repeated character."""
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    return token.rlike("^[0-9]+$") | (token.rlike("^[0-9a-f]+$") & (F.length(token) >= 6)) | (digits > F.length(token) * 0.4) | token.rlike(r"^(.)\1+$")


def md5_hash64(token: Column) -> Column:
    """The first eight bytes of the MD5 digest as BIGINT (two's complement of the big-endian unsigned value)."""
    half = lambda at: F.conv(F.substring(F.md5(token), at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def live_hash64(token: Column) -> Column:
    """Two 32-bit hashes side by side; the first multiplies in double precision and so loses low bits, as its origin does."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    u32 = lambda c: c.bitwiseAND(F.lit(4294967295))
    signed = lambda c: F.when(c >= 2147483648, c - F.lit(4294967296)).otherwise(c)
    high = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: u32((signed(h.bitwiseXOR(c.cast("long"))).cast("double") * F.lit(16777619.0)).cast("long")))
    low = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: u32((u32(h) * 33).bitwiseXOR(c.cast("long"))))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _md5_words(tokens: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(md5(t.encode()).digest()[:8], "big") for t in tokens], np.uint64)


def _live_words(tokens: list[str]) -> np.ndarray:
    out = []
    for t in tokens:
        high, low = 2166136261, 5381
        for c in t.encode():
            x = high ^ c
            high = int(float(x - 4294967296 if x >= 2147483648 else x) * 16777619.0) & 4294967295
            low = (low * 33 & 4294967295) ^ c
        out.append(high << 32 | low)
    return np.array(out, np.uint64)


def _counted(batch: pa.RecordBatch):
    """(rows, tokens, row, token, count, first place) of the different tokens of every row of (id, tokens), in the order of rows and tokens."""
    lists = batch.column(1)
    flat = lists.flatten().dictionary_encode()
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = np.asarray(flat.indices.is_valid())
    row, place, code = row[known], place[known], flat.indices.drop_null().to_numpy()
    key, first, count = np.unique(row * max(1, len(flat.dictionary)) + code, return_index=True, return_counts=True)
    return len(lists), flat.dictionary.to_pylist(), key // max(1, len(flat.dictionary)), key % max(1, len(flat.dictionary)), count, place[first]


def _slices(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _by_row(rows: DataFrame, id_col: str, tokens_col: str, run, columns: str) -> DataFrame:
    kind = rows.select(F.col(id_col)).schema[0].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens")).mapInArrow(run, f"id {kind}, {columns}")


def simhash(rows: DataFrame, id_col: str, tokens_col: str, dialect: str = "batch") -> DataFrame:
    """(id, simhash) of every row: sign of 64 counters over all token occurrences; null for rows without tokens, and a counter of zero gives bit 0.

    All tokens of a row lie in it, so nothing is shuffled; each distinct token of a few hundred rows is hashed once."""
    hashed = _md5_words if dialect == "batch" else _live_words

    def run(batches):
        for part in _slices(batches):
            n, tokens, row, token, count, _ = _counted(part)
            if not len(row):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(n, pa.int64())], names=["id", "simhash"])
                continue
            signs = np.unpackbits(hashed(tokens).byteswap().view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sums = np.add.reduceat(signs[token] * count[:, None].astype(np.int32), starts, axis=0)
            bits = np.packbits(sums > 0, axis=1).view(np.uint64).byteswap().ravel().view(np.int64)
            out, filled = np.zeros(n, np.int64), np.zeros(n, bool)
            out[row[starts]], filled[row[starts]] = bits, True
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, mask=~filled)], names=["id", "simhash"])

    return _by_row(rows, id_col, tokens_col, run, "simhash long")


def hamming(a: Column, b: Column, dialect: str = "batch") -> Column:
    distance = F.bit_count(a.bitwiseXOR(b))
    return F.coalesce(distance, F.lit(64)) if dialect == "live" else distance


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct entries; 0 where either is null or empty."""
    either_empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(either_empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for null, empty, unequally long or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.coalesce(usable, F.lit(False)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def term_frequencies(rows: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, term, tf, first_pos) of every row, without a shuffle."""

    def run(batches):
        for part in _slices(batches):
            _, tokens, row, token, count, first = _counted(part)
            if len(row):
                terms = pa.array(tokens).take(pa.array(token))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), terms, pa.array(count.astype(np.int64)), pa.array(first.astype(np.int32))], names=["id", "term", "tf", "first_pos"])

    return _by_row(rows, id_col, tokens_col, run, "term string, tf long, first_pos int")


def keywords(rows: DataFrame, id_col: str, tokens_col: str, n: int = 8) -> DataFrame:
    """(id, keywords): the n most frequent tokens of every row, ties by first occurrence, without a shuffle; rows without tokens don't come out."""

    def run(batches):
        for part in _slices(batches):
            _, tokens, row, token, count, first = _counted(part)
            if not len(row):
                continue
            order = np.lexsort((first, -count, row))
            row, token = row[order], token[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < n
            row, token = row[kept], token[kept]
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(tokens).take(pa.array(token)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[starts])), lists], names=["id", "keywords"])

    return _by_row(rows, id_col, tokens_col, run, "keywords array<string>")


def fallback_summary(text: Column, sentences: int = 3) -> Column:
    """The first sentences of a text, split at white space after a full stop, exclamation or question mark."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.slice(parts, 1, sentences), " ")


def truncate_words(text: Column, length: int) -> Column:
    """The text, or its first length - 1 characters, cut at the last blank if that lies beyond place 200."""
    cut = F.substring(text, 1, length - 1)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    return F.when(F.length(text) <= length, text).when((F.instr(cut, " ") > 0) & (space > 200), F.substring(cut, F.lit(1), space)).otherwise(cut)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def fuzzy_words(query: str, text: Column) -> Column:
    """Share of the query's words that contain or are contained in a word of the text; 1 where the whole query is a substring."""
    q = query.lower()
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    asked = [w for w in q.split() if w]
    if not q or not asked:
        return F.lit(0.0)

    def hit(x: str) -> Column:
        return F.exists(words, lambda w: w.contains(x) | F.lit(x).contains(w)).cast("int")

    hits = sum((hit(x) for x in asked), F.lit(0))
    return F.when(low == "", 0.0).when(low.contains(q), 1.0).otherwise(hits / F.lit(len(asked)))


def prompt(title: Column, text: Column) -> Column:
    """The request for a summary of a page."""
    head = F.lit("Summarize the page in 2-3 sentences. Focus on what it is about and why it matters.\nTitle: ")
    named = F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title)
    return F.concat(head, named, F.lit("\nContent:\n"), F.coalesce(text, F.lit("")), F.lit("\n\nSummary:"))


def embedding_text(title: Column, summary: Column, domain: Column, excerpt: Column) -> Column:
    """The lines of title, summary and domain that have a value, else the excerpt."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    lines = F.concat_ws("\n", line("Title", title), line("Summary", summary), line("Domain", domain))
    return F.when(lines != "", lines).otherwise(F.coalesce(excerpt, F.lit("")))
