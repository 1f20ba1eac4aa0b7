import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelattice.functions import text


def py_tokens(s):
    return [t for t in re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).split() if len(t) >= 3 and t not in set(text.STOPWORDS)]


def py_simhash(tokens):
    if not tokens:
        return None
    sums = [0] * 64
    for t in tokens:
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
        for i in range(64):
            sums[i] += 1 if h >> i & 1 else -1
    v = sum(1 << i for i, s in enumerate(sums) if s > 0)
    return v - (1 << 64) if v >= 1 << 63 else v


TEXTS = [None, "", "   ", "Apache Spark repository", "The THE the and", "a1b2c3 abc123def456 aaaa deadbeef 2024 stream", "x" * 20_000, "café naïve übung straße", "one. Two! three? four. five"]


def test_tokens_and_simhash_match_plain_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").select("id", "t", text.tokens(F.col("t")).alias("tokens"))
    got = {r.id: r for r in rows.join(text.simhash(rows, "id", "tokens"), "id").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].tokens == py_tokens(t)
        assert got[i].simhash == py_simhash(py_tokens(t))


def test_live_tokens_drop_codes(spark):
    df = spark.createDataFrame([("a1b2c3 abc12def45 aaaa deadbeef 2024 streams others custom",)], "t string")
    assert df.select(text.tokens(F.col("t"), "live", ["custom"]).alias("x")).first().x == ["streams", "others"]


def test_live_hash_keeps_double_rounding(spark):
    high = spark.createDataFrame([("tokabc",)], "t string").select(F.shiftrightunsigned(text.live_hash64(F.col("t")), 32).alias("h")).first().h
    assert high == 3629744580


def test_md5_hash(spark):
    assert spark.range(1).select(text.md5_hash64(F.lit("abc")).alias("h")).first().h == -8070080442485551184


def test_keywords_ties_by_first_occurrence(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "c", "a", "b"]), (2, []), (3, None)], "id int, tokens array<string>")
    assert {r.id: r.keywords for r in text.keywords(rows, "id", "tokens", 2).collect()} == {1: ["b", "a"]}


def test_summary_truncation_and_sets(spark):
    df = spark.createDataFrame([("Hi. There! x y? z", "w" * 150 + " " + "w" * 200, ["a", "a", "b"], ["b"], [])], "s string, l string, a array<string>, b array<string>, e array<string>")
    r = df.select(text.fallback_summary(F.col("s")).alias("s"), text.truncate_words(F.col("l"), 250).alias("l"), text.jaccard(F.col("a"), F.col("b")).alias("j"), text.jaccard(F.col("a"), F.col("e")).alias("z")).first()
    assert (r.s, len(r.l), r.j, r.z) == ("Hi. There! x y?", 249, 0.5, 0.0)
    cut = spark.createDataFrame([("a" * 210 + " " + "b" * 90,)], "l string").select(text.truncate_words(F.col("l"), 250).alias("l")).first().l
    assert cut == "a" * 210


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(text.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_prompt_and_embedding_text(spark):
    r = spark.createDataFrame([("", "body", "T", "", "d.com", "x")], "t string, b string, a string, s string, d string, e string")
    row = r.select(text.prompt(F.col("t"), F.col("b")).alias("p"), text.embedding_text(F.col("a"), F.col("s"), F.col("d"), F.col("e")).alias("x")).first()
    assert "Title: Untitled\nContent:\nbody\n\nSummary:" in row.p
    assert row.x == "Title: T\nDomain: d.com"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=20))
def test_hamming_is_a_metric_on_bits(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", text.hamming(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == bin((r.a ^ r.b) & (2**64 - 1)).count("1")
