from pagelattice.llm import mixing, packing

TOKENIZER = packing.DEFAULT_TOKENIZER


def test_a_given_total_lets_caps_bind_and_reports_what_is_missing(spark):
    rows = [(i, "word " * 40, "big.test") for i in range(400)] + [(1000 + i, "word " * 40, "small.test") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big.test", 0.5, 1), ("small.test", 0.5, 2)], "source string, target_share double, max_repeats int")
    sized = mixing.targeted_documents(docs, targets)
    whole = mixing.available_tokens(sized)
    report = {r.source: r for r in mixing.reached_shares(docs, targets, total=whole).collect()}
    small, big = report["small.test"], report["big.test"]
    assert small.most_repeats == 2 and small.documents == 10 and small.missing_tokens == small.asked_tokens - small.tokens > 0
    assert abs(big.tokens - big.asked_tokens) <= 100 and big.most_repeats == 1
    got = mixing.mixture(docs, targets, total=whole, sized=sized)
    assert got.groupBy("doc_id").count().where("count > 2").count() == 0


def test_slots_stay_fine_and_ranks_are_dense(spark):
    rows = [{"source": "a", "goal": 700_000, "share": 0.7}, {"source": "b", "goal": 300_000, "share": 0.3}]
    ranks = mixing.schedule(spark, rows, 5).groupBy("source").agg({"rank": "max", "slot": "count"}).collect()
    for r in ranks:
        assert r["max(rank)"] + 1 == r["count(slot)"]


def test_shards_hold_pieces_not_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "a b c")], "doc_id long, text string")
    plans = spark.createDataFrame([(1, "p", 16)], "plan_id int, plan_name string, capacity_tokens int")
    packed = packing.packed_pieces(docs, plans, shard_rows=100)
    filled = packing.containers(packed, plans)
    assert filled.where("unused < 0").count() == 0 and packed.select("doc_id", "piece").distinct().count() == packed.count() > 1000
    shards = packed.selectExpr("shiftright(container_id, 32) & 268435455 as s").groupBy("s").count()
    assert shards.agg({"count": "max"}).first()[0] < 400
