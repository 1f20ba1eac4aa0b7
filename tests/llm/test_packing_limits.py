import random

from pagelattice.llm import queries


def test_a_registered_query_packs_under_all_limits(spark, tmp_path):
    r = random.Random(4)
    texts = ["short note"] * 400 + [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(5, 400))) for _ in range(200)]
    texts += ["a prompt of some words\n\n" + " ".join(["delta"] * r.randrange(5, 80)) for _ in range(100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 512)], "plan_id int, capacity_tokens int").write.parquet(f"{tmp_path}/pack_plans.parquet")
    filled = queries.queries()["p7_limited_fill"](spark, str(tmp_path)).toPandas()
    assert filled.loss_tokens.max() <= 486 and filled.loss_tokens.max() > 480 and filled.segments.max() == 8 and (filled.unused >= 0).all()
    whole = queries.queries()["p7_fill"](spark, str(tmp_path)).toPandas()
    assert filled.tokens.sum() == whole.tokens.sum() and whole.loss_tokens.max() > 486
