from pagelattice.plans.queries import queries

D = "/root/testdata/sf0.001"


def test_live_edges_hold_every_pair_of_a_domain(spark):
    assert queries()["graph_rebuild_live"](spark, D).where("reason = 'similarity+domain' and weight = 0.25").count() > 0


def test_every_tab_without_error_fills_the_cache(spark):
    fine = spark.read.parquet(f"{D}/tabs.parquet").where("error is null and url like 'http%'").select("id")
    assert queries()["cache_overlay"](spark, D).join(fine, "id").where("not cached").count() == 0
