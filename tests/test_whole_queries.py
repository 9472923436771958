"""Queries read whole vectors."""

from tessera import plans

from .conftest import SMALL


def test_pool_reads_every_component(spark):
    width = spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("max(size(embedding))").first()[0]
    rows = plans.queries()["mil_pool_full"](spark, SMALL).select("dim").distinct().collect()
    assert {r.dim for r in rows} == set(range(width))


def test_bootstrap_draws_as_often_as_the_reference(spark):
    rows = plans.queries()["bootstrap_delta_auc_full"](spark, SMALL).collect()
    assert rows and all(r.n_bootstrap_valid == 500 for r in rows)
