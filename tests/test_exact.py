"""Exact search in blocks, and searches that deal no pairs."""

from conftest import SF
from pyspark.sql import functions as F

from tributary.operators import ann
from tributary.plans import queries


def test_exact_search_crosses_nothing_and_keeps_blank_pairs(spark, tmp_path):
    """pairs without a score come last, by id, as in SQL."""
    rows = [(0, [1.0, 0.0]), (20, None), (3, [0.5, 0.5]), (4, None), (40, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in queries._batch(spark, str(tmp_path), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(0, 1.0), (3, 0.5), (40, 0.0), (4, None)], 20: [(0, None), (3, None), (4, None), (20, None)], 40: [(40, 1.0), (3, 0.5), (0, 0.0), (4, None)]}
    plan = queries._batch(spark, SF, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_searches_deal_no_pairs(spark):
    """rows and queries meet in tasks; no join on buckets or cells."""
    v = spark.range(1, 301).selectExpr("id vec_id", "transform(sequence(1, 8), i -> sin(id * i)) v")
    for found in (ann.lsh_search(v, v.where("vec_id <= 5"), 3, 4, 8, 6), ann.ivf_search(v, v.where("vec_id <= 5").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and plan.count("Join") <= 1 and found.count() == 15
