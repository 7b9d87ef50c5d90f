"""Rules that engines read differently, and what is worked out once for all users of a taste."""

import duckdb
from conftest import SF
from pyspark.sql import functions as F

from tributary.operators import recommend
from tributary.plans import designs
from tributary.plans.queries import Fixture


def test_intent_rules_know_words_of_any_script(spark, tmp_path):
    """F13."""
    texts = ["noñ", "ñno", "no", "it is NOT.", "not_", "without\n", "cheaper 12", "ácheap", "LUXURY 1234567", "éluxur", "nõ", None, ""]
    spark.createDataFrame([(i, 1, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, designs.QUERIES["intent_rules"](spark, str(tmp_path)).collect()))
    assert got == sorted(duck.execute(designs.ORACLES["intent_rules"]).fetchall())
    assert [r[2] for r in got] == [False, False, True, True, False, True, False, False, False, False, False, None, False]
    assert [r[4] for r in got][6:10] == ["Budget", None, "Luxury", None]


def test_pairs_are_weighed_by_taste(spark, monkeypatch):
    """a taste meets the catalog once; the regression is that of all pairs."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tributary.functions.hashing import hash_int
    from tributary.operators import split

    f = Fixture(spark, SF)
    alike = f.users.withColumn("p1", (F.col("user_id") % 3).cast("int")).withColumn("p2", F.lit(4)).withColumn("mix_weight", F.lit(0.75))
    monkeypatch.setattr(Fixture, "users", property(lambda self: alike))
    met, real = [], recommend.persona_scores
    monkeypatch.setattr(recommend, "persona_scores", lambda users, *a: met.append(users.count()) or real(users, *a))
    pairs = real(alike.join(f.judged, "user_id", "left_semi"), f.personas, f.catalog).join(split.popularity(f.train, f.catalog), "item_id")
    pairs = pairs.join(f.rel, ["user_id", "item_id"], "left").withColumn("label", F.col("grade").isNotNull().cast("int"))
    ready = VectorAssembler(inputCols=["score", "cnt"], outputCol="features").transform(pairs)
    learns = hash_int("user_id", F.lit("coarse")) % 2 == 0
    scored = LogisticRegression(maxIter=20).fit(ready.where(learns)).transform(ready.where(~learns))
    want = {(r.user_id, r.item_id): r.p for r in scored.select("user_id", "item_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = designs.QUERIES["coarse_logistic"](spark, SF).collect()
    assert got and all(abs(r.p - want[r.user_id, r.item_id]) < 1e-5 for r in got)
    designs.QUERIES["pop_spearman"](spark, SF).count()
    assert met and max(met) == 3
