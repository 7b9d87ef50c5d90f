"""Hand-made goldens of the split and the metrics, invariants, and equality with SQL on the smallest tables."""

from functools import reduce

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tributary.operators import generate, metrics, rerank, split
from tributary.plans import checks, designs, files, learned, queries, search, service
from tributary.plans.queries import Fixture
from tributary.sources import tables
from tributary.streaming import events

MODULES = (queries, designs, checks, search, learned, service, files)
QUERIES = reduce(dict.__or__, (m.QUERIES for m in MODULES))
ORACLES = reduce(dict.__or__, (m.ORACLES for m in MODULES))


def plain(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "part customer events embeddings documents conversations benchmark".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["bpr_gradient", "listwise_gradient", "embedding_refresh", "places_by_city", "rec_asked", "text_mentions", "decayed_profiles", "catalog_file", "interactions_file", "requests_allowed", "metrics_by_kind", "half_life_sweep", "source_merge", "filter_session_mask", "hard_filter", "rec_random", "rec_popularity", "eval_report", "filter_fallback", "funnel_end_to_end", "interleave", "profile_eval", "history_prompt", "find_city", "persona_recovery", "tag_set_f1", "ann_recall", "area_density", "when_to_go", "draft_clicks", "explore_swap"])
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    place = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in place) for r in cursor.fetchall())


def test_metrics_golden(spark):
    recs = spark.createDataFrame([("u", i + 1, x) for i, x in enumerate("abcde")], "user_id string, rank int, item_id string")
    rel = spark.createDataFrame([("u", "b", 2), ("u", "e", 1), ("u", "z", 1), ("v", "q", 1)], "user_id string, item_id string, grade int")
    got = {r.k: r for r in metrics.per_user(recs, rel, [1, 2, 3, 5]).where("user_id = 'u'").collect()}
    assert [got[k].hit_rate for k in (1, 2, 3, 5)] == [0, 1, 1, 1]
    assert [round(got[k].recall, 6) for k in (1, 2, 3, 5)] == [0, 0.333333, 0.333333, 0.666667]
    assert [round(got[k].ndcg, 6) for k in (1, 2, 3, 5)] == [0, 0.479625, 0.40303, 0.526589]
    assert metrics.per_user(recs, rel, [5]).where("user_id = 'v'").first().recall == 0


def test_split_rounds_half_to_even_and_keeps_one(spark):
    sizes = [(0.2, 1, 1), (0.2, 2, 1), (0.2, 25, 5), (0.5, 5, 2), (0.5, 25, 12), (0.5, 3, 2), (0.1, 25, 2), (0.1, 15, 2)]
    for fraction, n, want in sizes:
        rows = spark.range(1, n + 1).selectExpr("'u' as user_id", "cast(id as int) as session_no")
        assert split.with_split(rows, fraction).where("is_test").count() == want


def test_no_seen_item_is_recommended_and_ranks_are_gapless(spark):
    f = Fixture(spark, SF)
    recs = f.popular(10)
    assert recs.join(f.seen, ["user_id", "item_id"]).count() == 0
    assert recs.groupBy("user_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0


def test_generated_events_nest_in_time(spark):
    people = generate.users(spark, 60)
    rows = generate.interactions(generate.sessions(people), tables.persona_table(spark), tables.fixture_catalog(spark, SF))
    wide = rows.groupBy("session_id", "item_id").pivot("event_type", ["impression", "click", "save", "itinerary_add", "not_interested"]).agg(F.min("ts"))
    bad = "(click is not null and click <= impression) or (save is not null and (click is null or save <= click)) or (itinerary_add is not null and save is null) or (not_interested is not null and click is not null)"
    assert wide.where(bad).count() == 0
    shown = rows.where("event_type = 'impression'").groupBy("session_id").count()
    assert shown.where("count < 10 or count > 20").count() == 0


def test_mmr_first_is_best_and_spreads(spark):
    lists = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])], "list_id int, item_id int, score double, vector array<double>")
    assert [r.item_id for r in rerank.mmr(lists, 2, 0.5).orderBy("rank").collect()] == [1, 3]
    assert [r.item_id for r in rerank.dpp(lists, 3).orderBy("rank").collect()] == [1, 3]


def test_stream_equals_batch(spark, tmp_path):
    rows = Fixture(spark, SF).inter.select("user_id", "event_type", "ts")
    rows.write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema("user_id long, event_type string, ts timestamp_ntz").parquet(str(tmp_path / "log")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = events.daily_counts(source).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.daily_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))


def test_files_round_trip(spark, tmp_path):
    spark.createDataFrame([("k", [1, 2]), ("failed", [])], "key string, picks array<int>").transform(lambda d: tables.write_cache(d, str(tmp_path / "c")) or d)
    assert [tuple(r) for r in tables.read_cache(spark, str(tmp_path / "c")).collect()] == [("k", [1, 2])]
    (tmp_path / "i.csv").write_text("interaction_id,user_id,item_id,event_type,session_id,timestamp,dwell_seconds\n1,u,i,click,s,2024-01-01T00:00:00,3.5\n2,u,i,save,s,2024-01-01T00:00:01,\n")
    assert [r.dwell_seconds for r in tables.read_interactions(spark, str(tmp_path / "i.csv")).orderBy("interaction_id").collect()] == [3.5, None]


def test_report_reads_events_in_few_scans_and_crosses_nothing(spark):
    plan = QUERIES["eval_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "events.parquet" not in plan  # all from what was split once
    assert Fixture(spark, SF).split._jdf.queryExecution().executedPlan().toString().count("events.parquet") == 1
    for name in ("rec_oracle", "rec_popularity", "rec_random", "funnel_end_to_end", "profile_eval", "hard_filter", "soft_penalty"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        if name != "profile_eval":  # which joins the cut-offs it is judged at
            assert "BroadcastNestedLoopJoin" not in plan, name
