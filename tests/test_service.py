"""Stored vectors, places by city, injected scorers, names in texts, draws of subsets, clusters and streams."""

import itertools
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import groups, mentions, metrics, rerank, scorer
from tributary.plans import service
from tributary.sources import encoded, places
from tributary.streaming import events

TEXTS = "item_id int, text string"


def test_only_new_and_changed_texts_are_encoded(spark, tmp_path):
    path, calls = str(tmp_path / "vectors"), str(tmp_path / "calls")
    (tmp_path / "calls").mkdir()

    def counting(texts):
        import uuid
        from pathlib import Path

        (Path(calls) / uuid.uuid4().hex).write_text(json.dumps(texts))
        return service.letters(texts)

    asked = lambda: sorted(t for f in (tmp_path / "calls").iterdir() for t in json.loads(f.read_text()))
    first = spark.createDataFrame([(1, "aa"), (2, "b"), (2, "b"), (3, None), (None, "lost")], TEXTS)
    got = {r.item_id: list(r.embedding) for r in encoded.read_or_build(first, path, counting, 2).collect()}
    assert got == {1: [2.0, 2.0], 2: [1.0, 0.0], 3: [0.0, 0.0]} and asked() == ["", "aa", "b"]
    encoded.read_or_build(first, path, counting, 2).collect()
    assert len(asked()) == 3  # nothing again
    second = spark.createDataFrame([(1, "aa"), (2, "be"), (4, "aa")], TEXTS)
    got = {r.item_id: list(r.embedding) for r in encoded.read_or_build(second, path, counting, 2).collect()}
    assert got == {1: [2.0, 2.0], 2: [2.0, 1.0], 4: [2.0, 2.0]} and asked() == ["", "aa", "aa", "b", "be"]
    assert encoded.stored(spark, path, "int").count() == 5  # older texts stay
    with pytest.raises(ValueError, match="holds"):
        encoded.stored(spark, path, "string")


def test_a_wrong_reply_of_the_encoder_stores_nothing(spark, tmp_path):
    path = str(tmp_path / "vectors")
    with pytest.raises(Exception, match="the encoder gave"):
        encoded.read_or_build(spark.createDataFrame([(1, "a")], TEXTS), path, lambda texts: np.zeros((len(texts), 3)), 2)
    assert encoded.read_or_build(spark.createDataFrame([(1, "a")], TEXTS), path, service.letters, 2).count() == 1


def test_places_are_read_by_city(spark, tmp_path):
    path = str(tmp_path / "places")
    rows = spark.range(1000).selectExpr("id as place_id", "case when id < 700 then 'big' when id = 999 then null else concat('c', id % 5) end as city", "id * 2 as x")
    places.write_places(rows, path, file_rows=100)
    assert len(list((tmp_path / "places" / "city=big").glob("*.parquet"))) >= 4  # a large city isn't one file of one task
    assert places.read_places(spark, path).count() == 1000
    named = spark.createDataFrame([("c1",), ("c1",), ("big",), ("nowhere",), (None,)], "city string")
    some = places.read_places(spark, path, named)
    assert some.groupBy("city").count().orderBy("city").collect() == [("big", 700), ("c1", 60)]
    chosen = places.read_places(spark, path, named.where("city LIKE 'c%'"))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", plan)
    places.write_places(rows.where("city = 'c1'").withColumn("x", F.lit(-1).cast("long")), path, mode="overwrite")
    assert places.read_places(spark, path).count() == 1000 and places.read_places(spark, path, named.where("city = 'c1'")).where("x <> -1").count() == 0


def prompts(spark, rows):
    return spark.createDataFrame(rows, "user_id long, prompt string")


def test_replies_are_asked_for_once_and_kept(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    calls = str(tmp_path / "calls")

    def counting(texts):
        import uuid
        from pathlib import Path

        (Path(calls) / uuid.uuid4().hex).write_text(json.dumps(texts))
        return ["no list" if "bad" in t else "[1, 2]" for t in texts]

    asked = lambda: sorted(t for f in (tmp_path / "calls").iterdir() for t in json.loads(f.read_text()))
    rows = prompts(spark, [(1, "a"), (2, "a"), (3, "bad"), (4, None)])
    none = spark.createDataFrame([], scorer.CACHE)
    got, cache = scorer.replies(rows, none, "m", counting)
    assert {r.user_id: r.reply for r in got.collect()} == {1: "[1, 2]", 2: "[1, 2]", 3: "no list", 4: "[1, 2]"}
    got.count()
    assert asked() == ["", "a", "bad"]  # each prompt once, however often the plan runs
    assert cache.count() == 2
    again, cache = scorer.replies(rows, cache, "m", counting)
    assert again.where("reply IS NOT NULL").count() == 4 and asked() == ["", "a", "bad", "bad"] and cache.count() == 2
    scorer.replies(rows, cache, "other model", counting)[0].count()
    assert len(asked()) == 7
    with pytest.raises(Exception, match="0 replies to"):
        scorer.replies(rows, none, "m", lambda texts: [])[0].count()


def test_malformed_replies_are_empty_lists(spark):
    said = ["[1,2]", "Sure: [3, 4] as asked", "[1, null, 2]", "", None, "none", "[1, 'x']", "{\"a\": 1}", "[]", "[1,\n 2]"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, reply string")
    got = [r.p for r in rows.select("i", scorer.parsed("reply").alias("p")).orderBy("i").collect()]
    assert got == [[1, 2], [3, 4], [1, 2], [], [], [], [], [], [], [1, 2]]


def test_picks_are_places_of_the_catalog(spark):
    catalog = spark.createDataFrame([(70,), (10,), (40,)], "item_id int")
    seen = spark.createDataFrame([(1, 40)], "user_id long, item_id int")
    model = scorer.Asked(prompts(spark, [(1, "x"), (2, "y"), (3, "z")]), catalog, seen, spark.createDataFrame([], scorer.CACHE), "m", lambda ps: ["what?" if p == "z" else "[2, 9, -1, 1, 2, 0]" for p in ps])
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    assert sorted(map(tuple, model.recommend(users, 2).collect())) == [(1, 1, 70), (1, 2, 10), (2, 1, 70), (2, 2, 40)]
    scored, cache = scorer.pair_scores(prompts(spark, [(1, "a"), (2, "b")]), spark.createDataFrame([], scorer.CACHE), "m", lambda ps: ["0.5" if p == "a" else "n/a" for p in ps])
    assert {r.user_id: r.score for r in scored.collect()} == {1: 0.5, 2: None} and cache.count() == 1


def plain_mentions(texts, names):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = set()
    for i, t in texts:
        w = split(t)
        found = [(s, len(split(n)), k) for k, n in names if split(n) for s in range(len(w)) if w[s : s + len(split(n))] == split(n)]
        out |= {(i, s, n, k) for s, n, k in found if not any(a <= s and a + m >= s + n and m > n for a, m, _ in found)}
    return out


def test_mentions_equal_plain_version(spark):
    rng = np.random.default_rng(8)
    word = ["new", "york", "city", "san", "jose", "é", "la"]
    names = [(1, "New York"), (2, "york city"), (3, "New York City"), (4, "San José"), (5, "la"), (6, "LA"), (7, "new york"), (8, "--"), (9, None), (10, "la la la")]
    texts = [(i, " ".join(rng.choice(word, rng.integers(0, 40))).replace("new", rng.choice(["New", "new-"]))) for i in range(120)] + [(900, None), (901, ""), (902, "New York " * 3000)]
    t, n = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id long, name string")
    got = {tuple(r) for r in mentions.find_mentions(t, n).collect()}
    assert got == plain_mentions(texts, names) and len(got) > 6000
    assert mentions.find_mentions(t, n.where("false")).count() == 0 and mentions.find_mentions(t.where("false"), n).count() == 0
    rates = {r.text_id: (r.mentions, r.grounded, r.rate) for r in mentions.grounding(mentions.find_mentions(spark.createDataFrame([(1, "la and new york and city")], "text_id long, text string"), n), spark.createDataFrame([(1, 7), (1, 4)], "text_id long, name_id long")).collect()}
    assert rates == {1: (2, 1, 0.5)}


def test_draws_follow_the_determinants(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(5, 4))
    kernel = v @ v.T
    subsets = list(itertools.combinations(range(5), 2))
    weight = np.array([np.linalg.det(kernel[np.ix_(s, s)]) for s in subsets])
    counts = dict.fromkeys(subsets, 0)
    n = 6000
    for _ in range(n):
        counts[tuple(sorted(rerank.draw_subset(kernel, 2, rng)))] += 1
    for s, p in zip(subsets, weight / weight.sum()):
        assert abs(counts[s] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 1e-3
    assert len(rerank.draw_subset(np.ones((4, 4)), 3, rng)) == 1  # rank one
    e = rerank.elementary(np.array([2.0, 3.0, 5.0]), 2)
    assert e[:, -1].tolist() == [1.0, 10.0, 31.0]
    lists = spark.createDataFrame([(g, i, -float(i), [float(np.cos(i)), float(np.sin(i)), 1.0]) for g in range(3) for i in range(6)], "list_id int, item_id int, score double, vector array<double>")
    once, again = (sorted(map(tuple, rerank.kdpp(x, 3).collect())) for x in (lists, lists.repartition(5)))
    assert once == again and [r[2] for r in once] == [1, 2, 3] * 3 or sorted(r[2] for r in once) == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_clusters_find_planted_personas(spark):
    rng = np.random.default_rng(10)
    tags = np.full((60, 9), 3)
    for i in range(60):
        tags[i, (i % 6) : (i % 6) + 3] = 5
    catalog = spark.createDataFrame([(i, [int(x) for x in t]) for i, t in enumerate(tags)], "item_id int, tags array<int>")
    likes = [(u, int(i)) for u in range(180) for i in (rng.choice(np.arange(u % 6, 60, 6), 6) if rng.random() < 0.95 else rng.choice(60, 6))]
    found = groups.clustered(groups.profiles(spark.createDataFrame(likes, "user_id long, item_id int"), catalog), 6)
    row = metrics.agreement(found.withColumn("p", F.col("user_id") % 6), "cluster", "p").first()
    assert row.n == 180 and row.purity > 0.9 and row.adjusted_rand > 0.8
    assert groups.clustered(groups.profiles(spark.createDataFrame([], "user_id long, item_id int"), catalog), 6).count() == 0


LOG = "user_id long, item_id int, event_type string, ts timestamp"


def test_stream_join_equals_batch_with_late_children(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    log = [(u, i, "impression", t + timedelta(minutes=10 * u + i)) for u in range(6) for i in range(4)]
    log += [(u, i, "click", t + timedelta(minutes=10 * u + i + 7 * (i + u))) for u in range(6) for i in range(3)] + [(0, 0, "click", t - timedelta(minutes=1)), (1, 1, "click", t + timedelta(days=2))]
    rows = spark.createDataFrame(log, LOG)
    early = rows.where("event_type = 'impression' OR item_id = 0")  # the other clicks come in a second file
    early.coalesce(1).write.parquet(str(tmp_path / "log"))
    rows.where("event_type = 'click' AND item_id > 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

    def source(kind):
        return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")).where(F.col("event_type") == kind)

    q = events.clicks_after(source("impression"), source("click"), "30 MINUTES").writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    of = lambda kind: rows.where(F.col("event_type") == kind)
    batch = events.clicks_after(of("impression"), of("click"), "30 MINUTES")
    got = sorted(map(tuple, spark.table("joined").collect()))
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 5


def test_kept_profiles_equal_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(11)
    t = datetime(2024, 1, 1)
    log = [(int(u), int(i), "click", t + timedelta(hours=int(h))) for u, i, h in zip(rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.integers(0, 2000, 60))]
    rows = spark.createDataFrame(log, LOG)
    for n in range(3):  # out of order: an older like can come after a newer one
        rows.where(F.col("user_id") >= 0).where(F.pmod(F.xxhash64("ts", "user_id"), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        q = events.decayed(source, 10.0).writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(provider)
    got = {}
    for r in spark.table("kept").collect():
        key = r.user_id, r.item_id
        if key not in got or (r.at, r.weight) > got[key]:  # weights only grow at one time
            got[key] = (r.at, r.weight)
    want = {(r.user_id, r.item_id): (r.at, pytest.approx(r.weight)) for r in events.decayed(rows, 10.0).collect()}
    assert got == want
