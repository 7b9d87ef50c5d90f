"""Requests in words, what their constraints allow, and measures of settings and kinds."""

import math

from pyspark.sql import functions as F

from tributary.operators import intent, metrics
from tributary.sources.tables import TAGS


def test_requests_are_parsed(spark):
    said = {
        "A cheap week with museums and good FOOD, not too much nightlife, in May": ("Budget", ["culture", "cuisine"], ["nightlife"], 5, None),
        "Luxury spa for 10 nights; avoid big city": ("Luxury", ["wellness"], ["urban"], None, 10),
        "mid-range, then maybe a splurge": ("Mid-range", [], [], None, None),
        "no beaches but beaches": (None, [], ["beaches"], None, None),
        "without any crowds": (None, [], [], None, None),
        "I may go hiking during October for 3 days": (None, ["adventure"], [], 10, 3),
        "": (None, [], [], None, None),
        None: (None, [], [], None, None),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = [tuple(r.p) for r in rows.select("i", intent.parse(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [(b, t, a, m, d) for b, t, a, m, d in said.values()]
    long = spark.range(1).select(intent.parse(F.concat(F.repeat(F.lit("word "), 100_000), F.lit("cheap"))).alias("p")).first().p
    assert long.budget == "Budget"


def test_constraints_are_applied_by_signature(spark):
    rates = lambda **r: [r.get(t, 3) for t in TAGS]
    catalog = spark.createDataFrame([(1, "Budget", rates(nature=5)), (2, "Budget", rates(nature=5, nightlife=4)), (3, "Luxury", rates(nature=4, nightlife=1)), (4, None, rates())], "item_id int, budget_level string, tags array<int>")
    asked = spark.createDataFrame([("Budget", ["nature"], []), ("Budget", ["nature"], []), (None, ["nature"], ["nightlife"]), (None, [], [])], "budget string, tags array<string>, avoid array<string>")
    got = {(r.budget, tuple(r.tags), tuple(r.avoid), r.item_id) for r in intent.allowed(catalog, asked).collect()}
    assert got == {("Budget", ("nature",), (), 1), ("Budget", ("nature",), (), 2), (None, ("nature",), ("nightlife",), 3)} | {(None, (), (), i) for i in (1, 2, 3, 4)}
    assert intent.allowed(catalog, asked).count() == 7
    real, told = (spark.createDataFrame(r, "k int, budget string, tags array<string>") for r in ([(1, "Budget", []), (2, None, ["nature"]), (3, None, [])], [(1, "Budget", ["urban"]), (2, None, ["nature"])]))
    row = intent.field_match(told, real, "k", ["budget", "tags"]).first()
    assert (row.requests, round(row.valid, 4), round(row.budget, 4), round(row.tags, 4)) == (3, 0.6667, 0.6667, 0.3333)


def test_front_of_settings(spark):
    rows = [("a", 0.9, 1.0), ("b", 0.8, 3.0), ("c", 0.8, 2.0), ("d", 0.7, 3.0), ("e", 0.1, 9.0), ("f", 0.9, 1.0), ("g", 0.5, 8.0)]
    front = metrics.frontier(spark.createDataFrame(rows, "name string, x double, y double"), "name", "x", "y")
    want = {n for n, x, y in rows if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in rows)}
    assert {r.name for r in front.collect()} == want == {"a", "b", "e", "f", "g"}


def test_nobody_to_judge_gives_nan_and_kinds_are_judged_apart(spark):
    recs = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 11), (2, 1, 21)], "user_id int, rank int, item_id int")
    rel = spark.createDataFrame([(1, 11, 1), (1, 20, 2), (2, 20, 1)], "user_id int, item_id int, grade int")
    none = metrics.evaluate({"m": recs, "n": recs.where("false")}, rel.where("false"), [5, 10]).collect()
    assert len(none) == 4 and all(r.users == 0 and math.isnan(r.ndcg) and math.isnan(r.hit_rate) and math.isnan(r.recall) for r in none)
    silent = {r.model: r for r in metrics.evaluate({"m": recs, "n": recs.where("false")}, rel, [5]).collect()}
    assert silent["n"].users == 2 and silent["n"].ndcg == 0.0 and silent["m"].recall == 0.5
    kinds = spark.createDataFrame([(10, "a"), (11, "a"), (20, "b"), (21, "b"), (30, "c")], "item_id int, kind string")
    got = {r.kind: (r.users, r.hit_rate, r.recall, r.ndcg) for r in metrics.by_kind(recs, rel, kinds, [1]).collect()}
    assert got == {"a": (1, 0.0, 0.0, 0.0), "b": (2, 0.5, 0.5, 0.5)}
    two = {r.kind: r.ndcg for r in metrics.by_kind(recs, rel, kinds, [2]).collect()}
    assert abs(two["a"] - 1 / math.log2(3)) < 1e-6  # second of its kind, third of the list
