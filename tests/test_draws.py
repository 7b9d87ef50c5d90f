"""The generator's draws against a plain sort of all pairs."""

import math

import pytest
from pyspark.sql import functions as F

from tributary.functions.hashing import quick_uniform
from tributary.operators import generate
from tributary.sources.durable import Durable


@pytest.mark.parametrize("spare", [3.0, 0.05])
def test_draws_equal_a_sort_of_all_pairs(spark, spare):
    """With a bound that is too low, sessions meet everything again."""
    items = spark.range(200).selectExpr("cast(id as int) item_id", "if(id % 4 = 0, 'Budget', 'Luxury') budget_level", "array(cast(1 + id % 5 as int), cast(5 - id % 5 as int)) tags", "1.0D / (id + 1) weight")
    asked = spark.range(60).selectExpr("concat('s', id) session_id", "case when id % 3 = 0 then 'Budget' when id % 7 = 0 then 'None such' end f_budget", "case when id % 2 = 0 then cast(1 + id % 2 as int) end f_tag", "cast(10 + id % 11 as int) n_shown")
    u = quick_uniform("session_id", "item_id", F.lit(42), F.lit("show"))
    pairs = {}
    for r in asked.crossJoin(items).select("*", u.alias("u")).collect():
        ok = r.f_budget in (None, r.budget_level) and (r.f_tag is None or r.tags[r.f_tag - 1] >= 4)
        pairs.setdefault((r.session_id, r.n_shown), []).append((ok, -math.log(r.u) / r.weight, r.item_id))
    want = set()
    for (session, n), rows in pairs.items():
        some = [x for x in rows if x[0]]
        want |= {(session, i) for _, _, i in sorted(some if len(some) >= n else rows, key=lambda x: x[1:])[:n]}
    got = generate.drawn(Durable(spark, tidy=True), asked, items, u, spare)
    assert {(r.session_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)


def test_a_finished_job_leaves_no_shuffle_files(spark):
    """rounds of joins don't heap up their shuffles."""
    held = Durable(spark, tidy=True)
    held.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false" and held.tidy
