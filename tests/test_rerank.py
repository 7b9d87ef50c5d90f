"""Greedy rerankers against plain versions on random lists; model recommenders on planted groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import ranking, rerank

LISTS = "list_id int, item_id int, score double, vector array<double>"


def lists(seed, n_lists=6, n=9, dims=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_lists):
        v = rng.normal(size=(n - g, dims))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows += [(g, int(i), float(np.round(rng.normal(), 3)), x.tolist()) for i, x in enumerate(v)]
    return rows


def plain_mmr(rows, k, trade):
    left, out = sorted(rows, key=lambda r: (-r[2], r[1])), []
    while left and len(out) < k:
        value = lambda r: trade * r[2] - (1 - trade) * max((float(np.dot(r[3], c[3])) for c in out), default=0.0)
        best = max(left, key=lambda r: (round(value(r), 9), r[2], -r[1]))
        out.append(best)
        left.remove(best)
    return [r[1] for r in out]


def plain_dpp(rows, k):
    rows = sorted(rows, key=lambda r: (-r[2], r[1]))
    q, v = np.exp([r[2] for r in rows]), np.array([r[3] for r in rows])
    kernel, chosen = q[:, None] * (v @ v.T) * q[None, :], []
    for _ in range(min(k, len(rows))):
        base = np.linalg.det(kernel[np.ix_(chosen, chosen)]) if chosen else 1.0
        gain = [-1.0 if i in chosen else np.linalg.det(kernel[np.ix_(chosen + [i], chosen + [i])]) / base for i in range(len(rows))]
        if max(gain) < 1e-10:
            break
        chosen.append(int(np.argmax(np.round(gain, 7))))
    return [rows[i][1] for i in chosen]


@pytest.mark.parametrize("method, plain", [(lambda d: rerank.mmr(d, 6, 0.6), lambda r: plain_mmr(r, 6, 0.6)), (lambda d: rerank.dpp(d, 4), lambda r: plain_dpp(r, 4))])
def test_greedy_choices_equal_plain(spark, method, plain):
    rows = lists(21)
    got = {}
    for r in method(spark.createDataFrame(rows, LISTS)).orderBy("list_id", "rank").collect():
        got.setdefault(r.list_id, []).append(r.item_id)
    assert got == {g: plain([r for r in rows if r[0] == g]) for g in range(6)}


def test_factors_of_als_keep_groups_apart(spark):
    rng = np.random.default_rng(22)
    rows = [(u, int(i), 1.0 + float(rng.integers(0, 2))) for u in range(40) for i in rng.choice(np.arange(u % 2 * 20, u % 2 * 20 + 20), 8, replace=False)]
    graded = spark.createDataFrame(rows, "user_id int, item_id int, grade double")
    users, seen = graded.select("user_id").distinct(), graded.select("user_id", "item_id")
    for weights in ("grade", "binary"):
        recs = ranking.als(graded, users, seen, 5, dims=4, weights=weights)
        assert recs.join(seen, ["user_id", "item_id"]).count() == 0
        own = recs.agg(F.avg(((F.col("item_id") >= 20) == (F.col("user_id") % 2 == 1)).cast("double"))).first()[0]
        assert own > 0.95
        assert recs.groupBy("user_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n OR n > 5").count() == 0
    with pytest.raises(ValueError, match="weights"):
        ranking.als(graded, users, seen, 5, weights="clicks")
    assert ranking.als(graded.where("false"), users, seen, 5).count() == 0
