"""Layered neighbour graphs against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import ann, graph

ROWS = "vec_id long, v array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_links_are_near_spread_and_answered():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(300, 6)))
    links = graph.layer_links(x, 8, slice_rows=70)
    sims = x @ x.T
    nearest = np.argsort(-(sims - 2 * np.eye(300)), axis=1)[:, 0]
    back = {(j, i) for i, own in enumerate(links) for j in own}
    for i, own in enumerate(links):
        assert i not in own and len(own) == len(set(own)) <= 24 and nearest[i] == own[0]
        assert sum((i, j) in back for j in own[:8]) >= 4  # most links are answered
    # spread: the second link is nearer to the node than to the first one
    for i, own in enumerate(links[:50]):
        assert sims[i, own[1]] > sims[own[0], own[1]]
    assert graph.layer_links(x[:1], 8) == [[]] and graph.layer_links(x[:2], 8) == [[1], [0]]


def test_levels_thin_out():
    levels = np.array([graph.level_of(i, 16) for i in range(20_000)])
    assert 0.05 < (levels >= 1).mean() < 0.075 and 0.002 < (levels >= 2).mean() < 0.007


def test_recall_and_share_of_rows_scored(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    told = {}
    index = graph.build(rows, shard_rows=3000)
    found = graph.search(index, asked, 10, told=told)
    u = unit(x)
    sims = u[::100] @ u.T
    sims[np.arange(60), np.arange(0, 6000, 100)] = -2
    exact = spark.createDataFrame([(int(100 * q), int(i)) for q in range(60) for i in np.argsort(-sims[q], kind="stable")[:10]], "query_id long, vec_id long")
    assert ann.recall(found, exact).first().recall >= 0.9
    assert index.shards == 2 and told["scored"] < 0.25 * told["of"]
    for r in found.limit(30).collect():
        assert r.score == pytest.approx(u[r.query_id] @ u[r.vec_id], abs=1e-6) and r.query_id != r.vec_id


def test_graph_of_copies_nulls_and_nothing(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, None), (101, []), (102, [0.0, 0.0]), (103, [None, 1.0]), (104, [float("nan"), 1.0]), (None, [1.0, 1.0]), (105, [0.0, 2.0])]
    v = spark.createDataFrame(rows, ROWS)
    asked = v.where("vec_id IN (3, 100, 101, 102, 105)").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    index = graph.build(v)
    assert index.vectors.count() == 41
    got = {}
    for r in graph.search(index, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {3, 105} and all(s == 1.0 for _, s in got[3]) and len(got[3]) == len(got[105]) == 5
    empty = graph.build(v.where("false"))
    assert graph.search(empty, asked, 5).count() == 0


def test_cells_find_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    x = centres[rng.integers(0, 20, 1000)] + 0.3 * rng.normal(size=(1000, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 12)], ROWS)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = ann.ivf_search(rows, asked, 10, share=0.3)
    u = unit(x)
    sims = u[::50] @ u.T
    sims[np.arange(20), np.arange(0, 1000, 50)] = -2
    exact = spark.createDataFrame([(int(50 * q), int(i)) for q in range(20) for i in np.argsort(-sims[q], kind="stable")[:10]], "query_id long, vec_id long")
    assert ann.recall(found, exact).first().recall >= 0.9
    whole = ann.ivf_search(rows, asked, 10, share=1.0)  # all cells: exact
    assert ann.recall(whole, exact).first().recall == 1.0
    assert ann.ivf_search(rows.where("false"), asked, 10).count() == 0
