"""The nearest unseen places of what a user liked, against all of them."""

import numpy as np
import pytest

from tributary.operators import factors
from tributary.plans import search
from tributary.sources import durable


@pytest.mark.parametrize("k", [1, 4])
def test_lists_are_cut_and_lose_nothing(spark, k):
    """With seen items before and between the nearest, and equal distances."""
    rng = np.random.default_rng(3)
    pairs = [(a, b, float(rng.integers(0, 6)) / 8) for a in range(12) for b in range(60) if rng.random() < 0.6]
    likes = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 15, 60), rng.integers(0, 12, 60))})
    seen = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 12, 150), rng.integers(0, 60, 150))} | {(0, b) for b in range(57)})
    want = set()
    for u in range(15):
        far = {}
        for a, b, d in pairs:
            if (u, a) in likes and (u, b) not in seen:
                far[b] = min(d, far.get(b, 9.0))
        want |= {(u, n + 1, b, far[b]) for n, b in enumerate(sorted(far, key=lambda b: (far[b], b))[:k])}
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    found = search.nearest_unseen(table(likes, "user_id long, item_id int"), table(pairs, "a int, b int, distance double"), table(seen, "user_id long, item_id int"), k)
    assert {tuple(r) for r in found.select("user_id", "rank", "item_id", "distance").collect()} == want


def test_rounds_of_factors_leave_no_shuffles(spark, monkeypatch):
    """F22, F24."""
    held = []
    real = durable.Durable.__init__
    monkeypatch.setattr(durable.Durable, "__init__", lambda self, s, tidy=False: held.append(tidy) or real(self, s, tidy))
    likes = spark.createDataFrame([(1, 1), (2, 2)], "user_id long, item_id int")
    factors.bpr(likes, likes.select("item_id"), 2, 1)
    assert held == [True]
