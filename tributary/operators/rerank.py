"""Diversity reranking of candidate lists: MMR, greedy DPP, draws from a k-DPP, round robin over buckets, and diversity measures."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.vectors import dot


def _greedy(lists: DataFrame, k: int, choose) -> DataFrame:
    """lists: list_id, item_id, score, vector (unit length). A list is a bounded candidate set, at most some hundred rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "item_id"], ascending=[False, True]).reset_index(drop=True)
        vectors = np.stack(group["vector"].to_numpy()).astype(float)
        order = choose(group["score"].to_numpy(float), vectors @ vectors.T, min(k, len(group)))
        out = group.loc[order, ["list_id", "item_id"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    kind = {f.name: f.dataType.simpleString() for f in lists.schema}
    return lists.groupBy("list_id").applyInPandas(run, f"list_id {kind['list_id']}, item_id {kind['item_id']}, rank int")


def mmr(lists: DataFrame, k: int = 10, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: trade * score - (1 - trade) * greatest similarity to those chosen."""

    def choose(score: np.ndarray, sim: np.ndarray, n: int) -> list[int]:
        chosen: list[int] = []
        near = np.full(len(score), -np.inf)
        for _ in range(n):
            value = trade * score - (1 - trade) * np.where(np.isinf(near), 0.0, near)
            value[chosen] = -np.inf
            best = int(np.argmax(np.round(value, 9)))
            chosen.append(best)
            near = np.maximum(near, sim[best])
        return chosen

    return _greedy(lists, k, choose)


def dpp(lists: DataFrame, k: int = 10) -> DataFrame:
    """Greedy maximum a posteriori of a determinantal process with kernel exp(s_i) sim_ij exp(s_j)."""

    def choose(score: np.ndarray, sim: np.ndarray, n: int) -> list[int]:
        q = np.exp(score)
        kernel = q[:, None] * sim * q[None, :]
        left, rows, chosen = np.diag(kernel).copy(), np.zeros((0, len(score))), []
        for _ in range(n):
            best = int(np.argmax(np.round(left, 9)))
            if left[best] < 1e-10:
                break
            chosen.append(best)
            row = (kernel[best] - rows[:, best] @ rows) / np.sqrt(left[best])
            rows = np.vstack([rows, row])
            left = left - row**2
            left[chosen] = -np.inf
        return chosen

    return _greedy(lists, k, choose)


def elementary(values: np.ndarray, k: int) -> np.ndarray:
    """e[j, n]: the elementary symmetric polynomial of degree j of the first n values."""
    e = np.zeros((k + 1, len(values) + 1))
    e[0] = 1.0
    for n, v in enumerate(values, 1):
        e[1:, n] = e[1:, n - 1] + v * e[:-1, n - 1]
    return e


def draw_subset(kernel: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """k items of a determinantal process of that size: a subset's probability goes as the determinant of its kernel.

    Eigenvectors are chosen by the elementary polynomials of the eigenvalues; then items are drawn by what the chosen
    ones' span leaves of each. Of a kernel of lower rank only as many items as its rank are drawn.
    """
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    values = np.clip(values / max(values.max(), 1e-300), 0.0, None)  # a common factor changes no probability
    k = min(k, int((values > 1e-10).sum()))
    e = elementary(values, k)
    chosen, left = [], k
    for n in range(len(values), 0, -1):
        if not left:
            break
        if rng.random() * e[left, n] < values[n - 1] * e[left - 1, n - 1]:
            chosen.append(n - 1)
            left -= 1
    span = vectors[:, chosen]
    out: list[int] = []
    while span.shape[1]:
        share = np.clip((span**2).sum(axis=1), 0.0, None)
        share[out] = 0.0
        item = int(np.searchsorted(np.cumsum(share), rng.random() * share.sum(), side="right").clip(max=len(share) - 1))
        out.append(item)
        pivot = int(np.argmax(np.abs(span[item])))
        rest = np.delete(span, pivot, axis=1) - np.outer(span[:, pivot] / span[item, pivot], np.delete(span[item], pivot))
        span = np.linalg.qr(rest)[0] if rest.shape[1] else rest
    return out


def kdpp(lists: DataFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """Draws k items a list from a determinantal process with kernel exp(s_i) sim_ij exp(s_j), ranked by score.

    The draw of a list depends on its id, its rows and the seed alone. Lists as in mmr and dpp; scores are taken relative to
    the list's best, which changes no probability.
    """
    kind = {f.name: f.dataType.simpleString() for f in lists.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "item_id"], ascending=[False, True]).reset_index(drop=True)
        vectors = np.stack(group["vector"].to_numpy()).astype(float)
        q = np.exp(group["score"].to_numpy(float) - group["score"].max())
        rng = np.random.default_rng([seed, zlib.crc32(str(group["list_id"].iloc[0]).encode())])
        out = group.loc[sorted(draw_subset(q[:, None] * (vectors @ vectors.T) * q[None, :], min(k, len(group)), rng)), ["list_id", "item_id"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    return lists.groupBy("list_id").applyInPandas(run, f"list_id {kind['list_id']}, item_id {kind['item_id']}, rank int")


def round_robin(lists: DataFrame, bucket: str, k: int, cap: int | None = None) -> DataFrame:
    """The best of every bucket, then the second of every bucket, and so on; at most cap of a bucket."""
    inner = Window.partitionBy("list_id", bucket).orderBy(F.col("score").desc(), "item_id")
    rows = lists.withColumn("turn", F.row_number().over(inner))
    if cap:
        rows = rows.where(F.col("turn") <= cap)
    outer = Window.partitionBy("list_id").orderBy("turn", F.col("score").desc(), "item_id")
    return rows.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k)


def diversity(lists: DataFrame, bucket: str) -> DataFrame:
    """By list: mean pairwise cosine distance and number of buckets. Lists are short; vectors have unit length."""
    a = lists.select("list_id", F.col("item_id").alias("i"), F.col("vector").alias("v"))
    b = lists.select("list_id", F.col("item_id").alias("j"), F.col("vector").alias("u"))
    far = a.join(b, "list_id").where("i < j").groupBy("list_id").agg(F.round(F.avg(1.0 - dot("v", "u")), 6).alias("mean_distance"))
    return lists.groupBy("list_id").agg(F.count_distinct(bucket).alias("buckets")).join(far, "list_id", "left")
