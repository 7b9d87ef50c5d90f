"""Search in layered neighbour graphs (HNSW), held as tables and walked in tasks, a shard and a group of queries in each.

Vectors are dealt by hash to shards of bounded size. Each shard gets a graph of its own: a node stands in layer 0 and, with
probability 1 / M each time, in the next one up; in every layer it has links to near nodes that are nearer to it than to
each other, and to some that link to it. A search enters each shard at its top layer, goes down greedily, and widens to a beam in
layer 0; a round follows the links of the beam's best unvisited nodes. Shards' answers are merged. A shard moves once for each
group of queries, a query once for each shard; whoever is scored is scored once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.vectors import normalized
from tributary.operators.blocks import rounded
from tributary.operators.recommend import top_k
from tributary.sources.durable import Durable

#: Links of a node in its own right, and rows of a shard: its products are worked out in slices by one task.
LINKS, SHARD = 16, 16_384
#: Queries that meet a shard in one task.
QUERIES = 512
GRAPH = "shard int, layer int, node long, links array<long>"


def level_of(node: int, m: int) -> int:
    """The highest layer of a node, by its id: layer l or higher with probability m ** -l."""
    u = (zlib.crc32(str(node).encode()) + 0.5) / 2**32
    return int(-math.log(u) / math.log(m))


def spread_links(sims: np.ndarray, among: np.ndarray, m: int) -> list[int]:
    """Of candidates, nearest first: up to m that are nearer to the node than to any taken before, then the nearest others.

    sims: to the node; among: to each other. Returns places.
    """
    taken: list[int] = []
    for j in range(len(sims)):
        if len(taken) == m:
            break
        if not taken or among[j, taken].max() < sims[j]:
            taken.append(j)
    rest = [j for j in range(len(sims)) if j not in set(taken)]
    return taken + rest[: m - len(taken)]


def layer_links(x: np.ndarray, m: int, slice_rows: int = 1024) -> list[list[int]]:
    """The links of every row of x (unit vectors) among the others, up to 3 m: its own m, then the nearest that link to it."""
    n = len(x)
    own: list[list[int]] = []
    near: list[dict[int, float]] = []
    wide = min(n - 1, 4 * m)
    for at in range(0, n, slice_rows):
        sims = x[at : at + slice_rows] @ x.T
        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -np.inf
        for i in range(len(sims)):
            c = np.argpartition(-sims[i], wide - 1)[:wide] if wide else np.empty(0, dtype=int)
            c = c[np.lexsort((c, -sims[i, c]))]
            places = spread_links(sims[i, c], x[c] @ x[c].T, m)
            own.append([int(c[p]) for p in places])
            near.append({int(c[p]): float(sims[i, c[p]]) for p in places})
    back: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in own[i]:
            if i not in near[j]:
                back[j].append((-near[i][j], i))
    return [own[i] + [j for _, j in sorted(back[i])[: 3 * m - len(own[i])]] for i in range(n)]


def shard_graph(nodes: np.ndarray, x: np.ndarray, m: int) -> Iterator[tuple[int, int, list[int]]]:
    """(layer, node, links) of all layers of one shard; the topmost layer is the last that has a node."""
    levels = np.array([level_of(int(n), m) for n in nodes])
    for layer in range(int(levels.max()) + 1):
        at = np.flatnonzero(levels >= layer)
        for i, links in enumerate(layer_links(x[at], m)):
            yield layer, int(nodes[at[i]]), [int(nodes[at[j]]) for j in links]


@dataclass
class Index:
    """vectors: shard, node, v (unit length); graph: shard, layer, node, links; both written tables."""

    vectors: DataFrame
    graph: DataFrame
    shards: int
    layers: int


def build(vectors: DataFrame, m: int = LINKS, shard_rows: int = SHARD) -> Index:
    """An index of vectors (vec_id, v) by cosine. Every row is indexed but null, empty and zero vectors, which are near nothing.

    Ids are unique; all vectors have the same length. A shard is one task's work, about shard_rows rows whatever the data,
    as ids are dealt by hash.
    """
    held = Durable(vectors.sparkSession)
    whole = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("node"), normalized("v").alias("v"))
    whole = whole.where(F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c)))
    n = whole.count()
    shards = max(1, math.ceil(n / shard_rows))
    dealt = held.keep(whole.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "v"))

    def links(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        nodes = part.column("node").to_numpy()
        x = np.array(part.column("v").to_pylist(), dtype=np.float64).reshape(len(nodes), -1)
        shard = part.column("shard")[0].as_py()
        rows = list(shard_graph(nodes, x, m))
        return pa.table({"shard": pa.array([shard] * len(rows), pa.int32()), "layer": pa.array([r[0] for r in rows], pa.int32()), "node": pa.array([r[1] for r in rows], pa.int64()), "links": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

    graph = held.keep(dealt.groupBy("shard").applyInArrow(links, GRAPH))
    return Index(dealt, graph, shards, (graph.agg(F.max("layer")).first()[0] or 0) + 1)


class Walker:
    """A shard's graph in a task: unit vectors by place, links by layer and place."""

    def __init__(self, part: pa.Table, graph: pa.Table):
        self.nodes = part.column("node").to_numpy()
        self.x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(self.nodes), -1)
        order = np.argsort(self.nodes, kind="stable")
        self.nodes, self.x = self.nodes[order], self.x[order]
        layers, at = graph.column("layer").to_numpy(), np.searchsorted(self.nodes, graph.column("node").to_numpy())
        lists = graph.column("links").combine_chunks()
        flat, ends = np.searchsorted(self.nodes, lists.flatten().to_numpy(zero_copy_only=False)), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.links: list[dict[int, np.ndarray]] = [{} for _ in range(int(layers.max()) + 1)]
        for i in range(len(at)):
            self.links[layers[i]][int(at[i])] = flat[ends[i] : ends[i + 1]]

    def walk(self, q: np.ndarray, beam: int, wide: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, rounds) of all nodes that were scored on the way from the top layer down."""
        known = np.array(sorted(self.links[-1]), dtype=np.int64)
        scores = self.x[known] @ q
        met = np.zeros(len(self.nodes), dtype=bool)
        met[known] = True
        rounds = 0
        for layer in range(len(self.links) - 1, -1, -1):
            size, step = (beam, wide) if layer == 0 else (1, 1)
            followed = np.zeros(len(self.nodes), dtype=bool)  # what is known is looked at again in each layer
            while True:
                best = np.argpartition(-scores, size - 1)[:size] if len(scores) > size else np.arange(len(scores))
                if len(scores) > size:  # ties at the end go to the smaller place
                    least = scores[best].min()
                    best = np.flatnonzero(scores >= least)
                best = best[np.lexsort((known[best], -scores[best]))][:size]
                front = known[best][~followed[known[best]]][:step]
                if not len(front):
                    break
                rounds += 1
                followed[front] = True
                new = np.unique(np.concatenate([self.links[layer].get(int(n), known[:0]) for n in front]))
                new = new[~met[new]]
                if len(new):
                    met[new] = True
                    known, scores = np.concatenate([known, new]), np.concatenate([scores, self.x[new] @ q])
        return known, scores, rounds


def search(index: Index, queries: DataFrame, k: int, beam: int = 64, wide: int = 8, told: dict | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k of greatest cosine found for queries (query_id, q), the query's own id left out.

    A group of queries meets a shard, its vectors and its graph in one task, whose size is bounded by that of shards and groups;
    a query walks alone there. beam: how many of the best nodes of layer 0 of a shard have their links followed; wide: how many
    of them in a round. Ties go to the smaller id. A query that can't be compared gets no rows. told, if given, gets the
    greatest number of rounds and the number of scored (query, row) pairs beside all there are.
    """
    held = Durable(queries.sparkSession)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), normalized("q").alias("v")).where((F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c)))
    asked = held.keep(asked)
    groups = max(1, math.ceil(asked.count() / QUERIES))
    all_of = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    everywhere = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("crowd")).select("crowd", "query_id", "v", all_of(index.shards, "shard"))
    # vectors and links of a shard in one table: layer -1 stands for a node's vector
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    known = index.vectors.select("shard", F.lit(-1).alias("layer"), "node", none("array<long>", "links"), "v").unionByName(index.graph.select("shard", "layer", "node", "links", none("array<double>", "v")))
    known = known.select("*", all_of(groups, "crowd"))

    def go(key: tuple, mine: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if mine.num_rows and rows.num_rows:
            layers = rows.column("layer").to_numpy()
            walker = Walker(rows.filter(pa.array(layers < 0)), rows.filter(pa.array(layers >= 0)))
            for q, v in zip(mine.column("query_id").to_pylist(), mine.column("v").to_pylist()):
                at, scores, rounds = walker.walk(np.array(v, dtype=np.float64), beam, wide)
                n_scored = len(at)
                ids, scores = walker.nodes[at], rounded(scores)
                ids, scores = ids[ids != q], scores[ids != q]
                best = np.lexsort((ids, -scores))[:k]
                for column, some in zip(out, ([q] * len(best), ids[best].tolist(), scores[best].tolist(), [rounds] * len(best), [n_scored] * len(best))):
                    column += some
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=["query_id", "vec_id", "score", "rounds", "scored"]).append_column("shard", pa.array([key[0].as_py()] * len(out[0]), pa.int32()))

    found = everywhere.groupBy("shard", "crowd").cogroup(known.groupBy("shard", "crowd")).applyInArrow(go, "query_id long, vec_id long, score double, rounds int, scored int, shard int")
    if told is not None:
        found = held.keep(found)
        each = found.groupBy("query_id", "shard").agg(F.max("rounds").alias("rounds"), F.max("scored").alias("scored")).agg(F.max("rounds"), F.sum("scored")).first()
        told.update(rounds=each[0] or 0, scored=each[1] or 0, of=asked.count() * index.vectors.count())
    return top_k(found, k, F.col("score").desc(), F.col("vec_id"), by="query_id").select("query_id", "rank", "vec_id", "score")
