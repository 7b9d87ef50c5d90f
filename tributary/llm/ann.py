"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector, scaled to length one, is projected on a few Gaussian directions (made orthogonal within a table), shifted and cut
into slots of one width; the slots are its bucket in that table. A query visits its own bucket and perturbed ones, in the
order of the summed squared distances from its projections to the slot borders crossed, which is the order of estimated
success. Buckets are joined as equal keys; a bucket of many rows is dealt over several tasks, and the query visits all of
them. Every visit reranks by exact cosine on the original vectors, and each query's best are merged over tables.

Directions and shifts come from a seed; nothing is fitted. A query that finds fewer than k rows is compared with all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import pick, written
from tributary.llm.topk import finite, matrix

BUCKET_BLOCK = 8192
CELL_ROWS = 16384
#: Queries of a bucket that meet its rows in one product: 32 MB with BUCKET_BLOCK rows, however many queries visit it.
QUERIES_AT_ONCE = 512
ROWS_OUT = 2000
_BASE = 64  # slots of one direction that a key tells apart; farther ones share keys, which only adds candidates


def directions(size: int, table: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The (size x hashes) directions and the shifts of one table."""
    rng = np.random.default_rng([seed, table, size])
    gaussian = rng.normal(size=(size, hashes))
    if size >= hashes:
        gaussian = np.linalg.qr(gaussian)[0] * np.sqrt(size)
    return gaussian, rng.uniform(0, width, hashes)


def probes(offsets: np.ndarray, width: float, count: int) -> list[list[tuple[int, int]]]:
    """The first `count` sets of (direction, -1 or 1) in order of estimated success; the first is empty.

    offsets: distances from a query's projections to the lower borders of their slots.
    """
    n = len(offsets)
    costs = np.concatenate([offsets**2, (width - offsets) ** 2])
    order = np.argsort(costs, kind="stable")
    cost, which, step = costs[order].tolist(), (order % n).tolist(), np.where(order < n, -1, 1).tolist()
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(cost[0], (0,))]
    while heap and len(out) < count:
        total, chosen = heapq.heappop(heap)
        if len({which[i] for i in chosen}) == len(chosen):
            out.append([(which[i], step[i]) for i in chosen])
        last = chosen[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id long, vector array<double>), one per id: neither null, zero nor with null or non-finite components.

    Null ids are left out; of repeated rows of one id the least vector counts. Other columns are not read.
    """
    rows = pick(vectors, id_col, vector_col).toDF("id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    return rows.groupBy(F.col("id").cast("long").alias("id")).agg(F.min("vector").alias("vector"))


def bucket_rows(vectors: DataFrame, tables: int, hashes: int, width: float, seed: int, visits: int = 1) -> DataFrame:
    """Rows (size, table, bucket, id, vector): one per vector, table and visited bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _BASE ** np.arange(hashes, dtype=np.int64)
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                flat = part.column(1).flatten().to_numpy().reshape(part.num_rows, size)
                unit = flat / np.abs(flat).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for table in range(tables):
                    lines, shift = directions(int(size), table, hashes, width, seed)
                    places = (unit @ lines + shift) / width
                    slots = np.floor(places)
                    own = ((slots.astype(np.int64) % _BASE) * powers).sum(axis=1)
                    if visits == 1:
                        rows, keys = np.arange(part.num_rows), own
                    else:
                        rows, keys = [], []
                        for i in range(part.num_rows):
                            base = slots[i].astype(np.int64)
                            for chosen in probes((places[i] - slots[i]) * width, width, visits):
                                moved = base.copy()
                                for at, step in chosen:
                                    moved[at] += step
                                rows.append(i)
                                keys.append(int(((moved % _BASE) * powers).sum()))
                        rows, keys = np.array(rows, dtype=np.int64), np.array(keys, dtype=np.int64)
                    for at in range(0, len(rows), ROWS_OUT):
                        some = part.take(pa.array(rows[at : at + ROWS_OUT]))
                        n = some.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, table, np.int32)), pa.array(keys[at : at + ROWS_OUT]), some.column(0), some.column(1)],
                            names=["size", "table", "bucket", "id", "vector"],
                        )

    return vectors.select("id", "vector").mapInArrow(run, "size int, table int, bucket long, id long, vector array<double>")


def best_in_cell(k: int):
    """A cogrouped function: each query's k nearest among the rows of the same bucket, over all buckets of the cell."""
    names = ["query_id", "vec_id", "score"]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if asked.num_rows and held.num_rows:
            keys = [np.stack([t.column(c).to_numpy() for c in ("size", "table", "bucket", "part")], axis=1) for t in (asked, held)]
            _, at = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
            at = at.ravel()
            q_at, h_at = at[: asked.num_rows], at[asked.num_rows :]
            q_order, h_order = np.argsort(q_at, kind="stable"), np.argsort(h_at, kind="stable")
            sizes = asked.column("size").to_numpy()
            q_vectors, h_vectors = asked.column("vector").combine_chunks(), held.column("vector").combine_chunks()
            q_ids, h_ids = asked.column("query_id").to_numpy(), held.column("id").to_numpy()
            groups, starts = np.unique(q_at[q_order], return_index=True)
            ends = [*starts[1:], len(q_order)]
            h_sorted = h_at[h_order]
            for group, start, end in zip(groups, starts, ends):
                a, b = np.searchsorted(h_sorted, [group, group + 1])
                if a == b:
                    continue
                q_rows, h_rows = q_order[start:end], h_order[a:b]
                size = sizes[q_rows[0]]
                q = q_vectors.take(pa.array(q_rows)).flatten().to_numpy().reshape(-1, size)
                h = h_vectors.take(pa.array(h_rows)).flatten().to_numpy().reshape(-1, size)
                q_norm, h_norm = np.sqrt(np.sum(q * q, axis=1)), np.sqrt(np.sum(h * h, axis=1))
                for first in range(0, len(q), QUERIES_AT_ONCE):
                    some_q = slice(first, first + QUERIES_AT_ONCE)
                    near = (q[some_q] @ h.T) / (q_norm[some_q, None] * h_norm)
                    near[q_ids[q_rows[some_q]][:, None] == h_ids[h_rows]] = -np.inf
                    n = near.shape[1]
                    bound = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -2.0)
                    for j in range(len(near)):
                        i = first + j
                        some = np.flatnonzero(near[j] >= max(bound[j] - 1e-9, -2.0))
                        # summed row by row, so that equal vectors get equal scores wherever they stand
                        score = np.sum(h[some] * q[i], axis=1) / (q_norm[i] * h_norm[some])
                        ids = h_ids[h_rows[some]]
                        top = np.lexsort((ids, -score))[:k]
                        found.append(np.rec.fromarrays([np.full(len(top), q_ids[q_rows[i]]), ids[top], score[top]], names=names))
        if not found:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows["vec_id"], -rows["score"], rows["query_id"]))]
        same = (rows["query_id"][1:] == rows["query_id"][:-1]) & (rows["vec_id"][1:] == rows["vec_id"][:-1])
        rows = rows[np.concatenate([[True], ~same])]
        first = np.searchsorted(rows["query_id"], rows["query_id"])
        rows = rows[np.arange(len(rows)) - first < k]
        return pa.table([pa.array(np.ascontiguousarray(rows[c])) for c in names], names=names)

    return run


_FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 16, hashes: int = 8, width: float = 2.0, visits: int = 64, seed: int = 7) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): the k largest cosines found for each query, ties to smaller ids.

    Both tables are as usable() makes them; a query doesn't meet the row of its own id, and vectors meet only vectors of
    their length. Fewer than k candidates give all of them; an empty table gives no rows.
    """
    n = vectors.count()
    cells = max(1, -(-n * tables // CELL_ROWS))
    held = bucket_rows(vectors, tables, hashes, width, seed)
    bucket = ["size", "table", "bucket"]
    large = bucket_rows(vectors, tables, hashes, width, seed).groupBy(*bucket).count().where(F.col("count") > BUCKET_BLOCK)
    large = written(large.select(*bucket, F.ceil(F.col("count") / BUCKET_BLOCK).cast("int").alias("parts")))
    cell = F.pmod(F.xxhash64(*bucket, "part"), F.lit(cells)).cast("int").alias("cell")
    one = F.coalesce("parts", F.lit(1))
    right = held.join(large, bucket, "left").withColumn("part", F.pmod(F.xxhash64("id"), one).cast("int")).select(*bucket, "part", "id", "vector", cell)
    asked = bucket_rows(queries, tables, hashes, width, seed, visits).withColumnRenamed("id", "query_id")
    left = asked.join(large, bucket, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).select(*bucket, "part", "query_id", "vector", cell)
    found = written(_ranked(left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(best_in_cell(k), _FOUND), k))

    # those that found too few meet all rows, in blocks
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = queries.join(enough, "id", "left_anti").select("id", "vector")
    blocks = max(1, -(-n // CELL_ROWS))
    extra = [F.size("vector").alias("size"), F.lit(-1).alias("table"), F.lit(0).cast("long").alias("bucket")]
    left = short.select(*extra, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.col("id").alias("query_id"), "vector").withColumn("cell", F.col("part"))
    right = vectors.select(*extra, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("part"), "id", "vector").withColumn("cell", F.col("part"))
    left = left.toDF(*left.columns)  # columns of its own: both sides may come from one table
    rest = _ranked(left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(best_in_cell(k), _FOUND), k)
    whole = found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
    return whole.unionByName(rest)
