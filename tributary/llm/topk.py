"""Exact top-k by integer inner product with the no-random-access algorithm, in blocks.

Each block of candidates holds one list per dimension, sorted by value. A query reads the lists of its positive
components from the top and those of its negative components from the bottom, all to the same depth. What has been read
and the frontier give every candidate a lower and an upper bound of its score; the lists are read deeper until all but a
few candidates have upper bounds below the k-th best lower bound, and only those few get their final scores. Bounds for a
block of queries are two matrix products a depth. Blocks of queries meet blocks of candidates in a grid of tasks of
bounded size, so a task's memory doesn't grow with the tables; the k best of each block are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import pick

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16384
QUERIES_AT_ONCE = 256
DEPTHS = (1 / 2, 3 / 4, 7 / 8, 1)
FEW = 64


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))


def scaled(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id long, vector array<long>) of floor(scale * x); one row per id.

    Null ids, and vectors null or with null or non-finite components, are left out. Of repeated rows of one id the least
    vector counts. Other columns are not read.
    """
    rows = pick(vectors, id_col, vector_col).toDF("id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("vector")))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.transform("vector", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("vector"))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, larger scores first, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def nra_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best of these candidates for each query; rows of the query's own id don't count."""
    n = len(ids)
    values = vectors.astype(np.float64)
    order = np.argsort(values, axis=0, kind="stable")
    lists = np.take_along_axis(values, order, axis=0)  # ascending
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    out = []
    todo = np.arange(len(query_ids))
    for depth in DEPTHS:
        read = min(n, max(1, int(np.ceil(depth * n))))
        last = read == n
        from_top, from_bottom = place >= n - read, place < read
        upper_side = np.hstack([np.where(from_top, values, lists[n - read]), np.where(from_bottom, values, lists[read - 1])]).T
        lower_side = upper_side if last else np.hstack([np.where(from_top, values, lists[0]), np.where(from_bottom, values, lists[-1])]).T
        later = []
        for at in range(0, len(todo), QUERIES_AT_ONCE):
            rows = todo[at : at + QUERIES_AT_ONCE]
            signed = queries[rows].astype(np.float64)
            signed = np.hstack([np.maximum(signed, 0), np.minimum(signed, 0)])
            own = query_ids[rows][:, None] == ids[None, :]
            lower = signed @ lower_side
            lower[own] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if k < n else np.full(len(rows), -np.inf)
            if not last:
                upper = signed @ upper_side
                upper[own] = -np.inf
            else:
                upper = lower
            alive = upper >= kth[:, None]
            alive &= ~own
            left = alive.sum(axis=1)
            for i, row in enumerate(rows):
                if not last and left[i] > max(FEW, 4 * k):
                    later.append(row)
                    continue
                found = np.flatnonzero(alive[i])
                scores = vectors[found] @ queries[row]
                for j in best_of(ids[found], scores, k):
                    out.append((query_ids[row], ids[found[j]], scores[j]))
        todo = np.array(later, dtype=np.int64)
        if not len(todo):
            break
    return out


def search(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): each query's k highest inner products, ties to smaller ids.

    Both tables have (id long, vector array<long>) with one row per id, as scaled() makes them; a query doesn't meet the
    row of its own id. Vectors meet only vectors of their length. Fewer than k candidates give all of them; an empty table
    gives no rows. Scores are exact while they stay below 2**53.
    """
    n = candidates.count()
    n_queries = queries.count()
    cells, blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    key = ["_block", "_cell", "_size"]
    left = queries.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_cell"), F.size("vector").alias("_size"))
    right = candidates.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("_cell"), F.size("vector").alias("_size"))
    names = ["query_id", "vec_id", "score"]

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        rows: list = []
        if asked.num_rows and block.num_rows:
            rows = nra_block(asked.column("id").to_numpy(), matrix(asked, "vector"), block.column("id").to_numpy(), matrix(block, "vector"), k)
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.table([pa.array(np.array(c, dtype=np.int64)) for c in columns], names=names)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
