"""Periodic runs of words, found by Karp-Miller-Rosenberg names.

Every position of a text gets a name for the window of 2**k words that begins there, level by level: the name at level k + 1 is
the rank of the pair of names at k, half a window apart. Equal names mean equal windows, so no hashes are involved. How far two
positions go on alike is read off the names from the highest level down, for many pairs of positions at once.

A run of period q and length 3q or more holds two neighbouring blocks of a grid of step q. So for each q the neighbouring grid
points whose names agree at the highest level within q are extended to both sides. What is found with a multiple of a
period is the same stretch again and goes to the least period.

Texts in which no window of the length that any run must repeat stands twice have no run; these, nearly all, end there. Texts
are named together, a few megabytes at a time, with an end mark of its own behind each. A text's memory is some
8 bytes x words x levels, of which there are as many as its longest repeated stretch has doublings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import in_parts, pick, tidy

MIN_LENGTH, TIMES = 24, 3
#: So many grid candidates are compared at once.
GRID = 1 << 19


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, a number of its own behind each text, and where each text begins (and the end)."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.empty(int(starts[-1]), dtype=np.int64)
    for i, t in enumerate(texts):
        codes[starts[i] : starts[i + 1] - 1] = [numbers.setdefault(w, len(numbers)) for w in t]
    codes[starts[1:] - 1] = len(numbers) + np.arange(len(texts))
    return codes, starts


def doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Names of windows twice as long; a window that reaches an end mark is like no other."""
    later = np.zeros_like(names)
    later[: len(names) - step] = names[step:]
    return np.unique(names * (int(names.max()) + 1) + later, return_inverse=True)[1].reshape(-1).astype(np.int64)


def repeats_within(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers of the texts that hold a name twice."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    often = np.flatnonzero(np.bincount(names)[names] > 1)
    keys = np.sort(names[often] * len(starts) + text[often])
    return np.unique(keys[1:][keys[1:] == keys[:-1]] % len(starts)) if len(keys) else np.empty(0, dtype=np.int64)


def grids(n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, left grid point) of all neighbouring grid points of the periods 1 to most, in parts of about GRID pairs."""
    periods = np.arange(1, most + 1)
    counts = (n - 1) // periods
    part = np.cumsum(counts) // GRID
    for p in np.unique(part):
        q, c = periods[part == p], counts[part == p]
        yield np.repeat(q, c), (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)) * np.repeat(q, c)


def runs_of(levels: list[np.ndarray], min_length: int = MIN_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start and period.

    levels: names of windows of 1, 2, 4 ... words, end mark included; at the last level no name stands twice.
    """
    table, n, top = np.stack(levels), len(levels[0]) - 1, len(levels) - 1
    found = []
    for q, left in grids(n, min(n // times, (1 << top) - 1)):
        level = np.frexp(q)[1] - 1
        same = table[level, left] == table[level, left + q]
        q, left = q[same], left[same]
        ahead, back = np.zeros_like(left), np.zeros_like(left)
        for k in range(top - 1, -1, -1):
            right = left + q + ahead
            ok = right <= n
            ok[ok] = table[k, (left + ahead)[ok]] == table[k, right[ok]]
            ahead += ok.astype(np.int64) << k
            at = left - back - (1 << k)
            ok = at >= 0
            ok[ok] = table[k, at[ok]] == table[k, (at + q)[ok]]
            back += ok.astype(np.int64) << k
        start, end = left - back, left + q + ahead
        whole = end - start >= np.maximum(min_length, times * q)
        found.append(np.stack([start, end, q])[:, whole])
    if not found:
        return []
    rows = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.ones(rows.shape[1], dtype=bool)
    first[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)  # of a stretch, the least period
    out = [(int(s), int(e - s), int(q)) for s, e, q in rows[:, first].T]
    return sorted(out, key=lambda r: (r[0], r[2]))


def find(texts: list[list[bytes]], min_length: int = MIN_LENGTH, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """runs_of every text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [i for i, t in enumerate(texts) if len(t) >= min_length]
    if not long:
        return out
    codes, starts = coded([texts[i] for i in long])
    # a run repeats, one period on, a stretch of at least so many words
    least = min(max(min_length, times * q) - q for q in range(1, min_length + 1))
    levels = [codes]
    while (2 << (len(levels) - 1)) <= least:
        levels.append(doubled(levels[-1], 1 << (len(levels) - 1)))
    for j in repeats_within(levels[-1], starts):
        own = [names[starts[j] : starts[j + 1]] for names in levels]
        while len(np.unique(own[-1])) < len(own[-1]):
            own.append(doubled(np.unique(own[-1], return_inverse=True)[1].reshape(-1), 1 << (len(own) - 1)))
        out[long[j]] = runs_of(own, min_length, times)
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run behind its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words long, runs, collapsed), one for each row of docs, whose whole text is read, however long.

    Words are what ASCII white space parts. A run is a stretch of words with smallest period q, at least min_length and
    times * q long, that neither neighbour extends. runs: array of (start, length, period), by start and period. collapsed:
    the words outside of repetitions, joined by single spaces; of a run the first period stays unless another run drops it.
    Null text: no words, no runs, an empty text. Null ids and repeated rows pass through; an empty table gives an empty one;
    of columns whose names clash the first with exactly the name counts. No shuffle: a lost task is run again by itself.
    """
    rows = pick(docs, id_col, text_col).toDF("id", "text").select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in in_parts(batch):
                texts = [x.split() for x in part.column("text").to_pylist()]
                runs = find(texts, min_length, times)
                kept = [b" ".join(np.array(t, dtype=object)[~dropped(len(t), r)].tolist() if r else t) for t, r in zip(texts, runs)]
                told = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs], span)
                columns = [part.column("id"), pa.array(map(len, texts), pa.int64()), told, pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])
        tidy()

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    return rows.mapInArrow(go, schema).select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
