"""Quality by random Fourier features, ridge regression and isotonic calibration.

Every text becomes a few dozen statistics. Standardised, they go through random Fourier features, whose inner products
approximate a Gaussian kernel. Each partition of the labelled rows sums its part of the normal equations; the sums are
added up in two levels, so the driver gets at most SUMS small matrices, and solves for the ridge weights. Scores of the
labelled rows, counted in bins, are made monotone by pooling adjacent violators, which gives the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import in_parts, pick, written

FEATURES = 256
SUMS = 16
ROWS_A_SUM = 50_000
BINS = 2000

_KIND = np.zeros(256, np.int64)  # of each byte
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"|", b"#$%&*", b"<>{}[]()/\\=_+-~^@", b"'\"`"), start=1):
    _KIND[list(_chars)] = _i
_KIND[128:] = 12
KINDS = 13


def statistics(text: str | None) -> list[float]:
    """What the classifier sees of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=KINDS) / max(n, 1)
    share = counts[counts > 0] / max(n, 1)
    words = raw.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    once = set(words)
    upper = sum(map(bytes.isupper, words)) / w
    marked = sum(not x[-1:].isalpha() and x[-1] < 128 and x[-1:] not in b".," for x in words) / w
    stops = sum(x[-1:] in b".!?" for x in words) / w
    lines = [x for x in raw.split(b"\n") if x.strip()]
    alike = 1 - len(set(lines)) / max(len(lines), 1)
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    return [
        *kinds.tolist(), float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), float(lengths.max()) ** 0.5,
        len(once) / w, pairs, upper, marked, stops, alike, float(np.log1p(len(lines))), len(words) / max(len(lines), 1) / 100, float(-(share * np.log2(share)).sum()),
    ]


SIZE = len(statistics(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    lines: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.lines + self.shift
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / self.lines.shape[1]) * np.cos(z)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def pooled(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares increasing step curve through (at, mean): pooled adjacent violators."""
    blocks: list[list[float]] = []
    for x, m, w in zip(at, mean, weight):
        blocks.append([m, w, x * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, x2 = blocks.pop()
            m1, w1, x1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, x1 + x2])
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, x array<double>) of every row's statistics; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))], names=["id", "x"])

    rows = pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def fit(rows: DataFrame, ridge: float = 1.0, width: float = 6.0, seed: int = 3) -> Model:
    """A model from rows (x array<double>, y 0 or 1). Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    lines, shift = rng.normal(size=(SIZE, FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES)
    moments = rows.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n")).collect()
    mean, scale, n = np.zeros(SIZE), np.ones(SIZE), 0
    for r in moments:
        mean[r.i], scale[r.i], n = r.m, max(r.s, 1e-6), r.n
    model = Model(mean, scale, lines, shift, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not n:
        return model

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((FEATURES + 2, FEATURES + 2)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = np.hstack([model.mapped(_matrix(part)), part.column("y").to_numpy().astype(np.float64)[:, None]])
                total += z.T @ z
                number = hash((number, part.num_rows, float(z[0].sum()))) % SUMS
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "total"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in group.column("total").to_pylist())
        return pa.table({"g": group.column("g").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x", F.col("y").cast("double").alias("y")).repartition(max(1, -(-n // ROWS_A_SUM)))
    sums = parts.mapInArrow(normal, "g int, total binary").groupBy("g").applyInArrow(add, "g int, total binary").collect()
    total = sum(np.frombuffer(bytes(r.total), np.float64) for r in sums).reshape(FEATURES + 2, FEATURES + 2)
    penalty = np.full(FEATURES + 1, ridge)
    penalty[0] = 1e-6
    model.weights = np.linalg.solve(total[:-1, :-1] + np.diag(penalty), total[:-1, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = np.round(np.clip(model.raw(_matrix(batch)), -1, 2) * BINS / 3).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], names=["bin", "y"])

    counted = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("m"), F.count("*").alias("n")).orderBy("bin").collect()
    model.at, model.value = pooled(np.array([r.bin * 3 / BINS for r in counted]), np.array([r.m for r in counted]), np.array([float(r.n) for r in counted]))
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows (id, score double), one for each row of docs, learned from the given labels (1 good, 0 not, null left out).

    Null ids are scored but not learned from; of several labels of one id the greatest counts, and each row of that id is
    learned from. Empty and null texts are scored as empty, and an empty table gives an empty one. Whole texts are
    measured, however long, a few rows at a time. Other columns are not read.
    """
    rows = written(measured(docs, id_col, text_col))
    known = pick(labels, id_col, label_col).toDF("id", "y").where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    model = fit(written(rows.join(known, "id").select("x", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(_matrix(batch)))], names=[id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, score double")
