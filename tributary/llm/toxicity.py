"""Toxicity by compression distance with two zstandard dictionaries.

Both dictionaries are trained by zstandard: the ordinary one on windows of ordinary texts, the toxic one on windows of toxic texts.
Most of a toxic text is ordinary, too, and a dictionary trained on its whole windows holds ordinary words above all. So a window
goes into the toxic training without the words that ordinary windows explain: only those stay that hold a telling piece, PIECE
bytes of a word that are TIMES as frequent in toxic windows as in ordinary ones and stand in LEAST_SHARE of the toxic windows.
What zstandard makes of these samples is used whole. The ordinary dictionary stands first in both contents, so that ordinary
words cost the same in both; behind it stands the toxic dictionary, or as many zero bytes. A window's gain is how much shorter
the toxic dictionary makes it. The three largest gains of a text, the numbers of its windows with gains above each of LEVELS and
the number of its windows are calibrated by a logistic curve.

The model is fitted on a bounded sample: `sample` labelled rows of each class, by hash of the id, and of these `sample_windows`
windows of toxic texts and twice as many of ordinary ones, by hash. For the calibration the texts of each half of the sample are
measured with dictionaries of the other half; the model's own dictionaries are then trained on both. Everything fitted is some 66 kilobytes and goes to the tasks with the function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import in_parts, pick, tidy, written

WINDOW = 64
SAMPLE = 4000
SAMPLE_WINDOWS = 40_000
BASE_BYTES, TOXIC_BYTES = 65_536, 1024
PIECE, TIMES, LEAST_SHARE, LEAST_COUNT = 6, 30, 0.001, 3
#: Gains that windows are counted by.
LEVELS = (2, 3, 4, 5)
N_FEATURES = 5 + len(LEVELS)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Runs of whole words of `size` bytes or a word more, each with a space at both ends."""
    out, run, n = [], [], 0
    for w in words:
        run.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" " + b" ".join(run) + b" ")
            run, n = [], 0
    if run:
        out.append(b" " + b" ".join(run) + b" ")
    return out


def sizer(content: bytes):
    """A function from a window to its compressed length with this dictionary content."""
    params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=6, target_length=0, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress
    return lambda w: len(compress(w))


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary of at most `size` bytes that zstandard trains on the samples; the samples themselves where they are too few.

    Its leading bytes, a magic number and entropy tables, count as content like the rest: they match nothing.
    """
    try:
        return zstandard.train_dictionary(max(512, min(size, sum(map(len, samples)) // 3)), samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def pieces(word: bytes) -> set[bytes]:
    """Runs of PIECE bytes of a word with a space at both ends; the whole of a shorter one."""
    w = b" " + word + b" "
    return {w[i : i + PIECE] for i in range(max(1, len(w) - PIECE + 1))}


def telling_samples(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Toxic windows without the words that have no telling piece; windows that keep no word are left out.

    A piece counts once for each different word of a window that holds it.
    """

    def counted(windows_of: list[bytes], wanted: set[bytes] | None = None) -> Counter:
        words: Counter = Counter()
        for w in windows_of:
            words.update(set(w.split()))
        out: Counter = Counter()
        for word, n in words.items():
            for p in pieces(word):
                if wanted is None or p in wanted:
                    out[p] += n
        return out

    least = max(LEAST_COUNT, LEAST_SHARE * len(toxic))
    often = {p: n for p, n in counted(toxic).items() if n >= least}
    usual = counted(ordinary, set(often))
    telling = {p for p, n in often.items() if n * len(ordinary) > TIMES * (usual[p] + 0.5) * len(toxic)}
    kept = ([x for x in w.split() if not telling.isdisjoint(pieces(x))] for w in toxic)
    return [b" " + b" ".join(k) + b" " for k in kept if k]


def gains(base: bytes, content: bytes):
    """A function from a window to how much shorter the toxic dictionary makes it."""
    plain, toxic = sizer(base + bytes(len(content))), sizer(base + content)
    return lambda w: plain(w) - toxic(w)


@dataclass
class Model:
    """Dictionary contents and the calibration: score = logistic(weights . features)."""

    base: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES)

    def features(self, gain, text: str | None) -> list[float]:
        found = sorted(map(gain, windows(words_of(text))), reverse=True) if self.toxic else []
        top = [*(max(g, 0) for g in found[:3]), 0, 0, 0][:3]
        return [1.0, *map(float, top), *(float(np.log1p(sum(g >= t for g in found))) for t in LEVELS), float(np.log1p(len(found)))]


def _mapped(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows through run(record batch of bounded bytes) -> record batch."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch):
                yield run(part)
        tidy()

    return rows.mapInArrow(go, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method with a ridge on all but the first."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_windows: int = SAMPLE_WINDOWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows: label 1 toxic, 0 ordinary, null labels left out; ids without a text too.

    At most `sample` rows of each class are used, those of least hash of the id. Without both classes the score is the
    share of toxic labels.
    """
    known = pick(labels, id_col, label_col).toDF("id", "y").where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    chosen = known.where("y = 1").orderBy(order, "id").limit(sample).unionByName(known.where("y = 0").orderBy(order, "id").limit(sample))
    texts = pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.col("text").cast("string")).where("id IS NOT NULL")
    # at most 2 * sample ids, so the broadcast is bounded
    rows = written(texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).withColumn("part", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("half")), F.lit(2))))
    model = Model()
    n_toxic, n_plain = counts.get(1, 0), counts.get(0, 0)
    model.weights[0] = float(np.log((n_toxic + 0.5) / (n_plain + 0.5)))
    sizes = {(r.part, r.y): r.n for r in rows.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    if not all(sizes.get((part, y)) for part in (0, 1) for y in (0, 1)):
        return model

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w for x in part.column(0).to_pylist() for w in windows(words_of(x))], pa.binary())], names=["w"])

    def dictionaries(some: DataFrame) -> tuple[bytes, bytes]:
        def drawn(y: int, n: int) -> list[bytes]:
            rows_of = _mapped(some.where(f"y = {y}").select("text"), cut, "w binary")
            return [bytes(r.w) for r in rows_of.orderBy(F.xxhash64("w"), "w").limit(n).collect()]

        ordinary = drawn(0, 2 * sample_windows)
        telling = telling_samples(drawn(1, sample_windows), ordinary)
        return trained(ordinary[: len(ordinary) // 2] or ordinary, BASE_BYTES, 64, 8), trained(telling, TOXIC_BYTES, 16, 6) if telling else b""

    def measured(base: bytes, toxic: bytes, some: DataFrame) -> list:
        def go(part: pa.RecordBatch) -> pa.RecordBatch:
            gain, one = gains(base, toxic), Model(base, toxic)
            x = [one.features(gain, text) for text in part.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column(1)], names=["x", "y"])

        return _mapped(some.select("text", "y"), go, "x array<double>, y int").collect()

    # each half's texts are measured with the dictionaries of the other one
    got = [r for part in (0, 1) for r in measured(*dictionaries(rows.where(f"part = {part}")), rows.where(f"part = {1 - part}"))]
    x, y = np.array([r.x for r in got]).reshape(len(got), N_FEATURES), np.array([r.y for r in got], dtype=float)
    model.base, model.toxic = dictionaries(rows)
    if model.toxic and 0 < y.sum() < len(y):
        w = logistic(x, y)
        w[0] += model.weights[0] - np.log(y.sum() / (len(y) - y.sum()))  # from the sample's share of toxic rows to that of all labels
        model.weights = w.tolist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """Rows (id, score double), or with whole_rows all columns of docs by place and the score behind; one for each row of docs.

    Whole texts are scored, however long, with no shuffle: a text is cut into windows in one task, a few rows at a time.
    Repeated rows and null ids pass through, a null text counts as empty, and an empty table gives an empty one. Columns
    whose names clash are told apart by place; a column named score stays beside the new one.
    """
    weights = np.array(model.weights)
    names = list(docs.columns) if whole_rows else [id_col]
    if whole_rows:
        flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
        rows = flat.withColumn("_text", F.col(f"_{names.index(text_col)}").cast("string"))
    else:
        rows = pick(docs, id_col, text_col).toDF("_0", "_text").withColumn("_text", F.col("_text").cast("string"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains(model.base, model.toxic) if model.toxic else None
        for batch in batches:
            for part in in_parts(batch):
                x = np.array([model.features(gain, text) for text in part.column("_text").to_pylist()]).reshape(-1, len(weights))
                kept = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))], names=[*(f"_{i}" for i in range(len(names))), "_score"])
        tidy()

    schema = ", ".join(f"_{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(names)))
    return rows.mapInArrow(go, f"{schema}, _score double").toDF(*names, "score")


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts."""
    return F.crc32(id_column.cast("string").cast("binary")) % parts
