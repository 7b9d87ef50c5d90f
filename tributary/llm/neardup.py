"""MinHash near-duplicates with sequential Bayesian verification.

Documents of equal shingle sets are one class, told by a digest of the set. Bands of the representatives' MinHash
signatures give candidates, tried in two rounds. The first tries one pair for each document, with the least member of one
of its groups, and joins what is linked into components. The second takes the documents of groups that still hold more than
one component. Among these, two documents of different components can only reach the similarity if they share a shingle
that stands early enough in both when shingles are put in one common order, those of a single component and rare ones
first. Pairs that share such a shingle are the candidates: none that links components is lost, and a large group of copies
doesn't make all its pairs.

Most bands occur once. They are counted by key alone, and a bitmap of the repeated ones spares the others the shuffle.
Signatures hold 16 bits a value; chance equality (2**-16) only makes pruning a little milder.

A candidate pair's signatures are compared batch by batch; it goes as soon as the posterior probability that its
similarity reaches the threshold, under a uniform prior, falls below the chosen miss probability. What is left is confirmed
on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import components, discard, in_parts, maybe_in, pick, tidy, written

BANDS, ROWS = 45, 7
BATCH = 45
SHINGLES_OUT = 1 << 18
MEMO_WORDS = 1 << 17
MEMO_BYTES = 64
_U = np.uint64


class WordHashes(dict):
    """Word -> 64-bit hash. Holds at most MEMO_WORDS words of at most MEMO_BYTES bytes, then starts anew."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = out
        return out


_HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words has its whole sequence as one."""
    words = words_of(text)
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - n + 1, _U)
        for i in range(n):
            total += (h[i : len(h) - n + 1 + i] ^ _U(n)) * _U(2 * i * 0x632BE59BD9B4E019 % 2**64 | 1)
        return np.unique(mixed(total))


def signer(size: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    flips = rng.integers(0, 2**32, size, dtype=np.uint64).astype(np.uint32)
    factors = (rng.integers(0, 2**32, size, dtype=np.uint64) | _U(1)).astype(np.uint32)

    def sign(found: np.ndarray) -> np.ndarray:
        """MinHash values of a set of hashes, in pieces so that a long text needs little memory."""
        low = found.astype(np.uint32)
        out = np.full(size, 2**32 - 1, np.uint32)
        for at in range(0, len(low), 512):
            x = (low[at : at + 512, None] ^ flips) * factors
            x ^= x >> np.uint32(15)
            np.minimum(out, (x * factors).min(axis=0), out=out)
        return out

    return sign


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, d1, d2, signature binary: 16-bit values, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(BANDS * ROWS)
        for batch in batches:
            for part in in_parts(batch):
                counts, d1, d2, signs = [], [], [], []
                for text in part.column(2).to_pylist():
                    found = shingles(text, width)
                    counts.append(len(found))
                    digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else bytes(16)
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                    signs.append(sign(found).astype("<u2").tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signs, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "d1", "d2", "signature"],
                )
        _HASHES.clear()
        tidy()

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, d1 long, d2 long, signature binary")


def least_matches(percent: int, miss: float) -> list[int]:
    """By batches compared: how many equal values a pair needs for a posterior of at least `miss` to reach the threshold."""
    t = percent / 100
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:  # P(Beta(m + 1, n - m + 1) >= t) is a binomial sum
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def plausible(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Those of the pairs (a, b, with signatures sa, sb) that sequential comparison doesn't rule out."""
    need = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, least in enumerate(need):
                cut = slice(i * BATCH, (i + 1) * BATCH)
                equal[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
                alive = alive[equal[alive] >= least]
            keep = batch.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([keep.column(c) for c in ("a", "ka", "b", "kb")], names=["a", "ka", "b", "kb"])

    return pairs.select("a", "ka", "b", "kb", "sa", "sb").mapInArrow(run, "a long, ka long, b long, kb long")


def _texts(docs: DataFrame, ends: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key, text) of the documents named by ends (id, key); repeated rows once."""
    texts = pick(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    texts = maybe_in(texts, "id", ends.select("id"))
    return texts.join(ends.hint("merge"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("id", "key", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of the pairs (a, ka, b, kb) whose full shingle sets reach the similarity: rows (a, b)."""
    ends = pairs.select(F.col("a").alias("id"), F.col("ka").alias("key")).unionByName(pairs.select(F.col("b").alias("id"), F.col("kb").alias("key"))).distinct()
    texts = written(_texts(docs, ends, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, _U)
        for batch in batches:
            for part in in_parts(batch):
                good = []
                for i, (b, kb, ta, tb) in enumerate(zip(*(part.column(c).to_pylist() for c in ("b", "kb", "ta", "tb")))):
                    if (b, kb) != last:
                        last, held = (b, kb), shingles(tb, width)
                    own = shingles(ta, width)
                    both = len(np.intersect1d(own, held, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(held) - both):
                        good.append(i)
                keep = part.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([keep.column("a"), keep.column("b")], names=["a", "b"])
        _HASHES.clear()
        tidy()

    joined = pairs.join(texts.toDF("a", "ka", "ta").hint("merge"), ["a", "ka"]).join(texts.toDF("b", "kb", "tb").hint("merge"), ["b", "kb"])
    return joined.select("a", "b", "kb", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs.

    Documents are linked when 100 * |both| >= percent * |either| of their shingle sets; component_id is the smallest
    doc_id reachable. A null text or one without words has no shingles and is linked with nothing. Rows of equal id are
    judged each by its own text: equal texts share a class, different ones can be of several, kept in one and not in another. A row without id is linked with nothing: component_id null, kept true. Other
    columns aren't read, an empty table gives an empty one, and a very long text is hashed whole, by one task.
    Sets are compared by 64-bit hashes of their shingles: two sets of n shingles each seem to share one more than they do
    with a probability below n * n / 2**64.
    """
    signed = written(signatures(docs, width, id_col, text_col))
    alike = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    slim = written(signed.select("doc_id", "n_shingles", "d1", "d2"))
    reps = written(
        alike.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_key", "signature")).alias("r"), F.first("n_shingles").alias("n"))
        .select("d1", "d2", F.col("r.doc_id").alias("node"), F.col("r.text_key").alias("key"), "n", F.col("r.signature").alias("signature"))
    )
    discard(signed)
    of = written(_components_by_rounds(reps, docs, width, percent, miss, id_col, text_col))
    alike = slim.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(reps.select("d1", "d2", "node").join(of, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id")))
    discard(reps, of)
    linked = alike.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    rest = slim.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _banded(reps: DataFrame) -> DataFrame:
    """Rows (band, m): each band's hash with its member (node, key, n)."""
    size = 2 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr("signature", i * size + 1, F.lit(size))))
    return reps.select(F.explode(band).alias("band"), F.struct("node", "key", "n").alias("m"))


def _components_by_rounds(reps: DataFrame, docs: DataFrame, width: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, component) of all representatives that have a link."""
    banded = _banded(reps)
    repeated = written(banded.groupBy("band").count().where("count > 1").select("band"))
    group_rows = written(maybe_in(banded, "band", repeated).join(repeated, "band", "left_semi"))
    close = F.expr(f"least(m.n, c.n) * 100 >= {percent} * greatest(m.n, c.n)")
    first = group_rows.groupBy("band").agg(F.min("m").alias("c"))
    pairs = group_rows.join(first, "band").where((F.col("m.node") != F.col("c.node")) & close).groupBy("m").agg(F.min("c").alias("c"))
    links = written(_links(written(pairs), reps, docs, width, percent, miss, id_col, text_col))
    of = written(components(links))
    known = of.select(F.col("node").alias("id"), "component")
    placed = group_rows.join(known, F.col("m.node") == F.col("id"), "left").select("band", "m", F.coalesce("component", "m.node").alias("g"))
    mixed = placed.groupBy("band").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("band")
    open_nodes = written(placed.join(mixed, "band", "left_semi").select("m.node", "m.key", "m.n", "g").distinct())
    discard(repeated, group_rows, of)
    pairs = written(_prefix_pairs(open_nodes, docs, width, percent, id_col, text_col))
    more = written(_links(pairs, reps, docs, width, percent, miss, id_col, text_col))
    return components(links.unionByName(more))


def _shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """Rows (node, key, n, g, t): each shingle t of texts (node, key, n, g, text)."""
    names = ["node", "key", "n", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            rows: list[int] = []
            for row in range(batch.num_rows):
                held.append(shingles(batch.column(4)[row].as_py(), width))
                rows.append(row)
                if row + 1 == batch.num_rows or sum(map(len, held)) >= SHINGLES_OUT:
                    at = pa.array(np.repeat(rows, [len(h) for h in held]), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(np.concatenate(held).view(np.int64))], names=[*names, "t"])
                    held, rows = [], []
        _HASHES.clear()
        tidy()

    return texts.select(*names, "text").mapInArrow(run, "node long, key long, n long, g long, t long")


def _prefix_pairs(nodes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (m, c) of nodes (node, key, n, g) of different g that may reach the similarity; no pair that does is missing.

    Sets of sizes x and y reach it with an overlap of percent * (x + y) / (100 + percent) or more. With shingles in one
    order, the first that both hold, at places i and j, leaves an overlap of at most x - i and y - j. Any order will do:
    shingles of a single g come first, as they can't be in both, then rarer ones.
    """
    texts = _texts(docs, nodes.select(F.col("node").alias("id"), "key"), id_col, text_col).withColumnRenamed("id", "node")
    rows = written(_shingle_rows(nodes.join(texts.hint("merge"), ["node", "key"]), width))
    mixed = rows.groupBy("t").agg(F.count("*").alias("times"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi")
    mixed = written(mixed.select("t", "times"))
    of_node = Window.partitionBy("node", "key")
    met = maybe_in(rows, "t", mixed.select("t")).join(mixed, "t")
    met = met.withColumn("shared", F.count("*").over(of_node)).where(100 * F.col("shared") >= percent * F.col("n"))
    met = met.withColumn("i", F.col("n") - F.col("shared") + F.row_number().over(of_node.orderBy("times", "t")) - 1)
    early = written(met.where(100 * (F.col("n") - F.col("i")) >= percent * F.col("n")).select("t", "node", "key", "n", "g", "i"))
    # most holders of a shingle are of one component by now: only the others look for partners
    main = early.groupBy("t", "g").count().groupBy("t").agg(F.max_by("g", F.struct("count", "g")).alias("main"), F.count("*").alias("of")).where("of > 1").select("t", "main")
    early = written(early.join(main, "t"))
    ours = early.where("g <> main").select("t", F.col("g").alias("h"), F.col("i").alias("j"), F.struct("node", "key", "n").alias("c"))
    theirs = early.select("t", "g", "main", "i", F.struct("node", "key", "n").alias("m"))
    least = percent * (F.col("m.n") + F.col("c.n"))
    reach = ((100 + percent) * (F.col("m.n") - F.col("i")) >= least) & ((100 + percent) * (F.col("c.n") - F.col("j")) >= least)
    across = (F.col("g") != F.col("h")) & ((F.col("g") == F.col("main")) | (F.col("g") > F.col("h")))
    return ours.join(theirs, "t").where(reach & across).select("m", "c").distinct()


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """Rows (a, b): those of the pairs (m, c) that hold."""
    flat = pairs.select(F.col("m.node").alias("a"), F.col("m.key").alias("ka"), F.col("c.node").alias("b"), F.col("c.key").alias("kb"))
    ends = flat.select("a").union(flat.select("b")).distinct()
    signs = written(maybe_in(reps.select("node", "key", "signature"), "node", ends))
    signed = flat.join(signs.toDF("a", "ka", "sa").hint("merge"), ["a", "ka"]).join(signs.toDF("b", "kb", "sb").hint("merge"), ["b", "kb"])
    left = written(plausible(signed, percent, miss))
    return confirmed(left, docs, width, percent, id_col, text_col)
