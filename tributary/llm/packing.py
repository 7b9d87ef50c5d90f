"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces and gaps are kept sorted by size. As sizes are whole numbers up to the capacity, the sorted order is held as runs:
all pieces of one length, ordered by a rank that Spark computes in parallel, and all open sequences of one gap. The sweeps
match runs, so their state is bounded by the capacity, never by the rows; the ranks and the final placement are
distributed. One round: a downward sweep gives every run of pieces its successor, the least gap that holds it; where
several runs want one gap the longer pieces win, in rank order, and losers try again in the next round; then gaps are
updated. When no piece fits any gap, new sequences are opened for the longest pieces left.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import in_parts, pick, tidy, written

MEMO_BYTES = 64 << 20
KEPT_BYTES = 16 << 20
ENTRY_BYTES = 200  # of an entry: its key, LONG_CHUNK characters at most and some 8 on average, its ids and what Python adds
LONG_CHUNK = 64
CHUNKS_AT_ONCE = 4096
SALTS = 256
_PLAIN = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
#: Fixed: the word pattern of the lower-casing vocabulary file.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Of each Latin-1 character: its kind in that pattern (0 the space between chunks, 1 letter, 2 digit, 3 other), and its small letter.
_KIND = np.array([0 if c == " " else 1 if c.isalpha() else 2 if c in "0123456789" else 3 for c in map(chr, range(256))], np.uint8)
_SMALL = np.array([ord(c.lower()) for c in map(chr, range(256))], np.uint8)


def spaced_words(chunks: list[str]) -> tuple[str, np.ndarray]:
    """The words of plain chunks without apostrophes in small letters, a space between them, and how many stand in each chunk."""
    text = np.frombuffer(" ".join(chunks).encode("latin-1"), np.uint8)
    kind = _KIND[text]
    before = np.append(np.uint8(0), kind[:-1])
    starts = (kind > 0) & ((kind != before) | (kind == 2))
    spaced = np.insert(_SMALL[text], np.flatnonzero(starts & (before > 0)), ord(" "))
    return spaced.tobytes().decode("latin-1"), np.bincount(np.cumsum(kind == 0)[starts], minlength=len(chunks))


class ChunkIds(dict):
    """Chunk between spaces -> packed ids, by the tokenizers library. Two halves of MEMO_BYTES: what was met lately, and what
    was before that, which goes when the first half is full.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its chunks in order.
    Chunks of ASCII and Latin-1 letters are encoded many at a time, as a call costs more than a chunk: they are cut into
    words and put in small letters here, and the vocabulary's model alone takes them.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.before: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    @property
    def bytes(self) -> int:
        return ENTRY_BYTES * (len(self) + len(self.before))

    def ids(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def forget(self) -> None:
        self.clear()
        self.before = {}

    def learn_words(self, chunks: list[str], text: str, words: np.ndarray) -> None:
        """Ids of chunks with so many words each, which text holds in order, cut where a word ends; a chunk at a time where
        the ends don't tell words apart."""
        got = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = 4 * (np.flatnonzero(self.ends[got]) + 1)
        if len(cuts) == words.sum() and words.all():
            packed, bounds = got.tobytes(), cuts[np.cumsum(words) - 1].tolist()
            self.update(zip(chunks, (packed[i:j] for i, j in zip([0, *bounds], bounds))))
        else:
            self.update((c, self.ids(c)) for c in chunks)

    def learn(self, chunks: set[str]) -> None:
        """Holds all of these chunks but the long ones afterwards; the callers' batches bound how many these are."""
        if 2 * ENTRY_BYTES * len(self) >= MEMO_BYTES:
            self.before = dict(self)
            self.clear()
        missing = chunks.difference(self)
        new = missing.difference(self.before)
        self.update((c, self.before[c]) for c in missing - new)
        plain: list[str] = []
        quoted: list[str] = []
        for chunk in new:
            if len(chunk) > LONG_CHUNK:
                continue
            if not _PLAIN.fullmatch(chunk) or "<|" in chunk:
                self[chunk] = self.ids(chunk)
            elif "'" in chunk:
                quoted.append(chunk)
            else:
                plain.append(chunk)
        for at in range(0, len(plain), CHUNKS_AT_ONCE):
            some = plain[at : at + CHUNKS_AT_ONCE]
            self.learn_words(some, *spaced_words(some))
        for at in range(0, len(quoted), CHUNKS_AT_ONCE):
            some = quoted[at : at + CHUNKS_AT_ONCE]
            words = [_WORDS.findall(c.lower()) for c in some]
            self.learn_words(some, " ".join(w for own in words for w in own), np.array([len(own) for own in words]))

    def __missing__(self, chunk: str) -> bytes:
        return self.ids(chunk)


_LOADED: dict[str, ChunkIds] = {}


def texts_ids(path: str, texts: list[str]) -> Iterator[bytes]:
    """The packed ids of whole texts."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    memo = _LOADED[path]
    lists = [text.replace("\n", " ").split(" ") for text in texts]
    memo.learn(set().union(*lists))
    for chunks in lists:
        yield b"".join(map(memo.__getitem__, chunks))


def rest(path: str) -> None:
    """At a task's end: a memo beyond KEPT_BYTES goes, as workers live on beside those of other operators."""
    if path in _LOADED and _LOADED[path].bytes > KEPT_BYTES:
        _LOADED[path].forget()


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece int, start long, length long, ids binary): each document's ids and end_id, cut at capacity.

    A null text counts as empty and gives one piece, end_id alone. Repeated rows and null ids pass through as rows of
    their own. ids are little-endian unsigned 32-bit. Other columns are not read. No shuffle.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch):
                rows, numbers, starts, cut = [], [], [], []
                for row, packed in enumerate(texts_ids(path, [t or "" for t in part.column(1).to_pylist()])):
                    packed += end
                    for k, start in enumerate(range(0, len(packed), 4 * capacity)):
                        rows.append(row)
                        numbers.append(k)
                        starts.append(start // 4)
                        cut.append(packed[start : start + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(c) // 4 for c in cut], pa.int64()), pa.array(cut, pa.binary())],
                    names=[id_col, "piece", "start", "length", "ids"],
                )
        rest(path)
        tidy()

    rows = pick(docs, id_col, text_col).withColumn(text_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, ranks, first sequence, offset) of counts[length] pieces of each length.

    The pieces of that length with ranks first..first+ranks-1 go to that many sequences from the given one on, at offset.
    Every rank gets exactly one placement. Best fit: a piece goes to the least gap that holds it.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, count)
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(length: int, gap: int, first: int, count: int) -> None:
        placed.append((length, rank[length], count, first, capacity - gap))
        rank[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]
        if gap > length:
            updated.setdefault(gap - length, []).append((first, count))

    while left:
        # a sweep: each run of pieces wants its successor among the gaps; longer runs come first
        sizes = sorted(gaps)
        updated: dict[int, list[tuple[int, int]]] = {}
        matched = False
        for length in sorted(left, reverse=True):
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                continue
            gap = sizes[at]
            while length in left and gaps.get(gap):  # conflicts: whoever comes later finds fewer or none, and waits
                first, count = gaps[gap].pop()
                take = min(count, left[length])
                if take < count:
                    gaps[gap].append((first + take, count - take))
                put(length, gap, first, take)
                matched = True
        for gap, runs in updated.items():
            gaps.setdefault(gap, []).extend(runs)
        gaps = {g: r for g, r in gaps.items() if r}
        if matched or not left:
            continue
        # nothing fits: open sequences for the longest pieces, as many as stand alone in theirs, or one run of equals
        updated = {}
        longest = max(left)
        for length in [n for n in sorted(left, reverse=True) if 2 * n > capacity] or [longest]:
            each = capacity // length
            count = -(-left[length] // each)
            for k in range(each):
                take = min(count, left.get(length, 0))
                if not take:
                    break
                gap = capacity - k * length
                put(length, gap, opened, take)
                # those that take another piece of this run are not gaps yet
                if gap > length and k + 1 < each and left.get(length):
                    updated[gap - length].pop()
                    more = min(count, left[length])
                    if more < take:
                        updated[gap - length].append((opened + more, take - more))
            opened += count
        for gap, runs in updated.items():
            gaps.setdefault(gap, []).extend(runs)
    return placed


def pack(items: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of items with sequence_id long and offset long; no sequence exceeds capacity, offsets are gapless.

    items holds id, piece and length (1 to capacity), and any other columns, which pass through whatever their names. Equal rows are placed
    apart. Ranks within a length come from salted windows, so a length that most rows share stays spread out. The
    histogram of lengths (at most `capacity` rows per salt) is all that reaches the driver. An empty table stays empty.
    """
    others = list(items.columns)
    salt, nth = (next(n for n in (name + "_" * i for i in range(len(others) + 1)) if n not in others) for name in ("_salt", "_rank"))
    salted = written(items.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in others]), F.lit(SALTS)).cast("int")))
    histogram = salted.groupBy("length", F.col(salt).alias("_salt")).agg(F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    base: dict[int, list[int]] = {}
    for r in sorted(histogram, key=lambda r: (r.length, r._salt)):
        base.setdefault(r.length, [0] * SALTS)[r._salt] = counts.get(r.length, 0)
        counts[r.length] = counts.get(r.length, 0) + r.n
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, sequence, offset in sorted(plan(counts, capacity)):
        runs.setdefault(length, []).append((first, sequence, offset))
    spark = items.sparkSession
    placements = spark.sparkContext.broadcast({n: (base[n], *map(list, zip(*runs[n]))) for n in counts})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = placements.value
        for batch in batches:
            sequences, offsets = [], []
            for length, at_salt, number in zip(*(batch.column(c).to_pylist() for c in ("length", salt, nth))):
                bases, firsts, starts, places = at[length]
                rank = bases[at_salt] + number - 1
                k = bisect.bisect_right(firsts, rank) - 1
                sequences.append(starts[k] + rank - firsts[k])
                offsets.append(places[k])
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*others, "sequence_id", "offset"])

    order = Window.partitionBy("length", salt).orderBy(F.col(f"`{id_col}`"), "piece")
    ranked = salted.withColumn(nth, F.row_number().over(order).cast("long"))
    schema = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in others)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
