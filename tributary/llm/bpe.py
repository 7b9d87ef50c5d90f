"""Byte-level BPE: encoding with a contiguous rank array, and decoding.

The vocabulary file is a parameter and is read by every Python worker, so it must lie at the same path on each node.
Texts are cut into words by the published byte-level pattern. A word's merges keep two parallel lists, the part ids
between the word's boundaries and the rank of each adjacent pair; the least rank is found by a scan, its boundary is
deleted, and the two neighbouring ranks are looked up anew. Words beyond LONG_WORD bytes take the same merges from a
heap, because scans are quadratic. Word results are kept in a bounded memo of each worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import in_parts, pick

#: Fixed: the published word pattern of byte-level BPE. \\s is spelled out below, since engines differ on it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LONG_WORD = 96
MEMO_WORDS = 1 << 19
_NONE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else letters from 256 on, in byte order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class ByteBpe:
    """One vocabulary file, its merges and the memo of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for left, right in pairs:
            self.rank.setdefault((vocab[left], vocab[right]), len(self.made))
            self.made.append(vocab[left + right])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items() if all(c in back for c in token)}
        self.bytes_of |= {i: token.encode() for token, i in special.items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.memo = Memo(self)

    def merge(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        rank = self.rank.get
        ranks = [rank(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, least rank first and leftmost among equals, with a heap and linked neighbours."""
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := self.rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or self.rank.get((parts[i], parts[j])) != r:
                continue  # stale
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (again := self.rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (again, a))
        return [p for p in parts if p >= 0]

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.memo.__getitem__, self.words.findall(text)))
        out = []
        for piece in self.cut.split(text):
            out.append(self.special[piece].to_bytes(4, "little") if piece in self.special else b"".join(map(self.memo.__getitem__, self.words.findall(piece))))
        return b"".join(out)

    def text(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I") if packed else ()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


class Memo(dict):
    """Word -> packed ids; emptied when full, so its memory is bounded."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        out = b"".join(i.to_bytes(4, "little") for i in self.bpe.merge(word.encode()))
        if len(word) <= LONG_WORD:
            self[word] = out
        return out


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens long, ids binary): the ids of each whole text, packed as little-endian unsigned 32-bit.

    A null text counts as empty and has no tokens (empty ids); null ids and repeated rows pass through, one output row
    for each input row. Other columns are not read, whatever their names. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in in_parts(batch):
                packed = [bpe.packed(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())], names=[id_col, "n_tokens", "ids"]
                )

    rows = pick(docs, id_col, text_col).withColumn(text_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_tokens, ids, text): the rows of encode() with their text; bytes that are no UTF-8 become U+FFFD.

    Null ids decode to an empty text. An id outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in in_parts(batch):
                texts = [bpe.text(p or b"") for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids", "text"])

    rows = pick(encoded, id_col, "n_tokens", "ids")
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, text string")
