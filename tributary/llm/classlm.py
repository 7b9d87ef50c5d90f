"""LM scoring with Brown class-based n-grams.

Exchange clustering moves words between classes while that raises the mutual information of adjacent classes. First the HEAD
most frequent words and the end of a text are exchanged one at a time, on their matrix of adjacent pairs, until no move
helps. Then every other training word joins the class that its own neighbours suit best, and all words go on moving: a pass
sums in Spark how often each word stands before and after each class, and each word takes the class of most gain. The moves
of a pass happen at once; passes end when the information no longer rises, or after PASSES. The probability of a word is
P(class | class before) * P(word | class).

Texts are tokenised once to count words and once to arrays of numbers, which all passes and the scoring read. Counts and
classes of all words, however many, stay Spark tables. The COUNTED most frequent ones go to the tasks (their number is
fixed); the others get a class from their counted neighbours after the last pass and are joined as (text, word) rows. A model
of the whole text then moves the counted words once more, by all their neighbours, and counts all pairs of adjacent classes;
without `whole`, pairs are counted where both words are counted ones. A word that no training text holds has the class that is
likeliest there: the one of most probability after the class before, its own share included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import discard, in_parts, pick, tidy, written

HEAD, CLASSES = 1000, 64
COUNTED = 100_000
PASSES = 2
SLOTS = 2 * CLASSES + 1  # of a word: the classes after it, those before it, itself after itself
GAIN_WORDS = 4096
AT_ONCE = 256
MEMO_WORDS = 1 << 17
ENTRIES = 1 << 22
WIDE = (1 << 16) - 1  # stands for a code of more than two bytes
MOST = (1 << 24) - 1  # times of one entry; SLOTS fit in the byte below


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def key_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


END_KEY = key_of(b" ")  # no word has a space


@dataclass
class Words:
    """The counted words, most frequent first, and the end last: keys and counts."""

    keys: np.ndarray
    counts: np.ndarray


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (key, n): how often each word occurs. texts has the one column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held)) ^ np.uint64(2**63)  # key_of
            out = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(list(held.values()), pa.int64())], names=["key", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in in_parts(batch):
                for text in part.column(0).to_pylist():
                    held.update(words_of(text))
                    if len(held) > 2 * MEMO_WORDS:
                        yield flush()
        if held:
            yield flush()
        tidy()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int | None = None) -> np.ndarray:
    """The class of each type, by exchange: every type in turn moves to the class that raises mutual information most.

    Ends when no move helps, or after so many rounds.
    """
    n = len(pairs)
    often = np.argsort(-(pairs.sum(axis=0) + pairs.sum(axis=1)), kind="stable")
    of = np.empty(n, np.int64)
    of[often] = np.arange(n) % classes
    f = lambda x: x * np.log(np.maximum(x, 1))
    member = np.eye(classes)[of]
    m = member.T @ pairs @ member
    for _ in count() if rounds is None else range(rounds):
        moved = 0
        for w in often:
            after, before = np.bincount(of, pairs[w], classes), np.bincount(of, pairs[:, w], classes)
            own, self_pairs = of[w], pairs[w, w]
            if not after.any() and not before.any():
                continue
            after[own] -= self_pairs
            before[own] -= self_pairs
            m[own, :] -= after
            m[:, own] -= before
            m[own, own] -= self_pairs
            rows, cols = m.sum(axis=1) + before, m.sum(axis=0) + after  # what follows and precedes each class without this type
            gain = (f(m + after) - f(m)).sum(axis=1) + (f(m + before[:, None]) - f(m)).sum(axis=0)
            d = np.diag(m)
            gain += f(d + after + before + self_pairs) - f(d + after) - f(d + before) + f(d)
            t_out, t_in = after.sum() + self_pairs, before.sum() + self_pairs
            gain -= f(rows + t_out) - f(rows) + f(cols + t_in) - f(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            m[best, :] += after
            m[:, best] += before
            m[best, best] += self_pairs
            moved += best != own
            of[w] = best
        if not moved:
            break
    return of


def information(m: np.ndarray) -> float:
    """What exchange raises, of the counts of adjacent classes."""
    return float(_f(m).sum() - _f(m.sum(axis=0)).sum() - _f(m.sum(axis=1)).sum())


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(m: np.ndarray, own: np.ndarray | None, after: np.ndarray, before: np.ndarray, selfs: np.ndarray) -> np.ndarray:
    """(words x classes): what each word adds to the information in each class, all others staying where they are.

    after, before: (words x classes) counts of the classes around each word, without its pairs with itself (selfs). own:
    the classes whose counts in m hold these words; None: m has none of their pairs.
    """
    if own is None:
        return _joining(m, after, before, selfs)
    n, k = after.shape
    if n > AT_ONCE:
        cuts = [slice(at, at + AT_ONCE) for at in range(0, n, AT_ONCE)]
        return np.concatenate([gains(m, own[c], after[c], before[c], selfs[c]) for c in cuts])
    every = np.arange(n)
    out = np.zeros((n, k))
    for counts, others, table in ((after, before, m.T), (before, after, m)):
        w, d = np.nonzero(counts)
        if not len(w):
            continue
        times, at, rows = counts[w, d], own[w], np.arange(len(w))
        x = table[d].astype(float)  # the pairs of each class with d, this word taken out
        x[rows, at] -= times
        in_own = np.flatnonzero(d == at)
        x[in_own] -= others[w[in_own]]
        x[in_own, at[in_own]] -= selfs[w[in_own]]
        term = _f(x + times[:, None]) - _f(x)
        term[rows, d] = 0
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        out[w[first]] += np.add.reduceat(term, first, axis=0)
    x = np.tile(np.diag(m).astype(float), (n, 1))
    x[every, own] -= after[every, own] + before[every, own] + selfs
    out += _f(x + after + before + selfs[:, None]) - _f(x)
    for counts, totals in ((after, m.sum(axis=1)), (before, m.sum(axis=0))):
        whole = counts.sum(axis=1) + selfs
        x = np.tile(totals.astype(float), (n, 1))
        x[every, own] -= whole
        out -= _f(x + whole[:, None]) - _f(x)
    return out


def _joining(m: np.ndarray, after: np.ndarray, before: np.ndarray, selfs: np.ndarray) -> np.ndarray:
    """gains of words whose pairs m doesn't hold: what a count adds to a row of m is worked out once for each count."""
    out = np.zeros(after.shape)

    def added(x: np.ndarray, times: np.ndarray) -> np.ndarray:
        """(len(times) x len(x)): by how much f grows where times are added to x."""
        values, at = np.unique(times, return_inverse=True)
        return (_f(x + values[:, None]) - _f(x))[at]

    for counts, table in ((after, m.T), (before, m)):
        for d in range(m.shape[0]):
            w = np.flatnonzero(counts[:, d])
            if len(w):
                term = added(table[d], counts[w, d])
                term[:, d] = 0
                out[w] += term
    both = after + before + selfs[:, None]
    for d in range(m.shape[0]):
        w = np.flatnonzero(both[:, d])
        if len(w):
            out[w, d] += added(m[d, d : d + 1], both[w, d])[:, 0]
    # the pairs with each class before or behind count in that class's total, wherever the word goes
    for counts, others, totals in ((after, before, m.sum(axis=1)), (before, after, m.sum(axis=0))):
        whole = counts.sum(axis=1) + selfs
        out -= added(totals, whole)
        w, d = np.nonzero(others)
        x, y = totals[d] + others[w, d], whole[w]
        out[w, d] -= _f(x + y) - _f(x) - _f(totals[d] + y) + _f(totals[d])
    return out


class Places(dict):
    """Word -> its place among the counted words, or its key; that a key is as small as a place is less likely than two equal keys."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.place = {k: i for i, k in enumerate(keys.tolist())}

    def __missing__(self, word: bytes) -> int:
        key = key_of(word)
        out = self[word] = self.place.get(key, key)
        return out


def coded(rows: DataFrame, words) -> DataFrame:
    """rows (id, text, learn, ask) as (row, id, learn, ask, codes, wide, keys), written.

    codes: little-endian uint16, the places of counted words below WIDE; WIDE stands for the next of wide: int32, the place
    of a counted word, or -1 - j for the text's j-th other word, whose key is keys[j].
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = len(words.value.keys) - 1
        memo = Places(words.value.keys[:-1])
        for batch in batches:
            for part in in_parts(batch):
                codes, wide, keys = [], [], [np.empty(0, np.int64)]
                for text in part.column(1).to_pylist():
                    if len(memo) > 2 * MEMO_WORDS:
                        memo.clear()
                    ws = words_of(text)
                    own = np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))
                    rare = (own < 0) | (own >= counted)
                    others, at = np.unique(own[rare], return_inverse=True)
                    own[rare] = -1 - at
                    long = rare | (own >= WIDE)
                    wide.append(own[long].astype("<i4").tobytes())
                    own[long] = WIDE
                    codes.append(own.astype("<u2").tobytes())
                    keys.append(others)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(k) for k in keys]), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 2, 3)), pa.array(codes, pa.binary()), pa.array(wide, pa.binary()), lists], names=["id", "learn", "ask", "codes", "wide", "keys"])
        tidy()

    return written(rows.mapInArrow(run, f"id {kind}, learn boolean, ask boolean, codes binary, wide binary, keys array<long>").withColumn("row", F.monotonically_increasing_id()))


def filled(texts: DataFrame, others: DataFrame | None) -> DataFrame:
    """texts with `classes` and `times` in place of their keys, from others (key, class, n); -1 and 0 for words that aren't there."""
    kept = [c for c in texts.columns if c != "keys"]
    if others is None:
        none = F.transform("keys", lambda _: F.lit(-1))
        return texts.select(*kept, none.alias("classes"), F.transform("keys", lambda _: F.lit(0).cast("long")).alias("times"))
    at = texts.select("row", F.posexplode("keys").alias("at", "key")).join(others.select("key", "class", "n"), "key", "left")
    met = at.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("class", F.lit(-1)).alias("class"), F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("met"))
    empty = F.col("met").isNull()
    return texts.join(met, "row", "left").select(
        *kept, F.when(empty, F.array().cast("array<int>")).otherwise(F.col("met.class").cast("array<int>")).alias("classes"), F.when(empty, F.array().cast("array<long>")).otherwise(F.col("met.n")).alias("times")
    )


def _summed(ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, sorted, and the sums of their times."""
    order = np.argsort(ids, kind="stable")
    ids, times = ids[order], times[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.empty(0, np.int64)
    return ids[first], np.add.reduceat(times, first) if len(ids) else times


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, one row behind the other, and how many each row has."""
    out = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)
    return out, pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize


def _runs(batch: pa.RecordBatch, end: int) -> np.ndarray:
    """The texts of a batch as one run of places, an end before each and behind the last.

    Other words are -1 - k, k their place among the batch's keys or classes; without these columns any negative number.
    """
    places, lengths = _numbers(batch.column("codes"), "<u2")
    wide, n_wide = _numbers(batch.column("wide"), "<i4")
    lists = [n for n in ("keys", "classes") if n in batch.schema.names]
    if lists:
        own = batch.column(lists[0]).value_lengths().to_numpy()
        wide -= np.where(wide < 0, np.repeat(np.cumsum(own) - own, n_wide), 0)
    places[places == WIDE] = wide
    return np.insert(places, np.append(0, np.cumsum(lengths)), end)


def _classed(places: np.ndarray, batch: pa.RecordBatch, of: np.ndarray) -> np.ndarray:
    """The class of each place of a run, -1 for none; those of other words are the batch's classes, where it has them (filled)."""
    cls = np.where(places >= 0, of[np.maximum(places, 0)], -1)
    if "classes" in batch.schema.names:
        rare = places < 0
        cls[rare] = batch.column("classes").flatten().to_numpy(zero_copy_only=False)[-1 - places[rare]]
    return cls


def _coded_columns(texts: DataFrame, *more: str) -> DataFrame:
    return texts.select("codes", "wide", *more, *(["classes"] if "classes" in texts.columns else []))


def head_pairs(texts: DataFrame, head: int, end: int) -> np.ndarray:
    """(head + 1 x head + 1): how often one stands before the other; the end is last. Pairs with other words don't count."""
    size = head + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for part in in_parts(batch):
                places = _runs(part, end)
                types = np.where(places == end, head, np.where((places >= 0) & (places < head), places, -1))
                a, b = types[:-1], types[1:]
                met = (a >= 0) & (b >= 0)
                total += np.bincount(a[met] * size + b[met], minlength=size * size)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 100_000]), pa.array(total[some[at : at + 100_000]])], names=["pair", "n"])

    rows = texts.select("codes", "wide").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def contexts(texts: DataFrame, classes, counted: bool) -> DataFrame:
    """Rows (key, found): how often each word has which neighbours, of the counted words (key: their place) or of the others.

    found: lists of little-endian uint32, slot + 256 * times. Neighbours without a class don't count: before other words have
    theirs (filled), these are all the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classes.value
        end = len(of) - 1
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            """Of the entries held: a row for each word, its key first."""
            ids, times = _summed(*map(np.concatenate, zip(*held))) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            held.clear()
            if len(times) and times.max() > MOST:
                more = (times - 1) // MOST
                ids, rest = np.repeat(ids, more + 1), times - more * MOST
                times = np.full(len(ids), MOST)
                times[np.cumsum(more + 1) - 1] = rest
            word, slot = ids // SLOTS, ids % SLOTS
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(ids) else np.empty(0, np.int64)
            packed = (slot + 256 * times).astype("<u4").tobytes()
            bounds = [*(4 * first).tolist(), len(packed)]
            for at in range(0, len(first), 10_000):
                some = first[at : at + 10_000]
                cut = [packed[i:j] for i, j in zip(bounds[at : at + len(some)], bounds[at + 1 :])]
                yield pa.RecordBatch.from_arrays([pa.array(word[some]), pa.array(cut, pa.binary())], names=["key", "found"])

        size = 0
        for batch in batches:
            for part in in_parts(batch):
                places = _runs(part, end)
                cls = _classed(places, part, of)
                a, b = places[:-1], places[1:]
                if counted:
                    after, before, own = (a >= 0) & (cls[1:] >= 0), (b >= 0) & (cls[:-1] >= 0), (a >= 0) & (a == b)
                    ids = np.concatenate([a[after] * SLOTS + cls[1:][after], b[before] * SLOTS + CLASSES + cls[:-1][before], a[own] * SLOTS + 2 * CLASSES])
                    held.append(_summed(ids, np.ones(len(ids), np.int64)))
                    size += len(held[-1][0])
                    if size > ENTRIES:
                        held[:] = [_summed(*map(np.concatenate, zip(*held)))]
                        size = len(held[0][0])
                        if size > ENTRIES // 2:
                            yield from flush()
                            size = 0
                else:
                    after, before = (a < 0) & (cls[1:] >= 0), (b < 0) & (cls[:-1] >= 0)
                    ids = np.concatenate([(-1 - a[after]) * SLOTS + cls[1:][after], (-1 - b[before]) * SLOTS + CLASSES + cls[:-1][before]])
                    held.append(_summed(ids, np.ones(len(ids), np.int64)))
                    names = part.column("keys").flatten().to_numpy()
                    for out in flush():  # a word that stands in several texts has several rows
                        yield pa.RecordBatch.from_arrays([pa.array(names[out.column(0).to_numpy()]), out.column(1)], names=["key", "found"])
        yield from flush()
        tidy()

    found = _coded_columns(texts, *([] if counted else ["keys"])).mapInArrow(run, "key long, found binary")
    return found.groupBy("key").agg(F.collect_list("found").alias("found"))


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows of contexts, about GAIN_WORDS at a time: keys, and counts (words x SLOTS)."""
    held: list[pa.RecordBatch] = []

    def dense() -> tuple[np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        lists = whole.column("found").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        cut = lists.flatten()
        row = np.repeat(np.arange(whole.num_rows), lists.value_lengths().to_numpy())
        row = np.repeat(row, pc.binary_length(cut).to_numpy() // 4)
        entries = np.frombuffer(b"".join(cut.to_pylist()), "<u4")
        counts = np.bincount(row * SLOTS + (entries & 255), entries >> 8, whole.num_rows * SLOTS).reshape(-1, SLOTS)
        return whole.column("key").to_numpy(), counts

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= GAIN_WORDS:
            yield dense()
    if held:
        yield dense()


def class_pairs(texts: DataFrame, classes) -> np.ndarray:
    """(classes x classes): how often one stands before the other in texts; words without a class don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for part in in_parts(batch):
                cls = _classed(_runs(part, len(classes.value) - 1), part, classes.value)
                met = (cls[:-1] >= 0) & (cls[1:] >= 0)
                total += np.bincount(cls[:-1][met] * CLASSES + cls[1:][met], minlength=CLASSES * CLASSES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    rows = _coded_columns(texts).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES)


def best_classes(found: DataFrame, m: np.ndarray, classes=None) -> DataFrame:
    """Rows (key, class): the class of most gain of each word of contexts. classes: those that counted words have, -1 for none."""
    pairs = found.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _dense(batches):
            own = classes.value[keys] if classes is not None else np.full(len(keys), -1)
            after, before, selfs = counts[:, :CLASSES].copy(), counts[:, CLASSES:-1].copy(), np.where(own >= 0, counts[:, -1], 0)
            inside = np.flatnonzero(own >= 0)
            after[inside, own[inside]] -= selfs[inside]
            before[inside, own[inside]] -= selfs[inside]
            to = np.empty(len(keys), np.int64)
            for some, taken in ((inside, True), (np.flatnonzero(own < 0), False)):
                if len(some):
                    gain = gains(pairs.value, own[some] if taken else None, after[some], before[some], selfs[some])
                    best = gain.argmax(axis=1)
                    if taken:  # a tie moves nothing
                        here = gain[np.arange(len(some)), own[some]]
                        best = np.where(gain[np.arange(len(some)), best] > here + 1e-9 * np.maximum(1, np.abs(here)), best, own[some])
                    to[some] = best
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(to.astype(np.int32))], names=["key", "class"])

    return found.mapInArrow(run, "key long, class int")


def cluster(texts: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the counted words and the end (last), and the class_pairs of the training texts (coded)."""
    spark = texts.sparkSession
    head = min(HEAD, n_words)
    of = np.full(n_words + 1, -1, np.int64)
    first = exchange(head_pairs(texts, head, n_words))
    of[:head], of[-1] = first[:head], first[head]
    best, value = None, -np.inf
    for turn in range(PASSES + 1):
        shared = spark.sparkContext.broadcast(of)
        m = class_pairs(texts, shared)
        whole = bool((of >= 0).all())
        if whole and information(m) <= value:
            break
        if whole:
            best, value = (of, m), information(m)
        if turn == PASSES:
            break
        after = moved_once(texts, of, m)
        if (after == of).all():
            break
        of = after
    return best


def moved_once(texts: DataFrame, of: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The classes of the counted words and the end after all have moved at once."""
    shared = texts.sparkSession.sparkContext.broadcast(of)
    moved = best_classes(contexts(texts, shared, counted=True), m, shared).toArrow()  # at most COUNTED and the end
    after = of.copy()
    after[moved.column("key").to_numpy()] = moved.column("class").to_numpy()
    after[after < 0] = 0  # words without counted neighbours
    return after


def with_others(train: DataFrame, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """of and the class_pairs of all words, counted and other ones, after another pass in which every neighbour counts.

    train: filled. The pass is undone if the information doesn't rise.
    """
    share = train.sparkSession.sparkContext.broadcast
    m = class_pairs(train, share(of))
    after = moved_once(train, of, m)
    of_after = class_pairs(train, share(after))
    return (after, of_after) if information(of_after) > information(m) else (of, m)


def score(docs: DataFrame, training: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", smoothing: float = 0.1, whole: bool = False) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs.

    training: the rows to learn from, or a condition on docs that tells which of these they are. Tokens: words, A-Z in lower
    case, then one end; a null text counts as empty and has the end alone. base_score is the add-one unigram log10
    probability, score that of the class model, both learned from all training rows. Repeated rows and null ids pass through,
    other columns aren't read, a text is scored whole however long, and an empty table gives an empty one. With no training
    rows both scores count every token as unknown.

    Words beyond COUNTED are placed by their counted neighbours. whole: then these words too count as neighbours, in another
    pass and in the pairs of classes that the scores are made of; otherwise only pairs of counted words do.
    """
    spark = docs.sparkSession
    flags = lambda rows, learn, ask: rows.select("id", F.col("text").cast("string").alias("text"), learn.alias("learn"), ask.alias("ask"))
    yes, no = F.lit(True), F.lit(False)
    if isinstance(training, DataFrame):
        rows = flags(pick(docs, id_col, text_col).toDF("id", "text"), no, yes)
        learned = pick(training, text_col).toDF("text").select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "text")
        rows = rows.unionByName(flags(learned, yes, no))
    else:
        rows = flags(pick(docs.withColumn("_learn", F.coalesce(training, no)), id_col, text_col, "_learn").toDF("id", "text", "learn"), F.col("learn"), yes)
    texts = rows.where("learn").select("text")
    table = written(count_words(texts))
    n_ends = texts.count()
    stats = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = stats.n + n_ends, stats.v + (n_ends > 0)
    top = table.orderBy(F.col("n").desc(), "key").limit(COUNTED).select("key", "n").toArrow()
    words = Words(np.append(top.column("key").to_numpy(), END_KEY), np.append(top.column("n").to_numpy(), n_ends))
    shared_words = spark.sparkContext.broadcast(words)
    every = coded(rows, shared_words)
    train = every.where("learn")
    of, m = cluster(train, len(words.keys) - 1)

    others = None
    if stats.v > COUNTED:
        shared = spark.sparkContext.broadcast(of)
        placed = best_classes(contexts(train, shared, counted=False), m)
        known_keys = spark.createDataFrame(pa.table({"key": words.keys}))
        rest = table.join(F.broadcast(known_keys), "key", "left_anti")
        others = written(rest.join(placed, "key", "left").select("key", F.coalesce("class", F.lit(0)).alias("class"), "n"))

    asked = every
    if others is not None and whole:
        asked = written(filled(every, others))
        discard(every)
        of, m = with_others(asked.where("learn"), of)

    class_n, class_v = np.bincount(of, words.counts, CLASSES), np.bincount(of, words.counts > 0, CLASSES)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect() if others else []:
        class_n[r["class"]] += r.n
        class_v[r["class"]] += r.v
    between = m + smoothing
    step = np.log10(between / between.sum(axis=1, keepdims=True))
    of_class = np.log10(class_n + class_v + 1)
    model = spark.sparkContext.broadcast((of, step, of_class, np.log10(words.counts + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, steps, class_logs, logs = model.value
        unseen_after = (steps - class_logs).argmax(axis=1)
        for batch in batches:
            for part in in_parts(batch):
                places = _runs(part, len(classes) - 1)
                cs, ls = _classed(places, part, classes), logs[np.maximum(places, 0)]
                rare = np.flatnonzero(places < 0)
                times = part.column("times").flatten().to_numpy()[-1 - places[rare]]
                ls[rare] = np.log10(times + 1.0)
                for i in np.flatnonzero(cs < 0).tolist():
                    cs[i] = unseen_after[cs[i - 1]]
                unknown = np.zeros(len(places), np.int64)
                unknown[rare] = times == 0
                values = steps[cs[:-1], cs[1:]] + ls[1:] - class_logs[cs[1:]]
                n = pc.binary_length(part.column("codes")).to_numpy().astype(np.int64) // 2 + 1
                first = np.cumsum(n) - n  # of a text, in the run without the end before all
                base, value, missed = (np.add.reduceat(x, first) for x in (ls[1:], values, unknown[1:]))
                out = (n, n - 1 - missed + (n_ends > 0), base, value)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["id", "n_tokens", "n_known", "base", "value"])
        tidy()

    kind = rows.schema["id"].dataType.simpleString()
    asked = asked.where("ask") if "classes" in asked.columns else filled(every.where("ask").select("row", "id", "codes", "wide", "keys"), others)
    scored = asked.select("id", "codes", "wide", "classes", "times").mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base double, value double")
    per_token = float(np.log10(total + distinct + 1))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), F.col("value").alias("score"))
