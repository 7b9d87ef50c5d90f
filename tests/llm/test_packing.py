import random
import sys
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from tributary.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_places_every_rank_once_and_packs_tightly():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randint(1, 14)
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        spans, load = {}, {}
        for length, first, ranks, sequence, offset in packing.plan(counts, capacity):
            spans.setdefault(length, []).append((first, ranks))
            for k in range(ranks):
                load.setdefault(sequence + k, []).append((offset, length))
        for length, parts in spans.items():
            assert sum(n for _, n in parts) == counts[length]
            assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(parts), sorted(parts)[1:]))
        for places in load.values():
            assert max(o + n for o, n in places) == sum(n for _, n in places) <= capacity
        assert len(load) <= 1.23 * sum(n * c for n, c in counts.items()) / capacity + 1 + sum(c for n, c in counts.items() if 3 * n > capacity)


def test_pieces_and_layout(spark):
    texts = [None, "", "Hello, wörld ΑΣ <|endoftext|>x", "a b " * 3000, "tie", "tie", "x" * 5000]
    rows = [(i if i != 4 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[5:6], "doc_id long, text string, Length string")
    cut = packing.pieces(docs, PATH, 2048).cache()
    out = packing.pack(cut.select("doc_id", "piece", "start", "length"), 2048).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in rows + rows[5:6]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, k, s, len(ids[s : s + 2048]), ids[s : s + 2048]) for k, s in enumerate(range(0, len(ids), 2048))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, r.piece, r.start, r.length, list(memoryview(bytes(r.ids)).cast("I"))) for r in cut.collect()), key=key)
    assert got == sorted(want, key=key)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece) for r in out) == sorted((w[0] is None, w[0] or 0, w[1]) for w in want)
    check_layout(out, 2048)


def test_one_length_shared_by_most_rows(spark):
    items = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, id % 50 + 1, 700) as long) as length", "'x' as extra")
    rows = packing.pack(items, 2048).collect()
    assert len(rows) == 5000
    assert check_layout(rows, 2048) <= 1.01 * (sum(r.length for r in rows) / 2048) + 3334 / 2 - 3334 * 700 / 2048 + 2


def test_empty_table(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), PATH, 2048), 2048).count() == 0


def test_query_on_the_small_table(spark):
    from tributary.llm.registry import QUERIES

    t = Tokenizer.from_file(PATH)
    want = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want |= {(r.doc_id, k, s, len(c := ids[s : s + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in c))) for k, s in enumerate(range(0, len(ids), 2048))}
    rows = QUERIES["op9_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = check_layout(rows, 2048)
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_chunks_of_all_kinds_have_the_library_s_ids():
    rng = random.Random(2)
    odd = ["don't", "'save", "x's'll", "<|endoftext|>", "12a3", "ÀÉ'T", "a.b,c", "$$$", "''s", "Straße", "ÿ'RE", "×÷", "ª", "İx", "x" * 64, "y" * 65, ""]
    odd += ["".join(rng.choice("abzAZ'.,$0129éÉßÿ×÷<|_-Σ") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    memo = packing.ChunkIds(PATH)
    memo.learn(set(odd))
    t = Tokenizer.from_file(PATH)
    assert all(memo[c] == b"".join(i.to_bytes(4, "little") for i in t.encode(c, add_special_tokens=False).ids) for c in odd)


def test_new_chunks_are_encoded_many_at_a_time_and_late_ones_outlive_a_full_memo(monkeypatch):
    memo = packing.ChunkIds(PATH)
    calls = []
    ids = memo.ids
    memo.ids = lambda text: calls.append(text) or ids(text)
    monkeypatch.setattr(packing, "MEMO_BYTES", 400 * packing.ENTRY_BYTES)
    memo.learn({f"late{i}" for i in range(150)})
    memo.learn({f"more{i}'s" for i in range(150)})
    memo.learn({f"other{i}" for i in range(100)})  # the first half is full: what it holds becomes the second
    known = {f"late{i}" for i in range(150)}
    assert known <= set(memo.before) and not calls
    monkeypatch.setattr(memo, "learn_words", None)  # nothing is encoded again
    memo.learn(known)
    assert known <= set(memo)


def test_a_task_leaves_little_of_its_memo_behind():
    list(packing.texts_ids(PATH, [" ".join(f"w{i}" for i in range(90_000))]))
    packing.rest(PATH)
    assert packing._LOADED[PATH].bytes <= packing.KEPT_BYTES


def test_what_a_memo_really_takes_is_bounded():
    rng = random.Random(3)
    memo, most = packing.ChunkIds(PATH), 0
    size = lambda d: sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items())
    for _ in range(25):
        memo.learn({"".join(rng.choices("abdeghilmnorstuéü", k=9)) for _ in range(25_000)})
        most = max(most, size(memo) + size(memo.before))
    assert most <= 1.5 * (64 << 20)  # two workers of an executor have one each
