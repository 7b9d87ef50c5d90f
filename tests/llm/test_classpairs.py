"""Words beyond the counted ones in the class model."""

import random

import numpy as np

from tributary.llm import classlm


def test_pairs_with_other_words_count(spark, monkeypatch):
    rng = random.Random(3)
    rows = [" ".join(rng.choice([f"a{i}" for i in range(12)] + [f"rare{i}" for i in range(40)]) for _ in range(30)) for _ in range(20)] + ["", "odd odd"]
    monkeypatch.setattr(classlm, "HEAD", 6)
    monkeypatch.setattr(classlm, "COUNTED", 10)
    ends, placed = [], []
    whole, fill = classlm.with_others, classlm.filled
    monkeypatch.setattr(classlm, "filled", lambda texts, others: placed.append(others) or fill(texts, others))
    monkeypatch.setattr(classlm, "with_others", lambda *a: ends.append(whole(*a)) or ends[0])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in classlm.score(docs, docs, whole=True).collect()}
    (of, m), key = ends[0], {w: classlm.key_of(w.encode()) for t in rows for w in t.split()}
    counts = {w: sum(t.split().count(w) for t in rows) for w in key}
    order = sorted(counts, key=lambda w: (-counts[w], key[w]))
    others = {r.key: r["class"] for r in placed[0].collect()}
    class_of = {w: int(of[i]) if i < 10 else others[key[w]] for i, w in enumerate(order)} | {"": int(of[-1])}
    real = np.zeros_like(m)
    for t in rows:
        ws = ["", *t.split(), ""]
        for u, v in zip(ws, ws[1:]):
            real[class_of[u], class_of[v]] += 1
    assert (real == m).all() and m.sum() == sum(len(t.split()) + 1 for t in rows)
    n, v = np.zeros(classlm.CLASSES), np.zeros(classlm.CLASSES)
    counts[""] = len(rows)
    for w, k in class_of.items():
        n[k] += counts[w]
        v[k] += 1
    step = np.log10((m + 0.1) / (m + 0.1).sum(axis=1, keepdims=True))
    for i, t in enumerate(rows):
        ws = ["", *t.split(), ""]
        want = sum(step[class_of[u], class_of[x]] + np.log10((counts[x] + 1) / (n[class_of[x]] + v[class_of[x]] + 1)) for u, x in zip(ws, ws[1:]))
        assert abs(got[i] - want) < 1e-9


def test_texts_are_coded_in_few_bytes_and_read_back(spark, monkeypatch):
    monkeypatch.setattr(classlm, "WIDE", 3)
    rows = ["a b c d e odd f odd rare a", "", None, "rare", "e d a"]
    keys = np.array([classlm.key_of(w.encode()) for w in "abcdef"] + [classlm.END_KEY])
    words = spark.sparkContext.broadcast(classlm.Words(keys, np.ones(7, np.int64)))
    asked = spark.createDataFrame([(i, t, True, True) for i, t in enumerate(rows)], "id int, text string, learn boolean, ask boolean").coalesce(1)
    batch = classlm.coded(asked, words).orderBy("id").toArrow().combine_chunks().to_batches()[0]
    own = batch.column("keys").flatten().to_numpy()
    place = {int(k): i for i, k in enumerate(keys)}
    told = [place[int(k)] if int(k) in place else int(k) for t in rows for w in [*(t or "").split(), " "] for k in [classlm.key_of(w.encode())]]
    assert [p if p >= 0 else int(own[-1 - p]) for p in classlm._runs(batch, 6).tolist()] == [6, *told]
    assert sum(map(len, batch.column("codes").to_pylist())) == 2 * 14
    assert "keys" not in classlm.filled(classlm.coded(asked, words), None).columns  # they aren't shuffled again


def test_counts_beyond_an_entry_are_split(spark, monkeypatch):
    monkeypatch.setattr(classlm, "MOST", 3)
    keys = np.array([classlm.key_of(b"a"), classlm.END_KEY])
    share = spark.sparkContext.broadcast
    asked = spark.createDataFrame([(0, "a " * 8, True, True)], "id int, text string, learn boolean, ask boolean")
    found = classlm.contexts(classlm.coded(asked, share(classlm.Words(keys, np.ones(2, np.int64)))), share(np.array([1, 2])), counted=True)
    counts = {int(k): c for ks, cs in classlm._dense(iter(found.toArrow().combine_chunks().to_batches())) for k, c in zip(ks, cs)}
    after, before = np.bincount([1] * 7 + [2], minlength=classlm.CLASSES), np.bincount([1] * 7 + [2], minlength=classlm.CLASSES)
    assert (counts[0] == [*after, *before, 7]).all()
