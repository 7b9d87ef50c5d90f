"""Quality and language models against plain versions; long texts and empty tables of the operators that read documents."""

import math

import numpy as np
from pyspark.sql import functions as F

from tributary.llm import classlm, langid, neardup, packing, quality

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def quality_rows(n=300, seed=1):
    rng = np.random.default_rng(seed)
    text = lambda good: " ".join(("word" if good or rng.random() < 0.6 else "X#!") + str(rng.integers(0, 9)) for _ in range(int(rng.integers(5, 60))))
    y = [int(rng.random() < 0.7) for _ in range(n)]
    return [(quality.statistics(text(v)), v if rng.random() < 0.9 else 1 - v) for v in y]


def plain_isotonic(x, y):
    """The increasing least-squares fit by its min-max formula."""
    order = np.argsort(x, kind="stable")
    y = np.asarray(y, float)[order]
    total = np.concatenate([[0], np.cumsum(y)])
    mean = lambda a, b: (total[b + 1] - total[a]) / (b + 1 - a)
    return np.asarray(x)[order], np.array([max(min(mean(a, b) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))])


def test_quality_solves_the_normal_equations_and_pools(spark):
    rows = quality_rows()
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, y int").repartition(5))
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -8, 8)
    phi = np.hstack([np.ones((len(x), 1)), np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.lines + model.shift)])
    penalty = np.diag([1e-6] + [1.0] * quality.FEATURES)
    weights = np.linalg.solve(phi.T @ phi + penalty, phi.T @ y)
    assert np.allclose(model.raw(x), phi @ weights, atol=1e-6)
    bins = np.round(np.clip(phi @ weights, -1, 2) * quality.BINS / 3).astype(int)
    unique = np.unique(bins)
    at, fitted = plain_isotonic(np.repeat(unique, [(bins == b).sum() for b in unique]), np.concatenate([[y[bins == b].mean()] * (bins == b).sum() for b in unique]))
    got = dict(zip(unique, [fitted[list(at).index(b)] for b in unique]))
    for b in unique[::7]:  # in a pooled block the curve goes through the block's middle
        k = np.flatnonzero(np.isclose(model.value, got[b], atol=1e-9))
        assert len(k) == 1
    assert (np.diff(model.value) > 0).all()


def test_pooling_equals_the_min_max_formula():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = np.arange(30.0), rng.integers(0, 2, 30).astype(float)
        at, value = quality.pooled(x, y, np.ones(30))
        _, want = plain_isotonic(x, y)
        assert np.allclose(np.unique(np.round(want, 12)), np.round(value, 12))


def test_language_posterior_equals_plain_bayes(spark):
    texts = [(i, t * 30, lang) for i, (t, lang) in enumerate([("the cat and the dog were here ", "en"), ("der hund und die katze waren hier ", "de")] * 12)]
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    pages = [(0, "the", "http://a.de/x", "en"), (1, "die", "http://a.de/y", "de"), (2, "cat", "http://b.com/", "de"), (3, "", "http://b.com/", "xx"), (4, "und the", None, None), (5, "die katze", "http://c.de", None)]
    rows = spark.createDataFrame(pages, "page_id long, body string, url string, said string")
    got = {r.page_id: r for r in langid.identify(rows, model, "page_id", "body", url_col="url", declared_col="said").collect()}
    logs = {p[0]: model.evidence(p[1])[0] for p in pages}
    soft = lambda v: np.exp(v - np.max(v)) / np.exp(v - np.max(v)).sum()
    host = {0: "a.de", 1: "a.de", 2: "b.com", 3: "b.com", 4: "", 5: "c.de"}
    suffix = {h: h.rpartition(".")[2] if "." in h else "" for h in host.values()}
    lettered = [p[0] for p in pages if p[1]]
    share = lambda keep: sum((soft(logs[i]) for i in lettered if keep(i)), np.zeros(2))
    base = share(lambda i: True) + 1
    base /= base.sum()
    said = {p[0]: p[3] if p[3] in model.languages else ("" if p[3] is None else "?") for p in pages}
    kinds = set(said.values())
    told = {s: share(lambda i, s=s: said[i] == s) for s in kinds}
    per_language = sum(told.values()) + 1
    for p in pages:
        pull = lambda counts, prior: (counts + 20 * prior) / (counts.sum() + 20)
        prior = pull(share(lambda i: host[i] == host[p[0]]), pull(share(lambda i: suffix[host[i]] == suffix[host[p[0]]]), base))
        post = soft(logs[p[0]] + np.log(prior) + np.log((told[said[p[0]]] + 1 / len(kinds)) / per_language))
        assert got[p[0]].lang == model.languages[int(np.argmax(post))] and math.isclose(got[p[0]].posterior, post.max(), rel_tol=1e-9)


def test_very_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{i % 5000}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text here"), (4, None), (5, "")], DOCS)
    near = {r.doc_id: r for r in neardup.near_duplicates(docs, width=4, percent=80).collect()}
    assert near[2].component_id == 1 and near[1].n_shingles == 5000 and near[3].kept and near[4].n_shingles == 0
    scored = {r.doc_id: r for r in classlm.score(docs, F.lit(True)).collect()}
    assert scored[1].n_tokens == 150_001 and scored[4].n_tokens == scored[5].n_tokens == 1 and scored[4].score == scored[5].score
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], LABELS)
    good = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert len(good) == 5 and good[4] == good[5]
    none = docs.where("false")
    assert neardup.near_duplicates(none).count() == 0 and classlm.score(none, F.lit(True)).count() == 0 and quality.classify(none, labels).count() == 0


def test_equal_ids_are_judged_by_their_own_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame([(3, a), (7, a), (7, b)], DOCS), width=4, percent=80).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 7, True)]


def test_packing_passes_all_other_columns(spark):
    items = spark.createDataFrame([(i, 0, 10 + i % 3, i, -i) for i in range(50)], "doc_id long, piece int, length long, _salt int, _rank int")
    got = packing.pack(items, 32)
    assert got.columns == ["doc_id", "piece", "length", "_salt", "_rank", "sequence_id", "offset"]
    assert got.where("_salt <> doc_id OR _rank <> -doc_id").count() == 0
