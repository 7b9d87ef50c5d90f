"""Parts of the toxicity model against plain versions."""

import math
from collections import Counter

import numpy as np
import zstandard

from tributary.llm import toxicity


def texts(seed, n, bad=()):
    rng = np.random.default_rng(seed)
    word = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    return [" ".join([str(rng.choice(word)) + str(rng.integers(0, 40)) for _ in range(int(rng.integers(20, 60)))] + [str(b) for b in (rng.choice(bad, 3) if len(bad) else [])]) for _ in range(n)]


BAD = ("wretchedness", "vileness", "scoundrels")
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def test_telling_samples_equal_plain_version():
    rows = lambda seed, bad=(): [w for t in texts(seed, 80, bad) for w in toxicity.windows(toxicity.words_of(t))]
    toxic, ordinary = rows(1, BAD), rows(2)

    def count(piece, some):
        return sum(piece in b" " + x + b" " for w in some for x in set(w.split()))

    want = []
    for w in toxic:
        kept = []
        for x in w.split():
            pieces = {(b" " + x + b" ")[i : i + 6] for i in range(len(x) - 3)} or {b" " + x + b" "}
            if any((n := count(p, toxic)) >= max(3, 0.001 * len(toxic)) and n * len(ordinary) > 30 * (count(p, ordinary) + 0.5) * len(toxic) for p in pieces):
                kept.append(x)
        if kept:
            want.append(b" " + b" ".join(kept) + b" ")
    got = toxicity.telling_samples(toxic, ordinary)
    assert got == want and {x.decode() for w in got for x in w.split()} == set(BAD)
    assert toxicity.telling_samples([], ordinary) == [] and toxicity.telling_samples(ordinary, ordinary) == []


def test_scores_are_the_logistic_curve_of_compressed_lengths(spark):
    clean, toxic = texts(3, 160), texts(4, 60, BAD)
    rows = [(i, t) for i, t in enumerate(clean + toxic)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 0, int(i >= 160)) for i, _ in rows if i % 4], LABELS)
    model = toxicity.fit(docs, labels)
    assert len(model.toxic) <= toxicity.TOXIC_BYTES and any(b.encode() in model.toxic for b in BAD) and not any(b.encode() in model.base for b in BAD)
    params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=6, target_length=0, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(window))

    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in rows[::12]:
        found = sorted((length(w, model.base + bytes(len(model.toxic))) - length(w, model.base + model.toxic) for w in toxicity.windows(toxicity.words_of(t))), reverse=True)
        top = [*(max(g, 0) for g in found[:3]), 0, 0, 0][:3]
        x = [1.0, *top, *(math.log1p(sum(g >= level for g in found)) for level in (2, 3, 4, 5)), math.log1p(len(found))]
        assert abs(got[i] - 1 / (1 + math.exp(-float(np.dot(model.weights, x))))) < 1e-9
    unseen = Counter((i >= 160, got[i] >= 0.7) for i, _ in rows if i % 4 == 0)
    assert unseen[True, True] >= 13 and unseen[False, True] <= 1  # of 15 and 40 that it didn't learn from
