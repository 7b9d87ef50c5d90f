"""License rules, the filter audit and periodic runs against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations, product

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tributary.llm import audit, licenses, registry, runs
from tributary.llm.licenserules import BASE, RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


# --- license rules


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_scan(text):
    words = words_of(text)
    body = " " + "  ".join(words) + " "
    found = []
    for i, r in enumerate(RULES):
        for m in re.finditer(r.regex, body):
            start = body[: m.start()].count(" ") // 2
            found.append((start, start + m.group().count(" ") // 2, i, r.kind, r.label, r.base))
    base = [f for f in found if f[5]]
    kept = [
        d for d in found
        if not any(e[3] <= d[3] and e[0] <= d[0] and e[1] >= d[1] and ((e[0], e[1]) != (d[0], d[1]) or e[2] < d[2]) for e in found if e is not d)
    ]
    labels = {f[4] for f in base} | {f[4] for f in kept}
    score = max([{1: 1.0, 2: 0.8, 3: 0.5}[f[3]] for f in kept], default=0.0)
    starts = [f[0] for f in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({f[4] for f in base})), ",".join(sorted(labels)), score


def some_match(pattern):
    """Strings that a rule's pattern matches: every way through its groups, classes by their first character."""
    pattern = re.sub(r"\(\?: \[\^ \]\+\)\{(\d),\d+\}", lambda m: " x" * int(m.group(1)), pattern)
    pattern = pattern.replace("[cs]", "c").replace("[0-9]", "7")

    def alternatives(s):
        depth, parts, at = 0, [], 0
        for i, c in enumerate(s):
            depth += (c == "(") - (c == ")")
            if c == "|" and depth == 0:
                parts.append(s[at:i])
                at = i + 1
        return [*parts, s[at:]]

    def ways(s):
        out = [""]
        i = 0
        while i < len(s):
            if s.startswith("(?:", i):
                depth, j = 1, i + 3
                while depth:
                    depth += (s[j] == "(") - (s[j] == ")")
                    j += 1
                inner = [w for a in alternatives(s[i + 3 : j - 1]) for w in ways(a)]
                i = j
            else:
                inner, i = [s[i]], i + 1
            if i < len(s) and s[i] == "?":
                inner, i = [*inner, ""], i + 1
            out = [a + b for a, b in product(out, inner)]
        return out

    return [w for a in alternatives(pattern) for w in ways(a)]


def test_rules_hold_a_keyword_in_every_match():
    assert len(RULES) >= 200
    for r in RULES:
        for text in some_match(r.pattern):
            body = " " + "  ".join(text.split()) + " "
            assert re.fullmatch(r.regex, body), (r, text)
            assert set(r.keys) & set(text.split()), (r, text)


def test_base_phrases_do_not_overlap_themselves():
    for _, phrase in BASE:
        w = phrase.split()
        assert not any(w[:n] == w[-n:] for n in range(1, len(w)))


def test_license_scan_equals_plain_version(spark):
    rng = random.Random(3)
    pool = [w for r in RULES for w in some_match(r.pattern)[:3]] + ["plain words here", "or any later version", "the", "mit", "apache", "2.0"]
    texts = [" ".join(rng.choice([p, p.title(), p.replace(" ", "-")]) for p in rng.choices(pool, k=rng.randint(0, 12))) for _ in range(250)]
    texts += ["", None, "Licensed under the Apache License, Version 2.0.", "licensed under CC BY-NC 4.0", "GNU\tGeneral\nPublic -- License, version 3", "Kelvin MIT License é", "mit licenseé", "cc by cc by by cc by"]
    got = licenses.digest(licenses.scan(docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)]))).collect()
    for r in got:
        assert tuple(r)[1:] == plain_scan(texts[r.doc_id]), texts[r.doc_id]


def test_license_scan_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = registry.QUERIES["op11_license_rules"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        assert tuple(r)[1:] == plain_scan(text[r.doc_id])


def test_license_scan_edges(spark):
    long = "mit license " * 3000 + "spdx license identifier mit"
    rows = [(None, None, None), (1, "", "en"), (1, "MIT License", "en"), (1, "MIT License", "en"), (2, long, "en")]
    got = {(r.doc_id, r.n_words): r for r in licenses.digest(licenses.scan(docs_of(spark, rows))).collect()}
    assert got[(None, 0)].labels == "" and got[(None, 0)].first_word is None and got[(None, 0)].score == 0.0
    assert got[(1, 2)].labels == "mit" and got[(1, 2)].n_base == 1
    big = got[(2, 6004)]
    assert (big.n_base, big.first_word, big.last_word, big.labels, big.score) == (3000, 0, 5998, "mit", 1.0)
    assert licenses.digest(licenses.scan(docs_of(spark, rows).where("false"))).count() == 0
    clash = docs_of(spark, rows[2:3]).select("doc_id", "text", F.lit("x").alias("TEXT"), F.lit(3).alias("doc_id"), F.lit(1).alias("words"), F.lit(1).alias("body"))
    assert [r.labels for r in licenses.digest(licenses.scan(clash)).collect()] == ["mit"]


def test_license_scan_stays_in_the_jvm_and_does_not_shuffle(spark):
    plan = registry.QUERIES["op11_license_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "Exchange" not in plan


# --- filter audit


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    order = lambda i: (i is None, i or 0)
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((u or "") == t and order(j) < order(i) for j, u, _ in rows),
        }
        docs.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = of
            for step, f in enumerate(o, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                total[f] += len(gone)
                fails = [d for d in of if f in d[1]]
                out[(part, "".join(o), step)] = [len(left), len(gone), len(fails) - len(gone), sum(d[1] == {f} for d in of), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]]
    return out


def test_audit_equals_plain_version(spark):
    rng = random.Random(5)
    texts = ["", None, "a b c", "x " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(220)) + " #", "A" * 50, "same | text", "é" * 9 + "\x0b\x1fq"]
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += [(500, "z" * 300_000 + " q" * 300, "en")]  # a very long one
    labels = [(rng.choice([*range(45), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    want = plain_audit(rows, labels)
    # by rank of the null id: rows of equal id never fail by each other
    docs = docs_of(spark, rows).repartition(7)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.order_steps(audit.failure_counts(docs, known)).collect()}
    assert got == want
    assert audit.order_steps(audit.failure_counts(docs.where("false"), known)).count() == 0
    none = audit.order_steps(audit.failure_counts(docs, known.where("false"))).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)
    clash = docs.select("*", F.lit(1).alias("Lang"), F.lit("x").alias("text"), F.lit(9).alias("mask"), F.lit(9).alias("n"), F.lit(9).alias("h1"))
    assert audit.order_steps(audit.failure_counts(clash, known)).count() == len(want)


@pytest.mark.parametrize("k", [1, 3, 4])
def test_survivors_by_subset(spark, k):
    rng = random.Random(k)
    counts = [rng.randrange(50) for _ in range(1 << k)]
    got = spark.range(1).select(audit.survivors(F.lit(counts).cast("array<bigint>"), k).alias("s")).first().s
    assert got == [sum(c for m, c in enumerate(counts) if not m & s) for s in range(1 << k)]


# --- periodic runs


def plain_runs(words):
    """Every period tried on the whole text; a stretch goes to its least period."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def with_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_equal_plain_version():
    rng = random.Random(13)
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice(b"ab" if rng.random() < 0.5 else b"abcdefgh") for _ in range(rng.randint(1, 30))]
            parts += (unit * rng.randint(1, 12))[: rng.randint(1, 200)]
        texts.append([bytes([c]) for c in parts])
    texts += [[b"a"] * n for n in (0, 1, 23, 24, 25, 1000)] + [[b"a", b"b"] * n for n in (11, 12, 300)]
    for t, got in zip(texts, runs.find(texts)):
        assert got == plain_runs(t), t


def test_runs_in_parts_of_the_grid(monkeypatch):
    monkeypatch.setattr(runs, "GRID", 50)
    t = [b"x"] * 5 + [b"a", b"b", b"c"] * 40 + [b"q"] * 30
    assert runs.find([t])[0] == plain_runs(t)


def test_periodic_runs_of_given_documents(spark):
    text = {r.doc_id: (r.text or "").encode().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(got) == len(text) and sum(r.n_runs for r in got) > 0
    for r in got:
        words = with_tail(r.doc_id, text[r.doc_id])
        found = plain_runs(words) if len(words) < 6000 else runs.find([words])[0]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found)).hexdigest()
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])


def test_periodic_runs_edges(spark):
    rows = [(None, None, "en"), (1, "", "en"), (2, "a " * 30, "en"), (2, "a " * 30, "en"), (3, "b c\td\n" * 200_000, "en"), (4, "é ü " * 30, "en")]
    docs = docs_of(spark, rows)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()]
    assert got[0] == (None, 0, [], "") and got[1] == (1, 0, [], "")
    assert got[2] == got[3] == (2, 30, [(0, 30, 1)], "a")
    assert got[4] == (3, 600_000, [(0, 600_000, 3)], "b c d")
    assert got[5] == (4, 30, [(0, 30, 1)], "é ü")
    assert runs.periodic_runs(docs.where("false")).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("Text"), F.lit(2).alias("runs"), F.lit(2).alias("doc_id"))
    assert runs.periodic_runs(clash).count() == len(rows)
