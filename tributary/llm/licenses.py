"""License scan by ordered signature rules, in DataFrame functions only, a row at a time: no shuffle.

A text's words are taken once. The keywords among them choose the rules that can match (all others cost nothing), and only
those rules' regular expressions run, over the words with fixed spacing. A detection is the interval of words of one match. It
is suppressed where another detection of the same or a better class covers its interval and is longer, or has the same interval
and stands earlier in the order of rules. What is left gives the labels.

Intervals are summed up and compared in one pass over sorted arrays, in chunks of CHUNK, so that a text with very many matches
costs little more than its length.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import pick
from tributary.llm.licenserules import BASE, RULES, Rule

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How sure a surviving detection of each class is.
SURE = {1: 1.0, 2: 0.8, 3: 0.5}
CHUNK = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "array<struct<start: bigint, end: bigint>>"
_FOUND = "array<struct<start: bigint, minus_end: bigint, rule: int, kind: int>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chunks(items: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(slice, number from 0) for each chunk of a non-empty array, as an array."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.transform(numbers, lambda c: f(F.slice(items, c * CHUNK + 1, F.lit(CHUNK)), c))


def _n_words(text: Column) -> Column:
    """Words of a piece of spaced text, by its spaces: two for each word."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _spans(body: Column, regex: Column) -> Column:
    """The (start, end) of all matches of regex in spaced text, counted in words."""

    def placed(steps: Column) -> Column:
        total = _chunks(steps, lambda part, _: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + x["long"]))

        def walk(part: Column, at: Column) -> Column:
            first = F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out"))

            def step(a: Column, x: Column) -> Column:
                start = a["at"] + x["gap"]
                end = start + x["long"]
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

            return F.aggregate(part, first, step, lambda a: a["out"])

        def chained(totals: Column) -> Column:
            before = lambda c: F.aggregate(F.slice(totals, F.lit(1), c), F.lit(0).cast("bigint"), lambda a, x: a + x)
            return F.flatten(_chunks(steps, lambda part, c: walk(part, before(c))))

        return _let(total, chained)

    matches = F.regexp_extract_all(body, regex, F.lit(0))
    pieces = F.split(body, regex, -1)
    zipped = F.zip_with(matches, pieces, lambda m, p: F.struct(_n_words(p).alias("gap"), _n_words(m).alias("long")))  # one piece more than matches
    steps = F.filter(zipped, lambda x: x["long"].isNotNull())
    return _let(steps, lambda s: F.when(F.size(s) > 0, placed(s)).otherwise(F.array().cast(_SPAN)))


def _constant(value: list, kind: str) -> Column:
    """A constant array, told as JSON so that it is one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _rules(rules: list[Rule]) -> Column:
    told = [{"rule": i, "kind": r.kind, "keys": r.keys, "regex": r.regex} for i, r in enumerate(rules)]
    return _constant(told, "array<struct<rule: int, kind: int, keys: array<string>, regex: string>>")


def _survivors(found: Column) -> Column:
    """The detections, sorted by start, longest first, that none before them suppresses."""
    kinds = sorted(SURE)
    none = F.lit(-1).cast("bigint")

    def best(part: Column, kind: int) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter(part, lambda x: x["kind"] == kind), lambda x: -x["minus_end"])), none)

    def walk(part: Column, before: Column) -> Column:
        ends = [F.coalesce(F.array_max(F.transform(before, itemgetter(f"k{k}"))), none) for k in kinds]
        first = F.struct(*[e.alias(f"k{k}") for k, e in zip(kinds, ends)], F.array().cast(_FOUND).alias("out"))

        def step(a: Column, x: Column) -> Column:
            covered = F.lit(False)
            for k in kinds:
                covered = covered | ((x["kind"] >= k) & (a[f"k{k}"] >= -x["minus_end"]))
            moved = [F.when(x["kind"] == k, F.greatest(a[f"k{k}"], -x["minus_end"])).otherwise(a[f"k{k}"]).alias(f"k{k}") for k in kinds]
            return F.struct(*moved, F.when(covered, a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"))

        return F.aggregate(part, first, step, lambda a: a["out"])

    def chained(ends: Column, items: Column) -> Column:
        return F.flatten(_chunks(items, lambda part, c: walk(part, F.slice(ends, F.lit(1), c))))

    def run(items: Column) -> Column:
        tops = _chunks(items, lambda part, _: F.struct(*[best(part, k).alias(f"k{k}") for k in kinds]))
        return _let(tops, lambda ends: chained(ends, items))

    return F.when(F.size(found) > 0, run(found)).otherwise(F.array().cast(_FOUND))


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words long, base, found), one for each row of docs and in no need of a unique id.

    base: the (start, end, label) of every place of a base rule, found: the (start, end, label, kind) of the detections that
    nothing suppresses, both by start in words from 0, `end` behind the last word. Whole texts are read, however long. A null
    text counts as empty and has no words; null ids and repeated rows pass through; an empty table gives an empty one. Of
    columns whose names clash the first with exactly the name counts, others aren't read. Ties of detections go by the order
    of rules. A rule whose keywords a text lacks isn't tried.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pick(docs, id_col, text_col).toDF("id", "text").select("id", text.alias("text"))
    # lower() also changes letters beyond A-Z, but no word's bounds; it only finds the rules to try
    keys = _constant(sorted({k for r in rules for k in r.keys}), "array<string>")
    words = rows.select("id", "text", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"))
    gated = words.select("id", "text", F.size("words").cast("long").alias("n_words"), F.array_intersect(keys, "words").alias("keys"))
    spaced = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), F.lit(0)), "  "), F.lit(" "))
    # what a row's body is asked for twice or more is worked out once, by its own step
    bodies = gated.select("id", "n_words", "keys", F.when(F.size("keys") > 0, spaced).alias("body"))
    chosen = F.filter(_rules(rules), lambda r: F.arrays_overlap(r["keys"], F.col("keys")))

    def tried(r: Column) -> Column:
        one = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), r["rule"].alias("rule"), r["kind"].alias("kind"))
        return F.transform(_spans(F.col("body"), r["regex"]), one)

    every = F.when(F.col("body").isNull(), F.array().cast(_FOUND)).otherwise(F.array_sort(F.flatten(F.transform(chosen, tried))))
    found = bodies.select("id", "n_words", every.cast(_FOUND).alias("every"))
    base_from = min([i for i, r in enumerate(rules) if r.base], default=len(rules))
    label = lambda x: F.get(_constant([r.label for r in rules], "array<string>"), x["rule"])
    span = lambda x: [x["start"].alias("start"), (-x["minus_end"]).alias("end"), label(x).alias("label")]
    base = F.transform(F.filter("every", lambda x: x["rule"] >= base_from), lambda x: F.struct(*span(x)))
    kept = F.transform(_survivors(F.col("every")), lambda x: F.struct(*span(x), x["kind"].alias("kind")))
    return found.select(F.col("id").alias(id_col), "n_words", base.alias("base"), kept.alias("found"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score (that of the surest detection, else 0)."""
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts, base = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    sure = F.transform("found", lambda x: F.when(x["kind"] == 1, SURE[1]).when(x["kind"] == 2, SURE[2]).otherwise(SURE[3]))
    return scanned.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = r"""
WITH rules(rule, label, kind, base, regex) AS (VALUES
""" + ",\n".join(f"({i}, {_quoted(r.label)}, {r.kind}, {r.base}, {_quoted(r.regex)})" for i, r in enumerate(RULES)) + r"""
), keys(rule, key) AS (VALUES """ + ", ".join(f"({i}, {_quoted(k)})" for i, r in enumerate(RULES) for k in r.keys) + r"""
), t AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT row_id, doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS body, words FROM t
), w AS (
  SELECT DISTINCT row_id, unnest(words) AS key FROM t
), tried AS (
  SELECT DISTINCT row_id, rule FROM w JOIN keys USING (key)
), m AS (
  SELECT row_id, rule, label, kind, base, string_split_regex(body, regex) AS pieces, regexp_extract_all(body, regex) AS hits
  FROM tried JOIN rules USING (rule) JOIN b USING (row_id) WHERE regexp_matches(body, regex)
), c AS (
  SELECT row_id, rule, label, kind, base, i,
    length(regexp_replace(pieces[i], '[^ ]', '', 'g')) // 2 AS gap, length(regexp_replace(hits[i], '[^ ]', '', 'g')) // 2 AS long
  FROM m, LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)
), d AS (
  SELECT row_id, rule, label, kind, base, sum(gap + long) OVER (PARTITION BY row_id, rule ORDER BY i) - long AS first, sum(gap + long) OVER (PARTITION BY row_id, rule ORDER BY i) AS last FROM c
), kept AS (
  SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.row_id = d.row_id AND e.kind <= d.kind AND e.first <= d.first AND e.last >= d.last
    AND (e.first < d.first OR e.last > d.last OR e.rule < d.rule))
), based AS (
  SELECT row_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM d WHERE base GROUP BY 1
), named AS (
  SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row_id, label FROM kept UNION ALL SELECT row_id, label FROM d WHERE base) GROUP BY 1
), sure AS (
  SELECT row_id, max(CASE kind WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.5 END)::DOUBLE AS score FROM kept GROUP BY 1
)
SELECT b.doc_id, b.n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM b LEFT JOIN based USING (row_id) LEFT JOIN named USING (row_id) LEFT JOIN sure USING (row_id)
"""
