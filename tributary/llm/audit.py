"""How filters interact: what every order of a set of filters keeps, removes and loses, from counts of failure masks.

A document's mask has a bit for each filter that it fails. All that an order of filters does follows from how many documents
have which mask: the survivors of a set S of filters are those whose mask lies within S's complement, so one subset-zeta
transform of a part's 2**k counts gives the survivors of all 2**k sets, and a step of an order is the difference of two of
them. The same transform of the counts of labelled documents gives the labels lost. Beyond the counts nothing depends on the
number of documents; the texts are read once.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import pick

FILTERS = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails: A too short, B too few different words, C too many capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    both = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))), F.lit(0))
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    return [
        both["n"] < 200,
        100 * both["distinct"].cast("long") < 50 * both["n"].cast("long"),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): how many documents of each lang fail just the filters of the mask.

    Filter E is failed by a text that a row of smaller doc_id has too, wherever it is (a null id is the greatest; rows of
    equal id don't fail by each other). Texts count as equal by two 64-bit hashes and their length. A null text counts as
    empty, a null lang is the part ''. A document is good or toxic if any of its labels says so; without an id it has none.
    """
    rows = pick(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    bits = sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(text_failures(F.col("text")))), F.lit(0))
    slim = rows.select("doc_id", "part", bits.alias("mask"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), F.length("text").alias("chars"))
    same = ["h1", "h2", "chars"]
    # rows that are alike become one before anything is dealt by id or by text
    once = slim.groupBy("doc_id", "part", "mask", *same).agg(F.count("*").alias("n"))
    known = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    labelled = once.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # of equal texts only those of the least id pass E: each kind of row tells its least id and how many have it
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    by_kind = labelled.groupBy(*same, "part", "mask", "good", "toxic").agg(F.min(F.struct(order.alias("id"), "n")).alias("least"), F.sum("n").alias("n"))
    first = F.min("least.id").over(Window.partitionBy(*same))  # over parts and labels, however many rows these stand for
    told = by_kind.select("part", "mask", "good", "toxic", "n", F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0).alias("passing"))
    ways = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    flat = told.select("part", "good", "toxic", ways.alias("w")).select("part", "good", "toxic", "w.mask", "w.n")
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), only("good"), only("toxic"))


def survivors(counts: Column, k: int) -> Column:
    """By set of filters, how many fail none of its k filters; counts: array of 2**k counts by mask."""

    def added(bit: int):
        below = lambda c, i: F.when(F.shiftright(i, bit).bitwiseAND(1) == 1, F.get(c, i - (1 << bit))).otherwise(0)
        return lambda c: F.transform(c, lambda x, i: x + below(c, i))

    for bit in range(k):
        counts = F.get(F.transform(F.array(counts), added(bit)), F.lit(0))  # in an array of one, so that it is worked out once
    return F.reverse(counts)  # the complement of a set is its mirror image


def order_steps(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from rows (part, mask, n, good, toxic).

    kept: left after the step; removed: by it; redundant: fail its filter and were removed before; unique_fails: fail no
    other filter; good_lost, toxic_lost: removed with that label; shapley: what the filter removes, summed over all orders.
    There are len(filters)! orders. A part's counts are at most 2**len(filters) rows; an empty table has no parts.
    """
    k = len(filters)
    full = 1 << k
    kinds = ("n", "good", "toxic")
    lists = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*kinds)))).alias("by_mask"))
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(full - 1)), lambda m: F.coalesce(F.try_element_at("by_mask", m)[c], F.lit(0).cast("long")))
    arrays = lists.select("part", *[at(c).alias(f"own_{c}") for c in kinds]).select("part", "own_n", *[survivors(F.col(f"own_{c}"), k).alias(f"left_{c}") for c in kinds])
    weight = [factorial(s) * factorial(k - 1 - s) for s in range(k)]

    def shapley(i: int) -> Column:
        """Each set without the filter comes before it in so many orders."""
        sets = [s for s in range(full) if not s >> i & 1]
        return F.expr(" + ".join(f"{weight[s.bit_count()]}L * (left_n[{s}] - left_n[{s | 1 << i}])" for s in sets))

    values = arrays.withColumn("shapley", F.array(*[shapley(i) for i in range(k)]))
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(filters[j] for j in order), "step": step, "i": i, "bit": 1 << i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    told = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, i: int, bit: int, before: int, after: int>>")
    rows = values.withColumn("s", F.explode(told))
    lost = lambda c: F.get(f"left_{c}", F.col("s.before")) - F.get(f"left_{c}", F.col("s.after"))
    fails = F.get("left_n", F.lit(0)) - F.get("left_n", F.col("s.bit"))
    return rows.select(
        "part", "s.filter_order", "s.step", F.get("left_n", F.col("s.after")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        F.get("own_n", F.col("s.bit")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("s.i")).alias("shapley"),
    )


ORACLE = r"""
WITH t AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS text, l.good, l.toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), first < doc_id] AS bad
  FROM w
), m AS (
  SELECT part, bad, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL
), five AS (SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM five a, five b, five c, five d, five e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT o, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS earlier FROM orders, five s
), x AS (
  SELECT *, bad[own] AS fails, len(list_filter(earlier, lambda j: bad[j])) > 0 AS gone, len(list_filter(bad, lambda y: y)) = 1 AS alone FROM m, steps
), r AS (
  SELECT part, o, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM r
"""
