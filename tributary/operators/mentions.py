"""Names of a dictionary in free text, by joins on token n-gram keys; the longest name at a place wins.

Every run of as many words as some name has becomes a key; keys join the dictionary's. Only keys and places move, no
text, so a dictionary of any size works: a small one is sent to the tasks, a large one meets the keys in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: str) -> Column:
    """Lower-cased words: letters and digits of ASCII and all characters beyond it."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def _keys(words: Column) -> list[Column]:
    joined = F.array_join(words, " ")
    return [F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit("second"), joined).alias("h2")]


def dictionary(names: DataFrame) -> DataFrame:
    """Rows (name_id, n, h1, h2) of names (name_id, name), once for each different form; names without words are left out."""
    split = names.select("name_id", tokens("name").alias("w")).where(F.size("w") > 0)
    return split.select("name_id", F.size("w").alias("n"), *_keys(F.col("w"))).distinct()


def find_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (text_id, start, n, name_id): where a name of names (name_id, name) stands in texts (text_id, text).

    start counts words from 0, n is the name's number of words. A mention that lies within a longer one is dropped; mentions
    that overlap otherwise all stay, and so do several ids of one name. Text ids are unique; null texts have no mentions.
    Names are of bounded length: the different numbers of words are looked up beforehand, and each is one key a place.
    """
    known = dictionary(names)
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # numbers of words: a few
    words = texts.select("text_id", tokens("text").alias("words"))
    starts = F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n")
    places = words.select("text_id", "words", starts).where(F.size("words") >= F.col("n"))
    runs = places.select("text_id", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.struct(*_keys(F.slice("words", i, F.col("n")))))).alias("start", "k"))
    found = runs.select("text_id", "start", "n", "k.h1", "k.h2").join(known, ["n", "h1", "h2"])
    before = Window.partitionBy("text_id").orderBy("start", F.col("n").desc())
    reach = F.max(F.col("start") + F.col("n")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    longest = F.max("n").over(Window.partitionBy("text_id", "start"))
    # one row a place and length decides, whatever ids the name has
    spans = found.select("text_id", "start", "n").distinct().withColumn("reach", reach).withColumn("longest", longest)
    kept = spans.where((F.col("n") == F.col("longest")) & (F.col("reach").isNull() | (F.col("reach") < F.col("start") + F.col("n")))).select("text_id", "start", "n")
    return found.join(kept, ["text_id", "start", "n"]).select("text_id", "start", "n", "name_id")


def grounding(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows (text_id, mentions, grounded, rate): how many of a text's mentions are of its candidates (text_id, name_id).

    Texts without mentions have nothing to ground and no row.
    """
    at = mentions.join(candidates.select("text_id", "name_id").distinct().withColumn("ok", F.lit(1)), ["text_id", "name_id"], "left")
    # a place with several ids of one name is grounded if one of them is a candidate
    place = at.groupBy("text_id", "start", "n").agg(F.max(F.coalesce("ok", F.lit(0))).alias("ok"))
    return place.groupBy("text_id").agg(F.count("*").alias("mentions"), F.sum("ok").alias("grounded")).withColumn("rate", F.round(F.col("grounded") / F.col("mentions"), 6))
