"""A recommender around an injected scorer, such as a language model: prompts, cached replies, validated picks.

The scorer is any function from a list of prompts to as many replies. It gets an Arrow batch at a time, only prompts that the
cache doesn't know, each once. What it replies is parsed by the engine; what can't be parsed is an empty list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.recommend import placed, top_k, unseen
from tributary.sources.durable import Durable

Scorer = Callable[[list[str]], list[str]]
CACHE = "key string, reply string"


def prompt_key(model: str) -> Column:
    """What a reply is kept by: the model and the whole prompt."""
    return F.sha2(F.concat_ws("\0", F.lit(model), F.coalesce("prompt", F.lit(""))), 256)


def parsed(reply: str) -> Column:
    """The integers of a reply that is a JSON list; anything else gives an empty list, and a null among them is dropped."""
    none = F.array().cast("array<int>")
    listed = F.from_json(F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"(?s)(\[.*\])", 1), "array<int>", {"mode": "PERMISSIVE"})
    return F.filter(F.coalesce(listed, none), lambda x: x.isNotNull())


def asked(prompts: DataFrame, scorer: Scorer) -> DataFrame:
    """Rows (key, reply) for rows (key, prompt). A scorer that gives another number of replies is an error."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = scorer(batch.column("prompt").to_pylist()) if batch.num_rows else []
            if len(replies) != batch.num_rows:
                raise ValueError(f"{len(replies)} replies to {batch.num_rows} prompts")
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(replies, pa.string())], names=["key", "reply"])

    return prompts.select("key", "prompt").mapInArrow(go, CACHE)


def replies(prompts: DataFrame, cache: DataFrame, model: str, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """prompts with key and reply behind, and the cache to write: as it was, with the new replies that parse to something.

    prompts has a column prompt (null: empty). New replies are written before anything reads them, so that the scorer isn't
    asked again when a plan runs twice or an executor is lost afterwards. A failed reply isn't cached: it is asked again.
    """
    held = Durable(prompts.sparkSession)
    keyed = prompts.withColumn("prompt", F.coalesce("prompt", F.lit(""))).withColumn("key", prompt_key(model))
    known = cache.select("key", "reply").where("key IS NOT NULL").dropDuplicates(["key"])
    new = keyed.select("key", "prompt").dropDuplicates(["key"]).join(known, "key", "left_anti")
    answered = held.keep(asked(new, scorer))
    lasting = known.unionByName(answered.where(F.size(parsed("reply")) > 0))
    return keyed.join(known.unionByName(answered), "key", "left"), lasting


def pair_scores(pairs: DataFrame, cache: DataFrame, model: str, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """pairs (with a column prompt holding both texts) with a score, as a cross-encoder gives it, and the cache to write.

    A reply that is no number scores null, and isn't cached.
    """
    rows, _ = replies(pairs, cache, model, scorer)
    scored = rows.withColumn("score", F.col("reply").try_cast("double"))
    known = scored.where("score IS NOT NULL").select("key", "reply").unionByName(cache.select("key", "reply")).dropDuplicates(["key"])
    return scored.drop("key", "reply"), known


@dataclass
class Asked:
    """Ranks by what a scorer picks: places in the catalog, in item order, named in a JSON list.

    Unknown places, seen items and repeats are dropped; a user without a usable reply gets no rows.
    """

    prompts: DataFrame
    catalog: DataFrame
    seen: DataFrame
    cache: DataFrame
    model: str
    scorer: Scorer

    def recommend(self, users: DataFrame, k: int) -> DataFrame:
        mine = self.prompts.select("user_id", "prompt").join(users, "user_id", "left_semi")
        rows, self.cache = replies(mine, self.cache, self.model, self.scorer)
        picks = rows.select("user_id", F.posexplode(parsed("reply")).alias("turn", "place"))
        at = placed(self.catalog.select("item_id"), F.col("item_id")).select("item_id", F.col("place").cast("int").alias("place"))
        once = unseen(picks.join(at, "place"), self.seen).groupBy("user_id", "item_id").agg(F.min("turn").alias("turn"))
        return top_k(once, k, F.col("turn"), F.col("item_id")).select("user_id", "rank", "item_id")
