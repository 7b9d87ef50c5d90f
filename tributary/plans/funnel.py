"""The whole funnel as one plan: retrieve, filter, rank, rerank, explain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import recommend, rerank, split
from tributary.operators.blocks import best_items
from tributary.sources.durable import Durable


@dataclass
class Funnel:
    """What changes between kinds of entities: how many survive each step, and the attribute lists are spread over."""

    retrieve: int = 50
    final: int = 10
    bucket: str = "country"
    cap: int = 3

    def run(self, users: DataFrame, personas: DataFrame, catalog: DataFrame, train: DataFrame) -> DataFrame:
        """Rows (user_id, rank, item_id, score): taste and popularity, unseen, at most cap of a bucket.

        Users who have seen nothing get what their taste gets, worked out once.
        """
        pop, seen = split.popularity(train, catalog), split.seen(train)
        items = recommend.item_vectors(catalog).join(pop.select("item_id", (0.1 * F.ln(F.col("cnt") + 1.0)).alias("bias")), "item_id")
        items = Durable(users.sparkSession).keep(items)
        known = users.join(seen.select("user_id").distinct(), "user_id", "left_semi")
        new = recommend.with_taste(users.join(seen.select("user_id").distinct(), "user_id", "left_anti"))
        alike = self._spread(best_items(recommend.taste_queries(new, personas), items, self.retrieve), catalog)
        own = self._spread(recommend.persona_best(known, personas, items, self.retrieve, seen), catalog)
        return own.unionByName(recommend.handed(new, alike, "item_id", "score"))

    def _spread(self, near: DataFrame, catalog: DataFrame) -> DataFrame:
        lists = near.select("user_id", "item_id", "score").join(catalog.select("item_id", self.bucket), "item_id").withColumnRenamed("user_id", "list_id")
        return rerank.round_robin(lists, self.bucket, self.final, self.cap).select(F.col("list_id").alias("user_id"), "rank", "item_id", "score")
