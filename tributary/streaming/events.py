"""Windowed counts, a stream-stream join and kept profiles over a stream of interactions; on a bounded table the same functions give the batch result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def daily_counts(rows: DataFrame, late: str = "3 days") -> DataFrame:
    """Events by day and type. Late children arrive up to three days after their parents."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def sessions(rows: DataFrame, gap: str = "1 day", late: str = "3 days") -> DataFrame:
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def clicks_after(impressions: DataFrame, clicks: DataFrame, within: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Rows (user_id, item_id, shown, clicked): each impression with the clicks of its user and item within a time of it.

    impressions and clicks have user_id, item_id and ts. On streams both sides wait `late` for late rows; the time bound lets the
    engine forget an impression when no click can match it any more. On tables it is the same join.
    """
    a = impressions.select(F.col("user_id").alias("u"), F.col("item_id").alias("i"), F.col("ts").alias("shown"))
    b = clicks.select("user_id", "item_id", F.col("ts").alias("clicked"))
    if a.isStreaming:
        a = a.withWatermark("shown", late)
    if b.isStreaming:
        b = b.withWatermark("clicked", late)
    near = (F.col("clicked") >= F.col("shown")) & (F.col("clicked") <= F.col("shown") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("u") == F.col("user_id")) & (F.col("i") == F.col("item_id")) & near).select("user_id", "item_id", "shown", "clicked")


PROFILE = "user_id long, item_id int, weight double, at timestamp"


def decayed(rows: DataFrame, half_life_days: float = 30.0) -> DataFrame:
    """Rows (user_id, item_id, weight, at): each user's liked items, a like counting 1 when it happens and half a half-life on.

    weight is as of `at`, the newest like of the pair. On a stream, rows are what changed in a micro-batch, one a pair, the last
    being the whole; state is one number and one time a pair, so that no user's history is kept or gathered. rows: user_id
    long, item_id int, ts timestamp. Likes may come in any order: an older one adds what is left of it.
    """
    rows = rows.select("user_id", "item_id", "ts")
    if not rows.isStreaming:
        newest = Window.partitionBy("user_id", "item_id")
        age = (F.unix_micros(F.max("ts").over(newest)) - F.unix_micros("ts")) / 86_400e6
        weighed = rows.withColumn("w", F.pow(F.lit(0.5), age / half_life_days))
        return weighed.groupBy("user_id", "item_id").agg(F.sum("w").alias("weight"), F.max("ts").alias("at"))
    return rows.groupBy("user_id", "item_id").transformWithStateInPandas(_Decay(half_life_days), PROFILE, "Update", "None")


class _Decay(StatefulProcessor):
    """Keeps (weight, newest time) of a pair."""

    def __init__(self, half_life_days: float):
        self.half_life_days = half_life_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pair", "weight double, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = lambda a, b: (a - b) / pd.Timedelta(days=1)
        weight, at = 0.0, None
        if self.state.exists():
            weight, at = self.state.get()
            at = pd.Timestamp(at)
        for part in rows:
            for ts in part["ts"]:
                if at is None or ts >= at:
                    weight = 1.0 + (0.0 if at is None else weight * 0.5 ** (days(ts, at) / self.half_life_days))
                    at = ts
                else:
                    weight += 0.5 ** (days(at, ts) / self.half_life_days)
        self.state.update((weight, at.to_pydatetime()))
        yield pd.DataFrame({"user_id": [key[0]], "item_id": [key[1]], "weight": [weight], "at": [at]})

    def close(self) -> None:
        pass
