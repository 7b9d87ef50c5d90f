"""Temporal train/test split by session, relevance, seen items, popularity and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRADES = {"save": 2, "click": 1}


def graded(rows: DataFrame, grades: dict[str, int] | None = None) -> DataFrame:
    """With column grade: null for events that carry none."""
    m = F.create_map(*[F.lit(x) for kv in (grades or GRADES).items() for x in kv])
    return rows.withColumn("grade", m[F.col("event_type")])


def with_split(rows: DataFrame, fraction: float = 0.2) -> DataFrame:
    """With is_test: each user's last max(1, half-even round of fraction * sessions) sessions are test."""
    w = Window.partitionBy("user_id")
    last = F.max("session_no").over(w)
    return rows.withColumn("is_test", F.col("session_no") > last - F.greatest(F.lit(1), F.bround(last * F.lit(fraction), 0).cast("int")))


def relevance(test_rows: DataFrame) -> DataFrame:
    """Greatest grade by user and item; train-seen items stay in."""
    return graded(test_rows).where("grade IS NOT NULL").groupBy("user_id", "item_id").agg(F.max("grade").alias("grade"))


def seen(train_rows: DataFrame) -> DataFrame:
    return train_rows.select("user_id", "item_id").distinct()


def popularity(train_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Count of click and save events by item, zero for items without, over the whole catalog."""
    counts = train_rows.where(F.col("event_type").isin("click", "save")).groupBy("item_id").agg(F.count("*").alias("cnt"))
    return catalog.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def history(train_rows: DataFrame, last: int = 40) -> DataFrame:
    """Each user's last click and save events."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("item_id").desc(), F.col("event_type").desc())
    return train_rows.where(F.col("event_type").isin("click", "save")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
