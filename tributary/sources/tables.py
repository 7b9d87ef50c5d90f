"""Readers and writers of the recommendation model: catalog, users, interactions, sessions, embeddings, caches.

Files in the model's own layout come with declared schemas; `fixture_*` derive the same tables from star-schema Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed: the order of the nine ratings is part of the model.
TAGS = ["culture", "adventure", "nature", "beaches", "nightlife", "cuisine", "wellness", "urban", "seclusion"]
CATALOG_SCHEMA = "id string, city string, country string, region string, short_description string, latitude double, longitude double, avg_temp_monthly string, ideal_durations string, budget_level string, " + ", ".join(f"{t} int" for t in TAGS)
USERS_SCHEMA = "user_id string, primary_persona string, secondary_persona string, mix_weight double"
INTERACTIONS_SCHEMA = "interaction_id long, user_id string, item_id string, event_type string, session_id string, timestamp timestamp_ntz, dwell_seconds string"
SESSIONS_SCHEMA = "session_id string, user_id string, timestamp timestamp_ntz, query_text string, filter_budget_level string, filter_required_tag string"
#: The levels of a budget.
LEVELS = ["Budget", "Mid-range", "Luxury"]
EVENT_NAMES = {"view": "impression", "click": "click", "purchase": "save", "signup": "itinerary_add", "error": "not_interested"}
#: The six personas with their budgets and emphasised tags.
PERSONAS = [
    ("Budget Backpacker", ["Budget"], ["adventure", "culture"]),
    ("Luxury Relaxer", ["Luxury"], ["wellness", "beaches", "cuisine"]),
    ("Nightlife Seeker", ["Mid-range"], ["nightlife", "urban"]),
    ("Culture Buff", ["Mid-range"], ["culture", "cuisine", "urban"]),
    ("Nature & Adventure", ["Budget", "Mid-range"], ["nature", "adventure", "seclusion"]),
    ("Family Beach", ["Mid-range"], ["beaches", "wellness"]),
]


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def climate(column: str) -> Column:
    """Monthly temperatures from their JSON text, by the number of the month; null where it can't be parsed."""
    return F.from_json(column, "map<string,struct<avg:double,max:double,min:double>>")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog with JSON columns parsed and the ratings as one array in TAGS order."""
    rows = read_csv(spark, path, CATALOG_SCHEMA)
    return rows.withColumn("avg_temp_monthly", climate("avg_temp_monthly")).withColumn("ideal_durations", F.from_json("ideal_durations", "array<string>")).withColumn("tags", F.array(*TAGS))


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Blank dwell times are null."""
    return read_csv(spark, path, INTERACTIONS_SCHEMA).withColumn("dwell_seconds", F.col("dwell_seconds").try_cast("double"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Blank filters are null: no filter."""
    rows = read_csv(spark, path, SESSIONS_SCHEMA)
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("filter_budget_level", "filter_required_tag")})


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, USERS_SCHEMA)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """With a header; quotes within a text are doubled, a null is a blank, and times keep their microseconds."""
    times = {name: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" for name in ("timestampFormat", "timestampNTZFormat")}
    df.select(*columns).write.mode("overwrite").options(header=True, escape='"', emptyValue="", **times).csv(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """Keyed by id and a hash of the text it came from; an existing table is not overwritten."""
    vectors.select("item_id", F.sha2("text", 256).alias("text_sha256"), "embedding").write.mode("errorifexists").parquet(path)


def write_cache(picks: DataFrame, path: str) -> None:
    """Successful replies only."""
    picks.where(F.size("picks") > 0).write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, picks array<int>").json(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interactions; a new session starts after a day's gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    names = F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])
    rows = table(spark, sf_dir, "events").withColumn("new", F.when(before.isNull() | (F.col("ts") > before + F.expr("INTERVAL 1 DAY")), 1).otherwise(0))
    return rows.select(
        F.col("event_id").alias("interaction_id"), "user_id", F.from_json("props", "k int")["k"].alias("item_id"), names[F.col("event_type")].alias("event_type"), "ts",
        F.when(F.col("event_type") == "click", F.col("value")).alias("dwell"), F.sum("new").over(w).cast("int").alias("session_no"),
    )


def fixture_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that have a vector, whether or not an event is about them."""
    key = F.col("p_partkey")
    level = F.when(key % 10 < 3, "Budget").when(key % 10 < 9, "Mid-range").otherwise("Luxury")
    parts = table(spark, sf_dir, "part").select(key.cast("int").alias("item_id"), F.col("p_name").alias("city"), F.col("p_brand").alias("country"), F.col("p_type").alias("region"), level.alias("budget_level"))
    rate = lambda x: F.least(F.lit(5), F.greatest(F.lit(1), F.floor(x.cast("double") * 8).cast("int") + 3))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("item_id"), F.transform(F.slice("embedding", 1, 9), rate).alias("tags"), F.col("embedding"), "label")
    return parts.join(vectors, "item_id")


def fixture_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly temperatures of the fixture's items, from their vectors, through the JSON text a catalog file has."""
    v = F.col("embedding").cast("array<double>")
    month = lambda m: F.struct(m.cast("string").alias("key"), F.struct(F.round(15 + 80 * F.element_at(v, m), 1).alias("avg")).alias("value"))
    text = F.to_json(F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(12)), month)))
    return fixture_catalog(spark, sf_dir).select("item_id", text.alias("avg_temp_monthly")).withColumn("avg_temp_monthly", climate("avg_temp_monthly"))


def fixture_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("c_custkey")
    first = (u % 6).cast("int")
    return table(spark, sf_dir, "customer").select(u.alias("user_id"), first.alias("p1"), ((first + 1 + u % 5) % 6).cast("int").alias("p2"), (0.5 + (u % 51) / 100.0).alias("mix_weight"))


def persona_table(spark: SparkSession) -> DataFrame:
    """Six rows: p, persona, budgets, weights (1 on emphasised tags, -0.2 elsewhere, length one)."""
    from tributary.functions.vectors import normalized

    rows = [(i, n, b, [1.0 if t in e else -0.2 for t in TAGS]) for i, (n, b, e) in enumerate(PERSONAS)]
    return spark.createDataFrame(rows, "p int, persona string, budgets array<string>, weights array<double>").withColumn("weights", normalized("weights"))
