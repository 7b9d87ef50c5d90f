"""Queries of the model's own files, written and read again, and of requests in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import intent
from tributary.plans.queries import _CAT, _INTER, _PERS, _SESS, _USERS, Fixture, _sessions
from tributary.sources import tables as T
from tributary.sources.durable import Durable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _path(spark, name: str) -> str:
    return f"{Durable(spark).root}/{name}"


@query(f"""WITH {_CAT} SELECT item_id::VARCHAR AS id, city, country, region, 'The "' || city || '", of' || chr(10) || country AS short_description, round(v[11], 4) AS latitude, round(v[10], 4) AS longitude,
round(15 + 80 * v[7], 1) AS july, ['short', 'long'][1:1 + (item_id % 2)::INT] AS ideal_durations, budget_level, tags FROM cat""")
def catalog_file(spark, sf):
    """The catalog through its CSV file, with quotes, commas and line ends in a text and JSON in two columns."""
    f = Fixture(spark, sf)
    v = F.col("embedding").cast("array<double>")
    rates = [F.col("tags")[i].alias(t) for i, t in enumerate(T.TAGS)]
    rows = f.catalog.join(T.fixture_climate(spark, sf), "item_id").select(
        F.col("item_id").cast("string").alias("id"), "city", "country", "region", F.concat(F.lit('The "'), "city", F.lit('", of\n'), "country").alias("short_description"),
        F.round(v[10], 4).alias("latitude"), F.round(v[9], 4).alias("longitude"), F.to_json("avg_temp_monthly").alias("avg_temp_monthly"),
        F.to_json(F.slice(F.array(F.lit("short"), F.lit("long")), F.lit(1), 1 + F.col("item_id") % 2)).alias("ideal_durations"), "budget_level", *rates,
    )
    path = _path(spark, "catalog")
    T.write_csv(rows, path, rows.columns)
    back = T.read_catalog(spark, path)
    return back.select("id", "city", "country", "region", "short_description", "latitude", "longitude", F.col("avg_temp_monthly")["7"]["avg"].alias("july"), "ideal_durations", "budget_level", "tags")


@query(f"WITH {_USERS}, {_PERS} SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') AS user_id, a.persona AS primary_persona, b.persona AS secondary_persona, mix_weight FROM users JOIN pers a ON a.p = p1 JOIN pers b ON b.p = p2")
def users_file(spark, sf):
    f = Fixture(spark, sf)
    names = f.personas.select("p", "persona")
    rows = f.users.join(F.broadcast(names.toDF("p1", "primary_persona")), "p1").join(F.broadcast(names.toDF("p2", "secondary_persona")), "p2")
    path = _path(spark, "users")
    T.write_csv(rows.withColumn("user_id", F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"))), path, ["user_id", "primary_persona", "secondary_persona", "mix_weight"])
    return T.read_users(spark, path)


@query(f"WITH {_INTER} SELECT interaction_id, user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id, event_type, 's' || user_id || '_' || session_no AS session_id, ts AS timestamp, dwell AS dwell_seconds FROM inter")
def interactions_file(spark, sf):
    """Interactions through their CSV file: no dwell time is a blank there and a null again."""
    text = lambda c: F.col(c).cast("string").alias(c)
    session = F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("_"), F.col("session_no").cast("string")).alias("session_id")
    rows = Fixture(spark, sf).inter.select("interaction_id", text("user_id"), text("item_id"), "event_type", session, F.col("ts").alias("timestamp"), F.col("dwell").alias("dwell_seconds"))
    path = _path(spark, "interactions")
    T.write_csv(rows, path, rows.columns)
    return T.read_interactions(spark, path)


_SAID = "CASE f_budget WHEN 'Budget' THEN 'A cheap trip' WHEN 'Luxury' THEN 'Something luxurious' ELSE 'A trip' END || CASE WHEN f_tag IS NULL THEN '' ELSE ', lots of ' || ['culture', 'adventure', 'nature', 'beaches', 'nightlife', 'cuisine', 'wellness', 'urban', 'seclusion'][f_tag] END || CASE WHEN (user_id + session_no) % 5 = 0 AND f_tag IS DISTINCT FROM 5 THEN ', no nightlife' ELSE '' END"


def _said(f: Fixture) -> DataFrame:
    """Sessions with what their user could have said for their filters."""
    trip = F.when(F.col("f_budget") == "Budget", "A cheap trip").when(F.col("f_budget") == "Luxury", "Something luxurious").otherwise("A trip")
    tag = F.coalesce(F.concat(F.lit(", lots of "), F.get(F.array(*map(F.lit, T.TAGS)), F.col("f_tag") - 1)), F.lit(""))
    quiet = F.when(((F.col("user_id") + F.col("session_no")) % 5 == 0) & ~F.col("f_tag").eqNullSafe(F.lit(5)), ", no nightlife").otherwise("")
    return _sessions(f).withColumn("query_text", F.concat(trip, tag, quiet))


@query(f"WITH {_INTER}, {_SESS}, st AS (SELECT user_id, session_no, min(ts) AS timestamp FROM inter GROUP BY ALL) SELECT 's' || user_id || '_' || session_no AS session_id, user_id::VARCHAR AS user_id, timestamp, {_SAID} AS query_text, f_budget AS filter_budget_level, ['culture', 'adventure', 'nature', 'beaches', 'nightlife', 'cuisine', 'wellness', 'urban', 'seclusion'][f_tag] AS filter_required_tag FROM sess JOIN st USING (user_id, session_no)")
def sessions_file(spark, sf):
    """Sessions through their CSV file: a filter that isn't set is a blank there and a null again."""
    f = Fixture(spark, sf)
    began = f.inter.groupBy("user_id", "session_no").agg(F.min("ts").alias("timestamp"))
    tag = F.get(F.array(*map(F.lit, T.TAGS)), F.col("f_tag") - 1)
    rows = _said(f).join(began, ["user_id", "session_no"]).select(F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("_"), F.col("session_no").cast("string")).alias("session_id"), F.col("user_id").cast("string").alias("user_id"), "timestamp", "query_text", F.col("f_budget").alias("filter_budget_level"), tag.alias("filter_required_tag"))
    path = _path(spark, "sessions")
    T.write_csv(rows, path, rows.columns)
    return T.read_sessions(spark, path)


@query(f"""WITH {_INTER}, {_CAT}, {_SESS}, s AS (SELECT user_id, session_no, f_budget, f_tag, (user_id + session_no) % 5 = 0 AND f_tag IS DISTINCT FROM 5 AS quiet FROM sess)
SELECT user_id, session_no, count(item_id) AS allowed FROM s LEFT JOIN cat ON (f_budget IS NULL OR budget_level = f_budget) AND (f_tag IS NULL OR tags[f_tag] >= 4) AND (NOT quiet OR tags[5] <= 2) GROUP BY ALL""")
def requests_allowed(spark, sf):
    """How many items the constraints in a session's words allow, by signature of the constraints."""
    f = Fixture(spark, sf)
    asked = _said(f).select("user_id", "session_no", intent.parse(F.col("query_text")).alias("p")).select("user_id", "session_no", "p.budget", "p.tags", "p.avoid")
    sizes = intent.allowed(f.catalog, asked).groupBy("budget", "tags", "avoid").agg(F.count("*").alias("n"))
    same = asked["budget"].eqNullSafe(sizes["budget"]) & (asked["tags"] == sizes["tags"]) & (asked["avoid"] == sizes["avoid"])
    return asked.join(sizes, same, "left").select("user_id", "session_no", F.coalesce("n", F.lit(0).cast("long")).alias("allowed"))


@query(f"WITH {_INTER}, {_SESS}, s AS (SELECT f_budget IS NOT NULL OR f_tag IS NOT NULL OR (user_id + session_no) % 5 = 0 AS says FROM sess) SELECT count(*) AS requests, round(avg(CASE WHEN says THEN 1.0 ELSE 0.0 END), 6) AS valid, 1.0::DOUBLE AS budget, 1.0::DOUBLE AS tags, 1.0::DOUBLE AS avoid FROM s")
def request_fields(spark, sf):
    """How often what was parsed from a session's words is what its filters say, field by field."""
    rows = _said(Fixture(spark, sf)).withColumn("key", F.concat_ws("_", F.col("user_id").cast("string"), F.col("session_no").cast("string")))
    listed = lambda ok, name: F.when(ok, F.array(name)).otherwise(F.array().cast("array<string>"))
    tag = F.get(F.array(*map(F.lit, T.TAGS)), F.col("f_tag") - 1)
    quiet = ((F.col("user_id") + F.col("session_no")) % 5 == 0) & ~F.col("f_tag").eqNullSafe(F.lit(5))
    real = rows.select("key", F.col("f_budget").alias("budget"), listed(F.col("f_tag").isNotNull(), tag).alias("tags"), listed(quiet, F.lit("nightlife")).alias("avoid"))
    parsed = rows.select("key", intent.parse(F.col("query_text")).alias("p")).select("key", "p.budget", "p.tags", "p.avoid")
    return intent.field_match(parsed, real, "key", ["budget", "tags", "avoid"])
