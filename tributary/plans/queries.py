"""The query registry: every operator on the fixture tables, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.hashing import hash_key
from tributary.functions.vectors import blended, centered, dot, norm, uncentered
from tributary.operators import metrics, recommend, split
from tributary.operators.blocks import best_items
from tributary.sources import tables as T
from tributary.sources.durable import Durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_INTER = """e0 AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pts FROM events),
e1 AS (SELECT *, CASE WHEN pts IS NULL OR ts > pts + INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM e0),
inter AS (SELECT event_id AS interaction_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS item_id,
  CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'itinerary_add' ELSE 'not_interested' END AS event_type,
  ts, CASE WHEN event_type = 'click' THEN value END AS dwell, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS session_no FROM e1)"""
_CAT = """cat AS (SELECT CAST(p_partkey AS INT) AS item_id, p_name AS city, p_brand AS country, p_type AS region,
  CASE WHEN p_partkey % 10 < 3 THEN 'Budget' WHEN p_partkey % 10 < 9 THEN 'Mid-range' ELSE 'Luxury' END AS budget_level,
  list_transform(embedding[1:9], lambda x: least(5, greatest(1, CAST(floor(x::DOUBLE * 8) AS INT) + 3))) AS tags, embedding::DOUBLE[] AS v, label
  FROM part JOIN embeddings ON vec_id = p_partkey)"""
_USERS = """users AS (SELECT c_custkey AS user_id, CAST(c_custkey % 6 AS INT) AS p1, CAST((c_custkey % 6 + 1 + c_custkey % 5) % 6 AS INT) AS p2, 0.5 + (c_custkey % 51) / 100.0::DOUBLE AS mix_weight FROM customer)"""
_PERS = "p0 AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', {b!r}, {[1.0 if t in e else -0.2 for t in T.TAGS]}::DOUBLE[])" for i, (n, b, e) in enumerate(T.PERSONAS)
) + ") AS t(p, persona, budgets, raw)), pers AS (SELECT p, persona, budgets, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS weights FROM p0)"
_SPLIT = _INTER + """, sp0 AS (SELECT *, max(session_no) OVER (PARTITION BY user_id) AS last FROM inter),
sp AS (SELECT *, session_no > last - greatest(1, CAST(round_even(last * 0.2, 0) AS INT)) AS is_test FROM sp0),
gr AS (SELECT *, CASE event_type WHEN 'save' THEN 2 WHEN 'click' THEN 1 END AS grade FROM sp),
rel AS (SELECT user_id, item_id, max(grade) AS grade FROM gr WHERE is_test AND grade IS NOT NULL GROUP BY ALL),
seen AS (SELECT DISTINCT user_id, item_id FROM sp WHERE NOT is_test)"""
_POP = _SPLIT + ", " + _CAT + """, pop AS (SELECT c.item_id, count(s.item_id) AS cnt FROM cat c LEFT JOIN (SELECT item_id FROM sp WHERE NOT is_test AND event_type IN ('click', 'save')) s USING (item_id) GROUP BY 1),
ru AS (SELECT DISTINCT user_id FROM rel),
r_pop AS (SELECT * FROM (SELECT u.user_id, p.item_id, p.cnt, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY cnt DESC, p.item_id) AS INT) AS rank FROM ru u CROSS JOIN pop p ANTI JOIN seen s ON s.user_id = u.user_id AND s.item_id = p.item_id) WHERE rank <= 20)"""
_RAND = """ring AS (SELECT item_id, row_number() OVER (ORDER BY md5(concat_ws(':', item_id, 42)), item_id) - 1 AS place, count(*) OVER () AS n FROM cat),
r_rand AS (SELECT * FROM (SELECT u.user_id, p.item_id, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY (place - start % n + n) % n) AS INT) AS rank FROM (SELECT user_id, ('0x' || substr(md5(concat_ws(':', user_id, 42)), 1, 8))::BIGINT AS start FROM ru) u CROSS JOIN ring p ANTI JOIN seen s ON s.user_id = u.user_id AND s.item_id = p.item_id) WHERE rank <= 20)"""
_TASTE = """taste AS (SELECT user_id, a.budgets, list_transform(list_zip(a.weights, b.weights), lambda x: mix_weight * x[1] + (1.0 - mix_weight) * x[2]) AS w FROM users JOIN pers a ON a.p = p1 JOIN pers b ON b.p = p2),
osc AS (SELECT user_id, item_id, round(list_dot_product(list_transform(tags, lambda x: (x - 3.0)::DOUBLE / 2.0), w) + CASE WHEN list_contains(budgets, budget_level) THEN 1.5 ELSE 0.0 END, 6) + 0.0 AS score FROM taste CROSS JOIN cat)"""
_ORAC = """r_orac AS (SELECT * FROM (SELECT o.user_id, o.item_id, score, CAST(row_number() OVER (PARTITION BY o.user_id ORDER BY score DESC, o.item_id) AS INT) AS rank FROM osc o SEMI JOIN ru USING (user_id) ANTI JOIN seen s ON s.user_id = o.user_id AND s.item_id = o.item_id) WHERE rank <= 20)"""
_FULL = ", ".join([_POP, _RAND, _USERS, _PERS, _TASTE, _ORAC])


def _metrics_sql(recs: str, ks: str = "(5), (10), (20)") -> str:
    return f"""ks AS (SELECT * FROM (VALUES {ks}) t(k)),
idl AS (SELECT user_id, k, count(*) AS n, sum(CASE WHEN place <= k THEN grade / log2(place + 1.0) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY grade DESC, item_id) AS place FROM rel) CROSS JOIN ks GROUP BY ALL),
hit AS (SELECT model, r.user_id, k, count(*) AS h, sum(grade / log2(rank + 1.0)) AS dcg FROM {recs} r JOIN rel USING (user_id, item_id) CROSS JOIN ks WHERE rank <= k GROUP BY ALL),
ms AS (SELECT DISTINCT model FROM {recs}),
pu AS (SELECT m.model, i.user_id, i.k, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, coalesce(h, 0) / n::DOUBLE AS recall, coalesce(dcg, 0) / nullif(idcg, 0) AS ndcg FROM idl i CROSS JOIN ms m LEFT JOIN hit h ON h.model = m.model AND h.user_id = i.user_id AND h.k = i.k)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Fixture:
    """The tables every query starts from."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self.inter = T.fixture_interactions(spark, sf)
        self._kept: dict[str, DataFrame] = {}

    @property
    def catalog(self) -> DataFrame:
        return T.fixture_catalog(self.spark, self.sf)

    @property
    def users(self) -> DataFrame:
        return T.fixture_users(self.spark, self.sf)

    @property
    def personas(self) -> DataFrame:
        return T.persona_table(self.spark)

    @property
    def split(self) -> DataFrame:
        return self._kept["split"] if self._kept else split.with_split(self.inter)

    @property
    def train(self) -> DataFrame:
        return self.split.where("NOT is_test")

    @property
    def rel(self) -> DataFrame:
        return self._kept["rel"] if self._kept else split.relevance(self.split.where("is_test"))

    @property
    def seen(self) -> DataFrame:
        return self._kept["seen"] if self._kept else split.seen(self.train)

    def once(self) -> Fixture:
        """The same with split, relevance and seen items written, for plans that ask for them often: events are read once."""
        held = Durable(self.spark)
        whole = held.keep(self.split)
        self._kept = {"split": whole, "rel": held.keep(split.relevance(whole.where("is_test"))), "seen": held.keep(split.seen(whole.where("NOT is_test")))}
        return self

    @property
    def judged(self) -> DataFrame:
        return self.rel.select("user_id").distinct()

    def popular(self, k: int = 20) -> DataFrame:
        return recommend.Popular(split.popularity(self.train, self.catalog), self.seen).recommend(self.judged, k)

    def random(self, k: int = 20) -> DataFrame:
        return recommend.Random(self.catalog, self.seen).recommend(self.judged, k)

    def oracle(self, k: int = 20) -> DataFrame:
        return recommend.Persona(self.users, self.personas, self.catalog, self.seen).recommend(self.judged, k)


@query(f"WITH {_CAT} SELECT item_id, city, country, region, budget_level, tags FROM cat")
def scan_catalog(spark, sf):
    return Fixture(spark, sf).catalog.select("item_id", "city", "country", "region", "budget_level", "tags")


@query(f"WITH {_INTER} SELECT * FROM inter")
def scan_interactions(spark, sf):
    return Fixture(spark, sf).inter


@query(f"WITH {_USERS} SELECT * FROM users")
def scan_users(spark, sf):
    return Fixture(spark, sf).users


@query(f"WITH {_CAT} SELECT concat_ws('|', item_id, city || ', ' || country, budget_level, array_to_string(tags, ' ')) AS line FROM cat")
def catalog_lines(spark, sf):
    tags = F.array_join(F.col("tags").cast("array<string>"), " ")
    return Fixture(spark, sf).catalog.select(F.concat_ws("|", "item_id", F.concat_ws(", ", "city", "country"), "budget_level", tags).alias("line"))


@query(f"WITH {_CAT} SELECT item_id, i::INT AS place, (tags[i] - 3.0)::DOUBLE / 2.0 AS centred, tags[i]::DOUBLE AS back FROM cat, unnest(range(1, 10)) r(i)")
def tag_center(spark, sf):
    both = Fixture(spark, sf).catalog.select("item_id", F.posexplode(F.arrays_zip(centered("tags").alias("c"), uncentered(centered("tags")).alias("b"))).alias("place", "z"))
    return both.select("item_id", (F.col("place") + 1).alias("place"), F.col("z.c").alias("centred"), F.col("z.b").alias("back"))


@query(f"WITH {_PERS} SELECT p::INT AS p, persona, i::INT AS place, round(weights[i], 6) AS weight FROM pers, unnest(range(1, 10)) r(i)")
def persona_vectors(spark, sf):
    return T.persona_table(spark).select("p", "persona", F.posexplode("weights").alias("place", "w")).select("p", "persona", (F.col("place") + 1).alias("place"), F.round("w", 6).alias("weight"))


@query(f"WITH {_USERS}, {_PERS}, {_CAT}, {_TASTE} SELECT user_id, i::INT AS place, round(w[i], 6) AS weight FROM taste, unnest(range(1, 10)) r(i)")
def user_blend(spark, sf):
    f = Fixture(spark, sf)
    p = f.personas
    both = f.users.join(F.broadcast(p.select(F.col("p").alias("p1"), F.col("weights").alias("a"))), "p1").join(F.broadcast(p.select(F.col("p").alias("p2"), F.col("weights").alias("b"))), "p2")
    return both.select("user_id", F.posexplode(blended("a", "b", "mix_weight")).alias("place", "w")).select("user_id", (F.col("place") + 1).alias("place"), F.round("w", 6).alias("weight"))


@query(f"WITH {_CAT} SELECT item_id, budget_level FROM cat WHERE budget_level = 'Budget'")
def filter_budget(spark, sf):
    return Fixture(spark, sf).catalog.where("budget_level = 'Budget'").select("item_id", "budget_level")


@query(f"WITH {_CAT} SELECT item_id, tags[3] AS nature FROM cat WHERE tags[3] >= 4")
def filter_tag_min(spark, sf):
    at = F.element_at(F.map_from_arrays(F.array(*[F.lit(t) for t in T.TAGS]), "tags"), F.lit("nature"))
    return Fixture(spark, sf).catalog.where(at >= 4).select("item_id", at.alias("nature"))


_SESS = """sess AS (SELECT user_id, session_no, CASE (user_id + session_no) % 4 WHEN 0 THEN 'Luxury' WHEN 1 THEN 'Budget' END AS f_budget, CASE (user_id + session_no) % 3 WHEN 0 THEN (1 + session_no % 9)::INT END AS f_tag FROM (SELECT DISTINCT user_id, session_no FROM inter))"""
_MASK = f"""WITH {_INTER}, {_CAT}, {_SESS}, m AS (SELECT user_id, session_no, item_id, (f_budget IS NULL OR budget_level = f_budget) AND (f_tag IS NULL OR tags[f_tag] >= 4) AS pass FROM sess CROSS JOIN cat)"""


def _sessions(f: Fixture) -> DataFrame:
    key = F.col("user_id") + F.col("session_no")
    return f.inter.select("user_id", "session_no").distinct().select("user_id", "session_no", F.when(key % 4 == 0, "Luxury").when(key % 4 == 1, "Budget").alias("f_budget"), F.when(key % 3 == 0, (1 + F.col("session_no") % 9).cast("int")).alias("f_tag"))


def _masked(f: Fixture) -> DataFrame:
    """Sessions with n_items and n_pass: how many items there are and how many their filters let through.

    Sessions of the same filters get the same counts, so the catalog is met once by each pair of filters, of which there are
    at most levels times tags, blanks included.
    """
    asked = _sessions(f)
    kinds = F.broadcast(asked.select("f_budget", "f_tag").distinct())
    ok = (F.col("f_budget").isNull() | (F.col("budget_level") == F.col("f_budget"))) & (F.col("f_tag").isNull() | (F.try_element_at("tags", F.coalesce("f_tag", F.lit(1))) >= 4))
    counts = kinds.join(f.catalog.select("budget_level", "tags"), how="cross").groupBy("f_budget", "f_tag").agg(F.count("*").alias("n_items"), F.count_if(ok).alias("n_pass"))
    same = asked["f_budget"].eqNullSafe(counts["f_budget"]) & asked["f_tag"].eqNullSafe(counts["f_tag"])
    return asked.join(counts, same).select("user_id", "session_no", "n_items", "n_pass")


@query(_MASK + " SELECT user_id, session_no, count(*) FILTER (WHERE pass) AS n_pass FROM m GROUP BY ALL")
def filter_session_mask(spark, sf):
    return _masked(Fixture(spark, sf)).select("user_id", "session_no", "n_pass")


@query(_MASK + ", q AS (SELECT *, count(*) FILTER (WHERE pass) OVER (PARTITION BY user_id, session_no) AS n_pass FROM m) SELECT user_id, session_no, count(*) AS eligible FROM q WHERE pass OR n_pass < 10 GROUP BY ALL")
def filter_fallback(spark, sf):
    return _masked(Fixture(spark, sf)).select("user_id", "session_no", F.when(F.col("n_pass") < 10, F.col("n_items")).otherwise(F.col("n_pass")).alias("eligible"))


@query(f"WITH {_INTER}, {_SESS} SELECT count(*) FILTER (WHERE f_budget IS NOT NULL OR f_tag IS NOT NULL) AS filtered, count(*) AS sessions FROM sess")
def sessions_with_filter(spark, sf):
    return _sessions(Fixture(spark, sf)).agg(F.count_if(F.col("f_budget").isNotNull() | F.col("f_tag").isNotNull()).alias("filtered"), F.count("*").alias("sessions"))


@query(f"WITH {_INTER} SELECT interaction_id, user_id, item_id FROM inter WHERE event_type IN ('click', 'save')")
def filter_positive_events(spark, sf):
    return Fixture(spark, sf).inter.where(F.col("event_type").isin("click", "save")).select("interaction_id", "user_id", "item_id")


@query(f"WITH {_SPLIT} SELECT event_type, grade::INT AS grade, count(*) AS n FROM gr GROUP BY ALL")
def grade_map(spark, sf):
    return split.graded(Fixture(spark, sf).inter).groupBy("event_type", "grade").agg(F.count("*").alias("n"))


@query(f"WITH {_SPLIT} SELECT user_id, item_id, max(grade)::INT AS grade FROM gr WHERE grade IS NOT NULL GROUP BY ALL")
def user_item_grade(spark, sf):
    return split.relevance(Fixture(spark, sf).inter)


@query(f"WITH {_SPLIT} SELECT * FROM seen")
def seen_pairs(spark, sf):
    return Fixture(spark, sf).seen


@query(f"WITH {_CAT}, n AS (SELECT * FROM (VALUES ('RING'), ('small'), ('hot gear'), ('no such place')) t(needle)) SELECT needle, count(item_id) AS matches, CASE WHEN count(item_id) = 1 THEN min(item_id) END AS item_id FROM n LEFT JOIN cat ON contains(lower(city), lower(needle)) GROUP BY 1")
def find_city(spark, sf):
    needles = spark.createDataFrame([(x,) for x in ("RING", "small", "hot gear", "no such place")], "needle string")
    return recommend.find(Fixture(spark, sf).catalog, needles)


@query(f"WITH {_INTER} SELECT event_type, count(*) AS n FROM inter GROUP BY 1")
def funnel_counts(spark, sf):
    return Fixture(spark, sf).inter.groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_INTER}, c AS (SELECT count(*) FILTER (WHERE event_type = 'impression') AS i, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'save') AS s, count(*) FILTER (WHERE event_type = 'itinerary_add') AS t, count(*) FILTER (WHERE event_type = 'not_interested') AS x FROM inter)
SELECT round(c / nullif(i, 0)::DOUBLE, 6) AS ctr, round(s / nullif(c, 0)::DOUBLE, 6) AS save_rate, round(t / nullif(s, 0)::DOUBLE, 6) AS add_rate, round(x / nullif(i, 0)::DOUBLE, 6) AS reject_rate FROM c""")
def funnel_rates(spark, sf):
    n = lambda e: F.count_if(F.col("event_type") == e)
    ratio = lambda a, b, name: F.round(F.try_divide(n(a), n(b)), 6).alias(name)
    return Fixture(spark, sf).inter.agg(ratio("click", "impression", "ctr"), ratio("save", "click", "save_rate"), ratio("itinerary_add", "save", "add_rate"), ratio("not_interested", "impression", "reject_rate"))


@query(f"WITH {_INTER} SELECT round(avg(dwell), 4) AS mean_dwell, count(dwell) AS clicks FROM inter")
def dwell_mean(spark, sf):
    return Fixture(spark, sf).inter.agg(F.round(F.avg("dwell"), 4).alias("mean_dwell"), F.count("dwell").alias("clicks"))


@query(f"WITH {_POP} SELECT item_id, cnt FROM pop")
def popularity_counts(spark, sf):
    f = Fixture(spark, sf)
    return split.popularity(f.train, f.catalog)


@query(f"WITH {_SPLIT} SELECT interaction_id, is_test FROM sp")
def train_test_split(spark, sf):
    return Fixture(spark, sf).split.select("interaction_id", "is_test")


@query(f"WITH {_SPLIT} SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE is_test AND grade IS NOT NULL) AS test_users, count(*) FILTER (WHERE is_test) AS test_rows, count(*) AS rows FROM gr")
def split_sizes(spark, sf):
    positive = F.col("is_test") & F.col("grade").isNotNull()
    return split.graded(Fixture(spark, sf).split).agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(positive, F.col("user_id"))).alias("test_users"), F.count_if("is_test").alias("test_rows"), F.count("*").alias("rows"))


@query(f"WITH {_SPLIT} SELECT user_id, item_id, grade::INT AS grade, s.item_id IS NOT NULL AS was_seen FROM rel LEFT JOIN (SELECT user_id, item_id FROM seen) s USING (user_id, item_id)".replace("s.item_id IS NOT NULL", "(user_id, item_id) IN (SELECT (user_id, item_id) FROM seen)").replace(" LEFT JOIN (SELECT user_id, item_id FROM seen) s USING (user_id, item_id)", ""))
def relevance(spark, sf):
    f = Fixture(spark, sf)
    return f.rel.join(f.seen.withColumn("s", F.lit(True)), ["user_id", "item_id"], "left").select("user_id", "item_id", "grade", F.coalesce("s", F.lit(False)).alias("was_seen"))


_HIST = f"""WITH {_SPLIT}, h AS (SELECT user_id, item_id, event_type, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, event_type DESC) AS INT) AS rn FROM sp WHERE NOT is_test AND event_type IN ('click', 'save'))"""


@query(_HIST + " SELECT user_id, rn, item_id, event_type FROM h WHERE rn <= 40")
def user_history_40(spark, sf):
    return split.history(Fixture(spark, sf).train).select("user_id", "rn", "item_id", "event_type")


@query(_HIST + f", {_CAT}, {_USERS} SELECT u.user_id, coalesce(string_agg(event_type || ' ' || city, chr(10) ORDER BY rn DESC) FILTER (WHERE city IS NOT NULL), 'no history') AS prompt FROM users u LEFT JOIN (SELECT * FROM h JOIN cat USING (item_id) WHERE rn <= 40) x ON x.user_id = u.user_id GROUP BY 1")
def history_prompt(spark, sf):
    f = Fixture(spark, sf)
    lines = split.history(f.train).join(f.catalog.select("item_id", "city"), "item_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("o"), F.concat_ws(" ", "event_type", "city").alias("line")))).alias("l"))
    return f.users.select("user_id").join(lines, "user_id", "left").select("user_id", F.coalesce(F.array_join(F.col("l.line"), "\n"), F.lit("no history")).alias("prompt"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings CROSS JOIN q ORDER BY score DESC, vec_id LIMIT 10")
def topk_similarity(spark, sf):
    e = T.table(spark, sf, "embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(dot("embedding", "q"), 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(10)


_BATCH = "WITH b AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM b)"


def _batch(spark, sf, k: int) -> DataFrame:
    """Each query's k best by inner product, in blocks; pairs without a score, one vector being null, come last by id."""
    e = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    whole = e.where("x IS NOT NULL").withColumnRenamed("vec_id", "item_id")
    found = best_items(whole.where("item_id % 20 = 0").select(F.col("item_id").alias("user_id"), F.col("x").alias("q")), whole, k)
    found = found.select(F.col("user_id").alias("query_id"), F.col("item_id").alias("vec_id"), "score")
    none = e.where("x IS NULL").select("vec_id")
    if not none.isEmpty():
        first = lambda rows: rows.select("vec_id").orderBy("vec_id").limit(k)
        asked = lambda rows: rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
        blank = asked(e.where("x IS NOT NULL")).crossJoin(first(none)).union(asked(none).crossJoin(first(e)))
        found = found.unionByName(blank.withColumn("score", F.lit(None).cast("double")))
    return recommend.top_k(found, k, F.col("score").desc(), F.col("vec_id"), by="query_id")


@query(_BATCH + " SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5")
def batch_similarity(spark, sf):
    return _batch(spark, sf, 5).select("query_id", "rank", "vec_id", "score")


@query(_BATCH + " SELECT query_id // 2 AS pair, count(*) AS overlap FROM (SELECT query_id // 40 AS query_id2, query_id, vec_id FROM r WHERE rank <= 50) GROUP BY 1, vec_id HAVING count(*) = 2".replace("query_id // 2 AS pair, count(*) AS overlap", "query_id2 AS pair, vec_id").replace("GROUP BY 1, vec_id", "GROUP BY query_id2, vec_id"))
def paraphrase_overlap(spark, sf):
    rows = _batch(spark, sf, 50).withColumn("pair", F.floor(F.col("query_id") / 40))
    return rows.groupBy("pair", "vec_id").agg(F.count_distinct("query_id").alias("n")).where("n = 2").select("pair", "vec_id")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_similarity(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("u"))
    return e.join(other, F.col("b") == F.col("vec_id") + 1).select(F.col("vec_id").alias("a"), "b", F.round(dot("embedding", "u"), 6).alias("similarity"))


@query("SELECT vec_id, len(embedding)::INT AS dims, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_min(embedding)::DOUBLE, 6) AS lo, round(list_max(embedding)::DOUBLE, 6) AS hi, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(list_stddev_pop(embedding::DOUBLE[]), 6) AS std FROM embeddings")
def vector_stats(spark, sf):
    v = F.col("embedding").cast("array<double>")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v)
    return T.table(spark, sf, "embeddings").select("vec_id", F.size(v).alias("dims"), F.round(norm("embedding"), 6).alias("norm"), F.round(F.array_min(v), 6).alias("lo"), F.round(F.array_max(v), 6).alias("hi"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(var), 6).alias("std"))


@query("""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS top FROM embeddings), c AS (SELECT vec_id, i, v[i] AS x, trunc(255 * (1 - abs(v[i]) / top))::INT AS pale FROM m, unnest(range(1, 65)) r(i))
SELECT vec_id, ((i - 1) // 32)::INT AS row, ((i - 1) % 32)::INT AS col, CASE WHEN x >= 0 THEN 255 ELSE pale END::INT AS red, pale AS green, CASE WHEN x >= 0 THEN pale ELSE 255 END::INT AS blue FROM c""")
def vector_heatmap(spark, sf):
    """Rows of 32 coloured cells: red for positive, blue for negative, white near zero (a zero vector is white)."""
    v = F.col("embedding").cast("array<double>")
    rows = T.table(spark, sf, "embeddings").select("vec_id", F.array_max(F.transform(v, F.abs)).alias("top"), F.posexplode(v).alias("i", "x"))
    pale = (255 * (1 - F.coalesce(F.try_divide(F.abs("x"), "top"), F.lit(0.0)))).cast("int")
    up = F.col("x") >= 0
    return rows.select("vec_id", F.floor(F.col("i") / 32).cast("int").alias("row"), (F.col("i") % 32).alias("col"), F.when(up, 255).otherwise(pale).alias("red"), pale.alias("green"), F.when(up, pale).otherwise(255).alias("blue"))


_SHUFFLED = """r_rand AS (SELECT * FROM (SELECT u.user_id, p.item_id, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY md5(concat_ws(':', u.user_id, p.item_id, 42)), p.item_id) AS INT) AS rank FROM ru u CROSS JOIN cat p ANTI JOIN seen s ON s.user_id = u.user_id AND s.item_id = p.item_id) WHERE rank <= 20)"""


@query(f"WITH {_POP}, {_SHUFFLED} SELECT user_id, rank, item_id FROM r_rand")
def rec_random(spark, sf):
    """Unseen items in an order of each user's own: the whole catalog is shuffled for every user."""
    f = Fixture(spark, sf).once()
    return recommend.shuffled(f.judged, f.seen, f.catalog, 20, "user_id", seed=42).select("user_id", "rank", F.col("pick").alias("item_id"))


@query(f"WITH {_POP} SELECT user_id, rank, item_id, cnt FROM r_pop")
def rec_popularity(spark, sf):
    return Fixture(spark, sf).popular()


@query(f"WITH {_FULL} SELECT user_id, rank, item_id, score FROM r_orac")
def rec_oracle(spark, sf):
    return Fixture(spark, sf).oracle()


@query(f"""WITH {_POP}, picks AS (SELECT user_id, i::INT AS place, CAST((user_id * 7 + i * i * 13) % 110 - 5 AS INT) AS item_id FROM ru, unnest(range(0, 30)) r(i)),
o AS (SELECT user_id, item_id, min(place) AS place FROM picks SEMI JOIN cat USING (item_id) ANTI JOIN seen USING (user_id, item_id) GROUP BY ALL)
SELECT user_id, CAST(rank AS INT) AS rank, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place, item_id) AS rank FROM o) WHERE rank <= 10""")
def rec_index_validated(spark, sf):
    f = Fixture(spark, sf)
    picks = f.judged.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("place")).withColumn("item_pos", ((F.col("user_id") * 7 + F.col("place") * F.col("place") * 13) % 110 - 5).cast("int"))
    return recommend.validated(picks, f.catalog, f.seen, 10)


_ONE = f"WITH {_POP}, recs AS (SELECT 'popularity' AS model, user_id, rank, item_id FROM r_pop), " + _metrics_sql("recs")


@query(_ONE + " SELECT user_id, k, hit_rate::DOUBLE AS hit_rate FROM pu")
def hit_rate(spark, sf):
    f = Fixture(spark, sf)
    return metrics.per_user(f.popular(), f.rel, [5, 10, 20]).select("user_id", "k", "hit_rate")


@query(_ONE + " SELECT user_id, k, round(recall, 6) AS recall FROM pu")
def recall(spark, sf):
    f = Fixture(spark, sf)
    return metrics.per_user(f.popular(), f.rel, [5, 10, 20]).select("user_id", "k", F.round("recall", 6).alias("recall"))


@query(_ONE + " SELECT user_id, k, round(ndcg, 6) AS ndcg FROM pu")
def dcg_ndcg(spark, sf):
    f = Fixture(spark, sf)
    return metrics.per_user(f.popular(), f.rel, [5, 10, 20]).select("user_id", "k", F.round("ndcg", 6).alias("ndcg"))


_REPORT = f"WITH {_FULL}, recs AS (SELECT 'random' AS model, user_id, rank, item_id FROM r_rand UNION ALL SELECT 'popularity', user_id, rank, item_id FROM r_pop UNION ALL SELECT 'oracle_persona', user_id, rank, item_id FROM r_orac), "
_MEANS = " SELECT model, k, count(*) AS users, round(avg(hit_rate), 6) AS hit_rate, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM pu GROUP BY ALL"


@query(_REPORT + _metrics_sql("recs") + _MEANS)
def eval_report(spark, sf):
    f = Fixture(spark, sf).once()
    return metrics.evaluate({"random": f.random(), "popularity": f.popular(), "oracle_persona": f.oracle()}, f.rel, [5, 10, 20])


@query(_REPORT.replace("ru AS (SELECT DISTINCT user_id FROM rel)", "ru AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM rel) ORDER BY md5(concat_ws(':', user_id, 7)) LIMIT 50)").replace("seen AS (SELECT", "seen AS (SELECT") + "rel2 AS (SELECT * FROM rel SEMI JOIN ru USING (user_id)), " + _metrics_sql("recs").replace("FROM rel)", "FROM rel2)").replace("JOIN rel USING", "JOIN rel2 USING") + _MEANS)
def eval_sampled(spark, sf):
    f = Fixture(spark, sf).once()
    chosen = f.judged.orderBy(hash_key("user_id", F.lit(7))).limit(50)  # sampling is the feature
    rel = f.rel.join(chosen, "user_id", "left_semi")
    keep = lambda recs: recs.join(chosen, "user_id", "left_semi")
    return metrics.evaluate({"random": keep(f.random()), "popularity": keep(f.popular()), "oracle_persona": keep(f.oracle())}, rel, [5, 10, 20])


@query(f"WITH {_SPLIT}, {_CAT}, i AS (SELECT item_id, count(*) FILTER (WHERE NOT is_test AND event_type = 'impression') AS shown, count(*) FILTER (WHERE is_test AND grade IS NOT NULL) AS liked FROM gr GROUP BY 1) SELECT round(corr(coalesce(shown, 0), coalesce(liked, 0)), 6) AS correlation FROM cat LEFT JOIN i USING (item_id)")
def exposure_corr(spark, sf):
    f = Fixture(spark, sf)
    n = split.graded(f.split).groupBy("item_id").agg(F.count_if(~F.col("is_test") & (F.col("event_type") == "impression")).alias("shown"), F.count_if(F.col("is_test") & F.col("grade").isNotNull()).alias("liked"))
    return f.catalog.select("item_id").join(n, "item_id", "left").agg(F.round(F.corr(F.coalesce("shown", F.lit(0)).cast("double"), F.coalesce("liked", F.lit(0)).cast("double")), 6).alias("correlation"))


@query(f"WITH {_SPLIT}, {_USERS} SELECT (SELECT count(DISTINCT user_id) FROM rel) AS eligible, (SELECT count(*) FROM users) AS users")
def eligible_users(spark, sf):
    f = Fixture(spark, sf)
    return f.users.join(f.judged.withColumn("e", F.lit(1)), "user_id", "left").agg(F.count("e").alias("eligible"), F.count("*").alias("users"))


@query("SELECT role, sum(length(text)) AS billed, sum(CASE WHEN turn > 0 THEN length(text) ELSE 0 END) AS cached, round(sum(CASE WHEN turn > 0 THEN length(text) ELSE 0 END) / nullif(sum(length(text)), 0)::DOUBLE, 6) AS cached_share FROM conversations GROUP BY role".replace("sum(length(text)) AS billed", "sum(length(text))::BIGINT AS billed").replace("ELSE 0 END) AS cached,", "ELSE 0 END)::BIGINT AS cached,"))
def token_usage(spark, sf):
    n = F.length("text").cast("long")
    cached = F.sum(F.when(F.col("turn") > 0, n).otherwise(0))
    return T.table(spark, sf, "conversations").groupBy("role").agg(F.sum(n).alias("billed"), cached.alias("cached"), F.round(F.try_divide(cached, F.sum(n)), 6).alias("cached_share"))


@query("SELECT conv_id, turn, sha256(concat_ws(chr(0), 'model', role, text)) AS key FROM conversations")
def cache_key(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("\0", F.lit("model"), "role", "text"), 256).alias("key"))
