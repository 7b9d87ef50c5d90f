"""Queries of approximate search, places and climate, learned rankers, drafts of two rankers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.hashing import hash_int, uniform
from tributary.functions.vectors import dot
from tributary.operators import ann, graph, places, ranking, recommend, split
from tributary.operators.blocks import best_items
from tributary.plans.designs import _CON, _broken, _tasted
from tributary.plans.queries import _BATCH, _CAT, _FULL, _POP, Fixture, _batch
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


_LSH = _BATCH + f""", b0 AS (SELECT greatest(4, ceil(log2(count(*) / 100.0)))::INT AS bits FROM embeddings), bits AS (SELECT bits, ceil(ln(1 - {ann.SURE}) / ln(1 - pow(1 - acos({ann.NEAR}) / pi(), bits))) AS tables FROM b0),
pl AS (SELECT t, b, list(CASE WHEN ('0x' || substr(md5(concat_ws(':', t, b, i)), 1, 8))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE ORDER BY i) AS p FROM bits, range(1000) x(t), range(16) y(b), range(64) z(i) WHERE b < bits AND t < tables GROUP BY ALL),
ky AS (SELECT vec_id, t, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], p) >= 0 THEN 1 << b::INT ELSE 0 END) AS key FROM embeddings CROSS JOIN pl GROUP BY ALL),
pr AS (SELECT DISTINCT a.vec_id AS query_id, h.vec_id FROM ky a JOIN ky h USING (t, key) WHERE a.vec_id % 20 = 0 AND a.vec_id <> h.vec_id),
fd AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM b SEMI JOIN pr USING (query_id, vec_id))"""


def _vectors(spark, sf) -> DataFrame:
    return T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _lsh(spark, sf) -> DataFrame:
    v = _vectors(spark, sf)
    bits = ann.bits_for(v.count())
    return ann.lsh_search(v, v.where("vec_id % 20 = 0"), 10, bits, 64, ann.tables_for(bits))


@query(_LSH + " SELECT query_id, rank, vec_id, score FROM fd WHERE rank <= 10")
def ann_lsh(spark, sf):
    return _lsh(spark, sf)


@query(_LSH + ", ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM b WHERE query_id <> vec_id) SELECT count(DISTINCT e.query_id) AS queries, count(*) AS wanted, round(count(f.rank) / count(*)::DOUBLE, 6) AS recall FROM ex e LEFT JOIN (SELECT query_id, vec_id, rank FROM fd WHERE rank <= 10) f ON f.query_id = e.query_id AND f.vec_id = e.vec_id WHERE place <= 10")
def ann_recall(spark, sf):
    """The share of the exact ten nearest that the search by signs finds."""
    exact = _batch(spark, sf, 11).where("query_id <> vec_id")
    exact = recommend.top_k(exact.drop("rank"), 10, F.col("score").desc(), F.col("vec_id"), by="query_id")
    return ann.recall(_lsh(spark, sf), exact)


def _ivf(spark, sf) -> DataFrame:
    v = _vectors(spark, sf)
    return ann.ivf_search(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 10)


@query()
def ann_ivf(spark, sf):
    """The ten nearest in the cells nearest to the query."""
    return _ivf(spark, sf)


def _enough(found: DataFrame, spark, sf) -> DataFrame:
    """One row (queries, wanted, enough): whether nine in ten of the exact ten nearest were found."""
    exact = _batch(spark, sf, 11).where("query_id <> vec_id")
    exact = recommend.top_k(exact.drop("rank"), 10, F.col("score").desc(), F.col("vec_id"), by="query_id")
    return ann.recall(found, exact).select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


_ENOUGH = "SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) - 1 FROM embeddings)) AS wanted, true AS enough FROM embeddings WHERE vec_id % 20 = 0"


@query(_ENOUGH)
def ivf_recall(spark, sf):
    return _enough(_ivf(spark, sf), spark, sf)


def _graph_search(spark, sf) -> DataFrame:
    v = _vectors(spark, sf)
    return graph.search(graph.build(v), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 10)


@query()
def ann_hnsw(spark, sf):
    """The ten nearest by layered neighbour graphs."""
    return _graph_search(spark, sf)


@query(_ENOUGH)
def hnsw_recall(spark, sf):
    return _enough(_graph_search(spark, sf), spark, sf)


@query("WITH m AS (SELECT vec_id, copy, i, embedding[i + 1]::DOUBLE AS x, embedding[i + 1]::DOUBLE + 0.1 * ((('0x' || substr(md5(concat_ws(':', vec_id, copy, i, 5)), 1, 8))::BIGINT + 0.5) / 4294967296.0 - 0.5) AS y FROM embeddings, range(1, 11) c(copy), range(64) d(i)) SELECT vec_id, copy::INT AS copy, round(sum(x * y), 5) AS similarity FROM m GROUP BY ALL")
def catalog_replicas(spark, sf):
    v = _vectors(spark, sf)
    return ann.replicas(v, 10).join(v.toDF("vec_id", "q"), "vec_id").select("vec_id", "copy", F.round(dot("v", "q"), 5).alias("similarity"))


_CLIMATE = f"WITH {_CAT}, climate AS (SELECT item_id, i::INT AS month, round(15 + 80 * v[i], 1) AS temp FROM cat, unnest(range(1, 13)) r(i))"


@query(_CLIMATE + " SELECT item_id, temp AS july FROM climate WHERE month = 7 AND temp > 30")
def climate_filter(spark, sf):
    july = F.element_at(F.col("avg_temp_monthly"), "7")["avg"]
    return T.fixture_climate(spark, sf).where(july > 30).select("item_id", july.alias("july"))


@query(_CLIMATE + ", r AS (SELECT item_id, month, round(abs(temp - 24), 1) AS miss, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(abs(temp - 24), 1), month) AS INT) AS rank FROM climate) SELECT * FROM r WHERE rank <= 3")
def when_to_go(spark, sf):
    rows = T.fixture_climate(spark, sf).select("item_id", F.explode("avg_temp_monthly").alias("month", "t"))
    rows = rows.select("item_id", F.col("month").cast("int").alias("month"), F.round(F.abs(F.col("t")["avg"] - 24), 1).alias("miss"))
    return recommend.top_k(rows, 3, F.col("miss"), F.col("month"), by="item_id").select("item_id", "month", "miss", "rank")


#: Areas of the fixture's plane: a square, one with a notch, a triangle that overlaps both.
AREAS = [("square", [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]), ("notch", [(-0.3, -0.3), (0.3, -0.3), (0.0, 0.05), (0.3, 0.3), (-0.3, 0.3)]), ("triangle", [(0.05, -0.2), (0.4, 0.0), (0.05, 0.2)])]
_EDGES = ", ".join(f"('{a}', {p[0]}::DOUBLE, {p[1]}::DOUBLE, {q[0]}::DOUBLE, {q[1]}::DOUBLE)" for a, ring in AREAS for p, q in zip(ring, ring[1:] + ring[:1]))
_PLACES = f"""WITH {_CAT}, ed AS (SELECT * FROM (VALUES {_EDGES}) t(area, x1, y1, x2, y2)), cr AS (SELECT item_id, budget_level, area, count(*) FILTER (WHERE (y1 > v[11]) <> (y2 > v[11]) AND v[10] < (x2 - x1) * (v[11] - y1) / nullif(y2 - y1, 0) + x1) AS n FROM cat CROSS JOIN ed GROUP BY ALL),
ins AS (SELECT item_id, budget_level, area FROM cr WHERE n % 2 = 1)"""


def _inside(f: Fixture) -> tuple[DataFrame, DataFrame]:
    areas = f.spark.createDataFrame(AREAS, "area string, ring array<struct<x: double, y: double>>")
    v = F.col("embedding").cast("array<double>")
    return places.inside(f.catalog.select("item_id", v[9].alias("x"), v[10].alias("y")), areas, 0.2), areas


@query(_PLACES + " SELECT item_id, area FROM ins")
def points_in_areas(spark, sf):
    return _inside(Fixture(spark, sf))[0]


@query(_PLACES + """, sz AS (SELECT area, abs(sum(x1 * y2 - x2 * y1)) / 2.0 AS extent FROM ed GROUP BY 1) SELECT area, count(*) AS places, count(*) FILTER (WHERE budget_level = 'Budget') AS budget, count(*) FILTER (WHERE budget_level = 'Luxury') AS luxury, round(count(*) / any_value(extent), 4) AS density FROM ins JOIN sz USING (area) GROUP BY 1""")
def area_density(spark, sf):
    f = Fixture(spark, sf)
    found, areas = _inside(f)
    level = lambda name: F.count_if(F.col("budget_level") == name)
    rows = found.join(f.catalog.select("item_id", "budget_level"), "item_id").join(places.extent(areas), "area")
    return rows.groupBy("area").agg(F.count("*").alias("places"), level("Budget").alias("budget"), level("Luxury").alias("luxury"), F.round(F.count("*") / F.first("extent"), 4).alias("density"))


@query(f"WITH {_CAT} SELECT item_id, count(*) OVER (PARTITION BY country, budget_level) > 1 AS chain FROM cat")
def chain_or_single(spark, sf):
    """A brand with several items of one level is a chain."""
    return Fixture(spark, sf).catalog.select("item_id", (F.count("*").over(Window.partitionBy("country", "budget_level")) > 1).alias("chain"))


@query(_CON + "h AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM v WHERE broken = 0) SELECT count(*) AS relevant, count(t.rank) AS all_found, count(h.rank) AS allowed_found FROM rel LEFT JOIN (SELECT * FROM top WHERE rank <= 10) t USING (user_id, item_id) LEFT JOIN (SELECT * FROM h WHERE rank <= 10) h USING (user_id, item_id)")
def constraint_loss(spark, sf):
    """Relevant items among the ten best without and with the constraints."""
    f = Fixture(spark, sf)
    items = _broken(f)
    best = lambda which, name: best_items(_tasted(f), which, 10).select("user_id", "item_id", F.col("rank").alias(name))
    at = f.rel.join(best(items, "a"), ["user_id", "item_id"], "left").join(best(items.where("broken = 0"), "b"), ["user_id", "item_id"], "left")
    return at.agg(F.count("*").alias("relevant"), F.count("a").alias("all_found"), F.count("b").alias("allowed_found"))


@query(f"WITH {_POP}, x AS (SELECT user_id, rank, item_id, (('0x' || substr(md5(concat_ws(':', user_id, rank, 11)), 1, 8))::BIGINT + 0.5) / 4294967296.0 < 0.1 AS explores FROM r_pop) SELECT a.user_id, a.rank, CASE WHEN a.explores THEN coalesce(b.item_id, a.item_id) ELSE a.item_id END AS item_id FROM x a LEFT JOIN x b ON b.user_id = a.user_id AND b.rank = a.rank + 10 WHERE a.rank <= 10")
def explore_swap(spark, sf):
    """A tenth of the ten slots shows the unseen item ten places further down."""
    lists = Fixture(spark, sf).popular(20).select("user_id", "rank", "item_id")
    later = lists.select("user_id", (F.col("rank") - 10).alias("rank"), F.col("item_id").alias("later"))
    explores = uniform("user_id", "rank", F.lit(11)) < 0.1
    return lists.where("rank <= 10").join(later, ["user_id", "rank"], "left").select("user_id", "rank", F.when(explores, F.coalesce("later", "item_id")).otherwise(F.col("item_id")).alias("item_id"))


_DRAFT = f"""WITH RECURSIVE {_FULL}, li AS (SELECT user_id, list(item_id ORDER BY rank) FILTER (WHERE side = 'a') AS a, list(item_id ORDER BY rank) FILTER (WHERE side = 'b') AS b FROM (SELECT user_id, item_id, rank, 'a' AS side FROM r_pop WHERE rank <= 10 UNION ALL SELECT user_id, item_id, rank, 'b' FROM r_orac WHERE rank <= 10) GROUP BY 1),
dr AS (SELECT user_id, a, b, 0 AS t, []::INT[] AS items, []::VARCHAR[] AS teams FROM li UNION ALL
SELECT user_id, a, b, t + 1, list_append(items, list_filter(CASE team WHEN 'a' THEN a ELSE b END, lambda x: NOT list_contains(items, x))[1]), list_append(teams, team) FROM (SELECT *, CASE WHEN (t % 2 = 0) = (('0x' || substr(md5(concat_ws(':', user_id, t // 2, 'draft')), 1, 8))::BIGINT % 2 = 0) THEN 'a' ELSE 'b' END AS team FROM dr) WHERE t < 10),
dd AS (SELECT user_id, i::INT AS rank, items[i] AS item_id, teams[i] AS team FROM dr, unnest(range(1, 11)) r(i) WHERE t = 10 AND items[i] IS NOT NULL)"""


@query(_DRAFT + " SELECT * FROM dd")
def team_draft(spark, sf):
    f = Fixture(spark, sf).once()
    return recommend.team_draft(f.popular(10), f.oracle(10), 10)


@query(_DRAFT + " SELECT team, count(*) AS shown, count(grade) AS clicked FROM dd LEFT JOIN rel USING (user_id, item_id) GROUP BY 1")
def draft_clicks(spark, sf):
    """What users liked in the test period goes to the team that put it on the list."""
    f = Fixture(spark, sf).once()
    rows = recommend.team_draft(f.popular(10), f.oracle(10), 10).join(f.rel, ["user_id", "item_id"], "left")
    return rows.groupBy("team").agg(F.count("*").alias("shown"), F.count("grade").alias("clicked"))


_SOURCES = f"""WITH {_FULL}, lk AS (SELECT DISTINCT user_id, item_id FROM sp SEMI JOIN ru USING (user_id) WHERE NOT is_test AND event_type IN ('click', 'save')), xy AS (SELECT item_id, v[10] AS x, v[11] AS y FROM cat),
gd AS (SELECT user_id, b.item_id, min(round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9)) AS distance FROM lk JOIN xy a USING (item_id) JOIN xy b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02 ANTI JOIN seen s ON s.user_id = lk.user_id AND s.item_id = b.item_id GROUP BY ALL),
r_geo AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY distance, item_id) AS INT) AS rank FROM gd) WHERE rank <= 20),
tc AS (SELECT c.item_id, count(s.item_id) FILTER (WHERE s.ts >= TIMESTAMP '2024-01-22') AS late, count(s.item_id) FILTER (WHERE s.ts < TIMESTAMP '2024-01-22') AS early FROM cat c LEFT JOIN (SELECT item_id, ts FROM sp WHERE NOT is_test AND event_type IN ('click', 'save')) s USING (item_id) GROUP BY 1),
tg AS (SELECT item_id, round((late + 1.0) / (early + 1.0), 9) AS growth FROM tc), r_trend AS (SELECT * FROM (SELECT u.user_id, t.item_id, growth, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY growth DESC, t.item_id) AS INT) AS rank FROM ru u CROSS JOIN tg t ANTI JOIN seen s ON s.user_id = u.user_id AND s.item_id = t.item_id) WHERE rank <= 20)"""


def _liked(f: Fixture) -> DataFrame:
    return f.train.where(F.col("event_type").isin("click", "save")).select("user_id", "item_id", "ts")


def _near(f: Fixture) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    points = f.catalog.select("item_id", v[9].alias("x"), v[10].alias("y"))
    liked = Durable(f.spark, tidy=True).keep(_liked(f).select("user_id", "item_id").distinct().join(f.judged, "user_id", "left_semi").repartition("user_id"))
    centres = points.join(liked.select("item_id").distinct(), "item_id", "left_semi")
    return nearest_unseen(liked, places.near(centres, points, 0.02), f.seen, 20)


def nearest_unseen(liked: DataFrame, pairs: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Rows (user_id, rank, item_id, distance): of pairs (a, b, distance) whose a a user liked, the k nearest unseen b.

    Of an item's neighbours a user who has seen n items needs the first n + k: those before are seen or candidates that come
    first. So lists are cut before they meet the likes, and users' rows stay where their likes are.
    """
    sizes = seen.join(liked.select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id").agg(F.count_distinct("item_id").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    # a literal bound, so that lists are cut before they are dealt
    by_place = recommend.top_k(pairs, k + most, F.col("distance"), F.col("b"), by="a")
    lists = by_place.groupBy(F.col("a").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("b").alias("other"), "distance"))).alias("z"))
    at = liked.join(sizes, "user_id", "left").join(lists, "item_id")
    near = at.select("user_id", F.inline(F.slice("z", F.lit(1), F.coalesce("n", F.lit(0)).cast("int") + k)))
    rows = near.groupBy("user_id", F.col("other").alias("item_id")).agg(F.min("distance").alias("distance"))
    return recommend.top_k(recommend.unseen(rows, seen), k, F.col("distance"), F.col("item_id"))


def _trending(f: Fixture) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-22").cast("timestamp_ntz")
    counts = _liked(f).groupBy("item_id").agg(F.count_if(late).alias("late"), F.count_if(~late).alias("early"))
    n = lambda c: F.coalesce(c, F.lit(0)) + 1.0
    growth = f.catalog.select("item_id").join(counts, "item_id", "left").select("item_id", F.round(n("late") / n("early"), 9).alias("growth"))
    return recommend.along(f.judged, recommend.placed(growth, F.col("growth").desc(), F.col("item_id")), f.seen, 20)


@query(_SOURCES + " SELECT user_id, rank, item_id, distance FROM r_geo")
def geo_candidates(spark, sf):
    """Unseen items near what a user liked, the nearest first."""
    return _near(Fixture(spark, sf)).select("user_id", "rank", "item_id", "distance")


@query(_SOURCES + " SELECT user_id, rank, item_id, growth FROM r_trend")
def trending_candidates(spark, sf):
    """Unseen items whose likes grew most in the last days of training."""
    return _trending(Fixture(spark, sf)).select("user_id", "rank", "item_id", "growth")


@query(_SOURCES + " SELECT user_id, item_id, min(rank) AS best, count(*) AS sources FROM (SELECT user_id, item_id, rank FROM r_pop UNION ALL SELECT user_id, item_id, rank FROM r_orac UNION ALL SELECT user_id, item_id, rank FROM r_geo UNION ALL SELECT user_id, item_id, rank FROM r_trend) GROUP BY ALL")
def source_merge(spark, sf):
    """Four sources of candidates in one list a user: the best rank of an item and how many sources have it."""
    f = Fixture(spark, sf).once()
    sources = [r.select("user_id", "item_id", "rank") for r in (f.popular(), f.oracle(), _near(f), _trending(f))]
    return reduce(DataFrame.unionByName, sources).groupBy("user_id", "item_id").agg(F.min("rank").alias("best"), F.count("*").alias("sources"))


FEATURES = ["score", "log_cnt"]


def _candidates(f: Fixture) -> DataFrame:
    """Candidates of both recommenders with features and grades, written once."""
    both = f.popular(20).select("user_id", "item_id").union(f.oracle(20).select("user_id", "item_id")).distinct()
    tasted = both.join(recommend.persona_queries(f.users, f.personas), "user_id").join(recommend.item_vectors(f.catalog), "item_id")
    rows = tasted.select("user_id", "item_id", F.round(dot("q", "x"), 6).alias("score")).join(split.popularity(f.train, f.catalog), "item_id").join(f.rel, ["user_id", "item_id"], "left")
    return Durable(f.spark).keep(rows.select("user_id", "item_id", "score", F.ln(F.col("cnt") + 1.0).alias("log_cnt"), F.coalesce("grade", F.lit(0)).cast("double").alias("grade")))


def _ranked_halves(f: Fixture) -> tuple[DataFrame, DataFrame]:
    """Half of the users' candidates to learn from, the others to rank for."""
    rows = _candidates(f.once())
    learns = hash_int("user_id", F.lit("rank")) % 2 == 0
    return rows.where(learns), rows.where(~learns)


@query()
def ltr_pointwise(spark, sf):
    return ranking.pointwise(*_ranked_halves(Fixture(spark, sf)), FEATURES, "grade", 10)


@query()
def ltr_pairwise(spark, sf):
    return ranking.pairwise(*_ranked_halves(Fixture(spark, sf)), FEATURES, "grade", 10)


@query()
def coarse_trees(spark, sf):
    train, other = _ranked_halves(Fixture(spark, sf))
    liked = (F.col("grade") > 0).cast("double")
    return ranking.coarse_trees(train.withColumn("liked", liked), other, FEATURES, "liked", 20)


@query()
def svd_recs(spark, sf):
    f = Fixture(spark, sf)
    return ranking.svd(split.relevance(f.train), f.judged, f.seen, 10)
