"""Queries of what is learned in rounds: factors from pairs, trees on listwise gradients; and one round of each against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import factors, metrics, ranking
from tributary.operators.blocks import best_items
from tributary.plans.queries import _FULL, _POP, Fixture
from tributary.plans.search import FEATURES, _candidates, _ranked_halves

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _likes(f: Fixture) -> DataFrame:
    return f.train.where(F.col("event_type").isin("click", "save")).select("user_id", "item_id").distinct()


_HASH = "('0x' || substr(md5(concat_ws(':', {})), 1, 8))::BIGINT"
_START = "list_append(list_transform(range(0, 4), lambda d: ((" + _HASH.format("'{kind}', id, d, 1") + " + 0.5) / 4294967296.0 - 0.5) * 0.2), {last})"


@query(f"""WITH {_POP}, lk AS (SELECT DISTINCT user_id, item_id FROM sp SEMI JOIN cat USING (item_id) WHERE NOT is_test AND event_type IN ('click', 'save')), n AS (SELECT count(*) AS n FROM cat),
fu AS (SELECT id AS user_id, {_START.format(kind='u', last='1.0')} AS u FROM (SELECT DISTINCT user_id AS id FROM lk)), fi AS (SELECT id AS item_id, {_START.format(kind='i', last='0.0')} AS a FROM (SELECT item_id AS id FROM cat)),
bk AS (SELECT item_id AS other, {_HASH.format("item_id, 'bucket1'")} % n AS b FROM cat, n), dr AS (SELECT user_id, item_id, {_HASH.format('user_id, item_id, 0, s, 1')} % n AS b FROM lk, n, range(1, 3) r(s)),
t AS (SELECT d.user_id, d.item_id, k.other FROM dr d JOIN bk k USING (b) ANTI JOIN lk ON lk.user_id = d.user_id AND lk.item_id = k.other),
x AS (SELECT t.*, u, list_transform(list_zip(fi.a, fo.a), lambda z: z[1] - z[2]) AS gap FROM t JOIN fu USING (user_id) JOIN fi USING (item_id) JOIN fi fo ON fo.item_id = t.other), y AS (SELECT *, 1.0 / (1.0 + exp(list_dot_product(u, gap))) AS p FROM x),
g AS (SELECT 'u' AS kind, user_id::BIGINT AS id, i, CASE WHEN i = 5 THEN 0.0 ELSE p * gap[i] END AS g FROM y, range(1, 6) r(i) UNION ALL SELECT 'i', item_id, i, p * u[i] FROM y, range(1, 6) r(i) UNION ALL SELECT 'i', other, i, -p * u[i] FROM y, range(1, 6) r(i))
SELECT kind, id, i::INT AS place, count(*) AS n, round(sum(g), 6) + 0.0 AS g FROM g GROUP BY ALL""")
def bpr_gradient(spark, sf):
    """The first round's summed gradients of four factors and the bias."""
    f = Fixture(spark, sf)
    items = f.catalog.select("item_id")
    likes = _likes(f).join(items, "item_id", "left_semi").select("user_id", "item_id")
    drawn = factors.triples(likes, items, items.count(), 0, 2, 1)
    rows = factors.gradients(drawn, factors.start(likes, items, 4, 1), 4)
    return rows.select("kind", "id", "n", F.posexplode("g").alias("i", "g")).select("kind", "id", (F.col("i") + 1).alias("place"), "n", (F.round("g", 6) + 0.0).alias("g"))


@query()
def bpr_recs(spark, sf):
    """The ten best unseen items by factors learned from pairs."""
    f = Fixture(spark, sf).once()
    users, items = factors.bpr(_likes(f), f.catalog)
    return best_items(users.join(f.judged, "user_id", "left_semi"), items, 10, f.seen)


@query(f"""WITH {_FULL}, ca AS (SELECT user_id, item_id FROM r_pop UNION SELECT user_id, item_id FROM r_orac), s AS (SELECT c.user_id, c.item_id, score, coalesce(grade, 0)::DOUBLE AS grade FROM ca c JOIN osc USING (user_id, item_id) LEFT JOIN rel USING (user_id, item_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS spot, row_number() OVER (PARTITION BY user_id ORDER BY grade DESC, item_id) AS best FROM s),
b AS (SELECT *, 1.0 / log2(spot + 1.0) AS d, sum(grade / log2(best + 1.0)) OVER (PARTITION BY user_id) AS ideal FROM a),
p AS (SELECT x.user_id, x.item_id, y.item_id AS other, 1.0 / (1.0 + exp(x.score - y.score)) AS p, abs((x.grade - y.grade) * (x.d - y.d)) / x.ideal AS c FROM b x JOIN b y ON x.user_id = y.user_id AND x.grade > y.grade),
z AS (SELECT user_id, item_id, p * c AS l, p * (1 - p) * c AS w FROM p UNION ALL SELECT user_id, other, -p * c, p * (1 - p) * c FROM p)
SELECT s.user_id, s.item_id, round(coalesce(sum(l), 0), 6) + 0.0 AS lam, round(coalesce(sum(w), 0), 6) + 0.0 AS weight FROM s LEFT JOIN z USING (user_id, item_id) GROUP BY ALL""")
def listwise_gradient(spark, sf):
    """How every candidate's score should move, by the change of its list's NDCG, from the taste scores on."""
    rows = ranking.list_gradients(_candidates(Fixture(spark, sf).once()).select("user_id", "item_id", "grade", "score"))
    return rows.select("user_id", "item_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("lam", "weight")])


@query()
def ltr_listwise(spark, sf):
    return ranking.listwise(*_ranked_halves(Fixture(spark, sf)), FEATURES, "grade", 10)


@query()
def learned_report(spark, sf):
    """Learned factors beside popularity, on the sessions held out."""
    f = Fixture(spark, sf).once()
    users, items = factors.bpr(_likes(f), f.catalog)
    factor_recs = best_items(users.join(f.judged, "user_id", "left_semi"), items, 20, f.seen)
    return metrics.evaluate({"bpr": factor_recs, "popularity": f.popular()}, f.rel, [5, 10, 20])
