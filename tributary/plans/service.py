"""Queries of what a service keeps and asks: vectors by content, places by city, an injected scorer, names in texts, profiles."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import groups, mentions, metrics, recommend, rerank, scorer
from tributary.plans.designs import QUERIES as BASIC_DESIGNS, _lists
from tributary.plans.learned import _likes
from tributary.plans.queries import _CAT, _HIST, _MEANS, _POP, _SPLIT, _USERS, QUERIES as BASIC, Fixture, _metrics_sql
from tributary.sources import encoded, places
from tributary.sources import tables as T
from tributary.sources.durable import Durable
from tributary.streaming import events as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def letters(texts: list[str]) -> np.ndarray:
    """An encoder that anybody can repeat: characters and vowels of a text."""
    return np.array([[len(t), sum(c in "aeiou" for c in t)] for t in texts], dtype=np.float32)


@query(f"""WITH {_CAT}, t AS (SELECT item_id, city || CASE WHEN item_id % 10 = 0 THEN ' renamed' ELSE '' END AS text, item_id % 10 = 0 OR item_id % 7 = 3 AS encoded FROM cat)
SELECT item_id, encoded, length(text)::DOUBLE AS characters, length(regexp_replace(text, '[^aeiou]', '', 'g'))::DOUBLE AS vowels FROM t""")
def embedding_refresh(spark, sf):
    """Vectors of the catalog's names after some names changed and some items came: only these were encoded."""
    names = Fixture(spark, sf).catalog.select("item_id", F.col("city").alias("text"))
    path = f"{Durable(spark).root}/vectors"
    encoded.read_or_build(names.where("item_id % 7 <> 3"), path, letters, 2).count()
    now = names.withColumn("text", F.concat("text", F.when(F.col("item_id") % 10 == 0, " renamed").otherwise("")))
    known = encoded.missing(now, encoded.stored(spark, path, "int")).select("item_id", F.lit(True).alias("encoded"))
    new = Durable(spark).keep(known)  # before the table grows
    rows = encoded.read_or_build(now, path, letters, 2).join(new, "item_id", "left")
    part = lambda i: F.col("embedding")[i].cast("double")
    return rows.select("item_id", F.coalesce("encoded", F.lit(False)).alias("encoded"), part(0).alias("characters"), part(1).alias("vowels"))


@query("SELECT p_brand AS city, count(*) AS places, min(p_partkey) AS first, round(avg(p_retailprice), 4) AS price FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_name LIKE 'hot %' AND p_partkey % 50 = 3) GROUP BY 1")
def places_by_city(spark, sf):
    """A bulk table laid out by city, read for the cities that another table names."""
    part = T.table(spark, sf, "part")
    path = f"{Durable(spark).root}/places"
    places.write_places(part.withColumnRenamed("p_brand", "city"), path, key="p_partkey")
    wanted = part.where("p_name LIKE 'hot %' AND p_partkey % 50 = 3").select(F.col("p_brand").alias("city"))
    rows = places.read_places(spark, path, wanted)
    return rows.groupBy("city").agg(F.count("*").alias("places"), F.min("p_partkey").alias("first"), F.round(F.avg("p_retailprice"), 4).alias("price"))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def stand_in(prompts: list[str]) -> list[str]:
    """A scorer that anybody can repeat: places in the catalog from the prompt's checksum, and now and then no list at all."""
    out = []
    for p in prompts:
        h = _number(p)
        out.append("I can't tell." if h % 7 == 0 else f"Picks: {[(h % 1000 + i * i * 13) % 130 - 5 for i in range(30)]}")
    return out


_ASKED = _HIST + f""", {_CAT}, {_USERS}, ru AS (SELECT DISTINCT user_id FROM rel), pm AS (SELECT u.user_id, coalesce(string_agg(event_type || ' ' || city, chr(10) ORDER BY rn DESC) FILTER (WHERE city IS NOT NULL), 'no history') AS prompt FROM users u LEFT JOIN (SELECT * FROM h JOIN cat USING (item_id) WHERE rn <= 40) x ON x.user_id = u.user_id GROUP BY 1),
hx AS (SELECT user_id, ('0x' || substr(md5(prompt), 1, 8))::BIGINT AS x FROM pm SEMI JOIN ru USING (user_id)), pk AS (SELECT user_id, i AS turn, (x % 1000 + i * i * 13) % 130 - 5 AS place FROM hx, range(0, 30) r(i) WHERE x % 7 <> 0),
pl AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM cat), on_ AS (SELECT user_id, item_id, min(turn) AS turn FROM pk JOIN pl USING (place) ANTI JOIN seen USING (user_id, item_id) GROUP BY ALL),
r_ask AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY turn, item_id) AS INT) AS rank, item_id FROM on_)"""


def _asked(spark, sf) -> tuple[Fixture, scorer.Asked]:
    f = Fixture(spark, sf)
    prompts = BASIC["history_prompt"](spark, sf)
    return f, scorer.Asked(prompts, f.catalog, f.seen, spark.createDataFrame([], scorer.CACHE), "stand-in", stand_in)


@query(_ASKED + " SELECT * FROM r_ask WHERE rank <= 10")
def rec_asked(spark, sf):
    """The ten best by an injected scorer's picks, places in the catalog checked and turned into items."""
    f, model = _asked(spark, sf)
    return model.recommend(f.judged, 10)


@query(_ASKED + ", recs AS (SELECT 'asked' AS model, user_id, rank, item_id FROM r_ask WHERE rank <= 20), " + _metrics_sql("recs") + _MEANS)
def eval_asked(spark, sf):
    f, model = _asked(spark, sf)
    return metrics.evaluate({"asked": model.recommend(f.judged, 20)}, f.rel, [5, 10, 20])


@query(_ASKED + " SELECT DISTINCT sha256('stand-in' || chr(0) || prompt) AS key, 30 AS n, ((x % 1000) % 130 - 5)::INT AS first FROM pm JOIN hx USING (user_id) WHERE x % 7 <> 0")
def reply_cache(spark, sf):
    """The replies worth keeping, through the file of the cache: failed ones aren't in it."""
    f = Fixture(spark, sf)
    prompts = BASIC["history_prompt"](spark, sf).join(f.judged, "user_id", "left_semi")
    _, cache = scorer.replies(prompts, spark.createDataFrame([], scorer.CACHE), "stand-in", stand_in)
    path = f"{Durable(spark).root}/cache"
    T.write_cache(cache.select("key", scorer.parsed("reply").alias("picks")), path)
    return T.read_cache(spark, path).select("key", F.size("picks").alias("n"), F.col("picks")[0].alias("first"))


def stand_in_pairs(prompts: list[str]) -> list[str]:
    return ["none" if _number(p) % 11 == 0 else str(_number(p) % 1000 / 1000) for p in prompts]


@query(f"""WITH {_POP}, q AS (SELECT user_id, item_id, ('0x' || substr(md5(concat_ws(' [SEP] ', 'user ' || user_id, city)), 1, 8))::BIGINT AS x FROM r_pop JOIN cat USING (item_id)),
s AS (SELECT user_id, item_id, CASE WHEN x % 11 <> 0 THEN x % 1000 / 1000.0::DOUBLE END AS score FROM q) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, item_id) AS INT) AS rank FROM s) WHERE rank <= 10""")
def rescored_pairs(spark, sf):
    """The popular twenty in the order of a scorer of (user, item) texts; pairs it can't score come last."""
    pairs = BASIC_DESIGNS["cross_pairs"](spark, sf).withColumnRenamed("pair", "prompt")
    scored, _ = scorer.pair_scores(pairs, spark.createDataFrame([], scorer.CACHE), "stand-in", stand_in_pairs)
    return recommend.top_k(scored, 10, F.col("score").desc_nulls_last(), F.col("item_id")).select("user_id", "item_id", "score", "rank")


_TOK = r"regexp_extract_all(lower({}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_MEN = f"""WITH nm AS (SELECT item_id AS name_id, array_to_string(list_slice({_TOK.format('text')}, 1, n), ' ') AS name, n FROM benchmark, (VALUES (3), (5)) t(n) WHERE len({_TOK.format('text')}) >= n),
tx AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents), gr AS (SELECT doc_id, i - 1 AS start, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS name FROM tx, (VALUES (3), (5)) t(n), unnest(range(1, len(w) - n + 2)) r(i)),
fd AS (SELECT DISTINCT doc_id, start, n, name_id FROM gr JOIN nm USING (name, n)),
kp AS (SELECT * FROM fd a WHERE NOT EXISTS (SELECT 1 FROM fd b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b.start + b.n >= a.start + a.n AND b.n > a.n))"""


def _mentions(spark, sf) -> DataFrame:
    """The first three and the first five words of the benchmark's passages are names; documents are the texts."""
    words = mentions.tokens("text")
    names = T.table(spark, sf, "benchmark").select("item_id", words.alias("w"), F.explode(F.array(F.lit(3), F.lit(5))).alias("n")).where(F.size("w") >= F.col("n"))
    names = names.select(F.col("item_id").alias("name_id"), F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("name"))
    return mentions.find_mentions(T.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text"), names)


@query(_MEN + " SELECT doc_id, start::INT AS start, n::INT AS n, name_id FROM kp")
def text_mentions(spark, sf):
    """Names in whole documents, the longest at a place."""
    return _mentions(spark, sf).withColumnRenamed("text_id", "doc_id")


@query(_MEN + ", pl AS (SELECT doc_id, start, n, max(CASE WHEN (doc_id + name_id) % 3 > 0 THEN 1 ELSE 0 END) AS ok FROM kp GROUP BY ALL) SELECT doc_id, count(*) AS mentions, sum(ok)::BIGINT AS grounded, round(sum(ok) / count(*)::DOUBLE, 6) AS rate FROM pl GROUP BY 1")
def mention_grounding(spark, sf):
    """How many of a document's mentions are of its candidates: here two thirds of all names, by document."""
    found = _mentions(spark, sf)
    allowed = found.where((F.col("text_id") + F.col("name_id")) % 3 > 0).select("text_id", "name_id")
    return mentions.grounding(found, allowed).withColumnRenamed("text_id", "doc_id")


@query()
def persona_clusters(spark, sf):
    """Six clusters of users by what they liked in training, against their first persona: purity and adjusted Rand index."""
    f = Fixture(spark, sf)
    found = groups.clustered(groups.profiles(_likes(f), f.catalog), k=6)
    return metrics.agreement(found.join(f.users.select("user_id", "p1"), "user_id").select("cluster", "p1"), "cluster", "p1")


@query()
def kdpp(spark, sf):
    """Ten of the fifty best of each user, drawn so that they are good and unlike each other."""
    return rerank.kdpp(_lists(Fixture(spark, sf)))


_STREAM = f"WITH {_SPLIT}"


@query(_STREAM + " SELECT a.user_id, a.item_id, a.ts AS shown, b.ts AS clicked FROM inter a JOIN inter b ON a.user_id = b.user_id AND a.item_id = b.item_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 DAY WHERE a.event_type = 'impression' AND b.event_type = 'click'")
def clicks_after_impressions(spark, sf):
    f = Fixture(spark, sf)
    of = lambda kind: f.inter.where(F.col("event_type") == kind)
    return stream.clicks_after(of("impression"), of("click"), "10 DAY")


@query(_STREAM + """, l AS (SELECT user_id, item_id, ts, max(ts) OVER (PARTITION BY user_id, item_id) AS "at" FROM inter WHERE event_type IN ('click', 'save'))
SELECT user_id, item_id, "at", round(sum(pow(0.5, (epoch_us("at") - epoch_us(ts)) / 86400e6 / 30.0)), 6) AS weight FROM l GROUP BY ALL""")
def decayed_profiles(spark, sf):
    """What a stream of likes keeps of each user and item: the decayed weight as of the newest like."""
    liked = Fixture(spark, sf).inter.where(F.col("event_type").isin("click", "save"))
    return stream.decayed(liked.withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", "item_id", F.col("at").cast("timestamp_ntz").alias("at"), F.round("weight", 6).alias("weight"))
