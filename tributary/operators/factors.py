"""Factors learned from pairs of a liked and another item (Bayesian personalised ranking), as rounds of joins and sums.

All factors stand in one table, a row for each user and each item. A round draws other items for every like, takes the
gradient of the log-likelihood that the liked item comes first, and sums it by row of the table. Nothing the size of the users
or the items leaves the executors; a hot user's or item's gradients are summed where they arise, before they are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.hashing import hash_int, uniform
from tributary.functions.vectors import dot
from tributary.sources.durable import Durable


def start(likes: DataFrame, items: DataFrame, dims: int, seed: int) -> DataFrame:
    """Rows (kind, id, f): small factors by hash, the last component of an item being its bias, 0 at first and 1 for users."""

    def side(rows: DataFrame, kind: str, last: float) -> DataFrame:
        small = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (uniform(F.lit(kind), "id", d, F.lit(seed)) - 0.5) * 0.2)
        return rows.select(F.lit(kind).alias("kind"), "id", F.concat(small, F.array(F.lit(last))).alias("f"))

    users = likes.select(F.col("user_id").cast("long").alias("id")).distinct()
    return side(users, "u", 1.0).unionByName(side(items.select(F.col("item_id").cast("long").alias("id")).distinct(), "i", 0.0))


def triples(likes: DataFrame, items: DataFrame, n_items: int, turn: int, samples: int, seed: int) -> DataFrame:
    """Rows (user_id, item_id, other): for each like, items that the user doesn't like, drawn by hash.

    Items lie in as many buckets as there are items, by hash; a like draws `samples` buckets and gets what lies in them:
    no item, one or more, each item as often as any other in the long run. Likes of the user are left out.
    """
    bucket = lambda *parts: hash_int(*parts) % n_items
    held = items.select(F.col("item_id").cast("long").alias("other")).distinct().select("other", bucket("other", F.lit(f"bucket{seed}")).alias("b"))
    drawn = likes.select("user_id", "item_id", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s"))
    drawn = drawn.select("user_id", "item_id", bucket("user_id", "item_id", F.lit(turn), "s", F.lit(seed)).alias("b"))
    known = likes.select("user_id", F.col("item_id").alias("other"))
    return drawn.join(held, "b").join(known, ["user_id", "other"], "left_anti").select("user_id", "item_id", "other")


def gradients(drawn: DataFrame, factors: DataFrame, dims: int) -> DataFrame:
    """Rows (kind, id, g, n): the summed gradient of log sigmoid(user . (item - other)) by row of the factors.

    The last component is the items' bias, which a user's row can't move.
    """
    users = factors.where("kind = 'u'").select(F.col("id").alias("user_id"), F.col("f").alias("u"))
    items = factors.where("kind = 'i'")
    at = drawn.join(users, "user_id").join(items.select(F.col("id").alias("item_id"), F.col("f").alias("a")), "item_id").join(items.select(F.col("id").alias("other"), F.col("f").alias("b")), "other")
    gap = F.zip_with("a", "b", lambda x, y: x - y)
    rows = at.select("user_id", "item_id", "other", "u", gap.alias("gap")).withColumn("p", 1.0 / (1.0 + F.exp(dot("u", "gap"))))
    times = lambda v, s: F.transform(v, lambda x: s * x)
    fixed = F.concat(F.slice(times(F.col("gap"), F.col("p")), F.lit(1), F.lit(dims)), F.array(F.lit(0.0)))
    one = lambda kind, name, g: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("id"), g.alias("g"))
    each = F.explode(F.array(one("u", "user_id", fixed), one("i", "item_id", times(F.col("u"), F.col("p"))), one("i", "other", times(F.col("u"), -F.col("p")))))
    flat = rows.select(each.alias("x")).select("x.*")
    sums = [F.sum(F.col("g")[d]).alias(f"g{d}") for d in range(dims + 1)]
    return flat.groupBy("kind", "id").agg(*sums, F.count("*").alias("n")).select("kind", "id", F.array(*[f"g{d}" for d in range(dims + 1)]).alias("g"), "n")


def stepped(factors: DataFrame, grads: DataFrame, rate: float, decay: float) -> DataFrame:
    """The factors after a step along the gradients, each component by its own rate: rate / root of its squares so far."""
    zero = F.transform("f", lambda _: F.lit(0.0))
    both = factors.join(grads.select("kind", "id", "g"), ["kind", "id"], "left").withColumn("g", F.coalesce("g", zero))
    # decay leaves a user's last component, which stands for one, alone
    pulled = F.transform(F.zip_with("g", "f", lambda g, f: F.struct(g.alias("g"), f.alias("f"))), lambda x: F.when(x["g"] == 0.0, 0.0).otherwise(x["g"] - decay * x["f"]))
    both = both.withColumn("g", pulled).withColumn("sq", F.zip_with("sq", "g", lambda a, g: a + g * g))
    step: Column = F.zip_with("g", "sq", lambda g, a: rate * g / F.sqrt(a + 1e-8))
    return both.select("kind", "id", F.zip_with("f", step, lambda f, d: f + d).alias("f"), "sq")


def bpr(likes: DataFrame, items: DataFrame, dims: int = 16, rounds: int = 12, samples: int = 4, rate: float = 0.1, decay: float = 0.02, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Users (user_id, q) and items (item_id, x) whose inner products rank every user's items; likes: user_id, item_id.

    Repeated likes count once, rows with a null id not at all, and likes of items that aren't among items have no say. Each
    round's factors are written, so that the next one starts from them. Items that nobody likes keep what draws made of them;
    without likes there are no users.
    """
    held = Durable(likes.sparkSession, tidy=True)
    catalog = held.keep(items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id")).distinct())
    some = likes.where("user_id IS NOT NULL AND item_id IS NOT NULL").select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id")).distinct()
    some = held.keep(some.join(catalog, "item_id", "left_semi").select("user_id", "item_id"))
    n_items = max(1, catalog.count())
    factors = held.keep(start(some, catalog, dims, seed).withColumn("sq", F.transform("f", lambda _: F.lit(0.0))))
    for turn in range(rounds):
        grads = gradients(triples(some, catalog, n_items, turn, samples, seed), factors, dims)
        before, factors = factors, held.keep(stepped(factors, grads, rate, decay))
        held.drop(before)
    side = lambda kind, name, v: factors.where(F.col("kind") == kind).select(F.col("id").alias(name), F.col("f").alias(v))
    return side("u", "user_id", "q"), side("i", "item_id", "x")
