"""Users grouped by what they like: k-means over mean tag profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profiles(likes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (user_id, v): the mean of the centred tags of what a user liked, less the mean of everybody, at length one.

    Likes of items that the catalog lacks are left out; a user whose profile is everybody's has a zero vector.
    """
    n = likes.select("user_id", "item_id").join(catalog.select("item_id", F.posexplode("tags").alias("d", "x")), "item_id")
    mine = n.groupBy("user_id", "d").agg(F.avg((F.col("x") - 3.0) / 2.0).alias("x"))
    usual = mine.groupBy("d").agg(F.avg("x").alias("usual"))  # a row a tag
    own = mine.join(F.broadcast(usual), "d").select("user_id", "d", (F.col("x") - F.col("usual")).alias("x"))
    rows = own.groupBy("user_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.sort_array(F.collect_list(F.struct("d", "x"))).alias("z"))
    return rows.select("user_id", F.transform("z", lambda s: F.coalesce(F.try_divide(s["x"], F.col("length")), F.lit(0.0))).alias("v"))


def clustered(vectors: DataFrame, k: int = 6, seed: int = 1, rounds: int = 30) -> DataFrame:
    """Rows (user_id, cluster) of vectors (user_id, v): k-means, its starts and ties by the seed and the rows' order by id.

    Nobody to group: no rows. With fewer different vectors than k there are fewer clusters.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select("user_id", array_to_vector("v").alias("features")).sort("user_id")
    if ready.isEmpty():
        return vectors.select("user_id", F.lit(0).alias("cluster"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, initSteps=5).fit(ready)
    return model.transform(ready).select("user_id", F.col("prediction").alias("cluster"))
