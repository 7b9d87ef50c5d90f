"""Points in polygons: a grid key brings points and areas together, a ray cast decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edges(ring: str) -> Column:
    """The ring's corners with the next one each, the last with the first."""
    corners = F.col(ring)
    following = F.concat(F.slice(corners, F.lit(2), F.greatest(F.size(corners) - 1, F.lit(0))), F.slice(corners, 1, 1))
    return F.zip_with(corners, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def inside(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Rows (item_id, area): points (item_id, x, y) within areas (area, ring array<struct<x, y>>), by the even-odd rule.

    An area is copied to each grid cell of its bounding box, so `cell` should be about the width of a usual area.
    Points without coordinates and areas without corners are in nothing.
    """
    at = lambda c: F.floor(c / cell)
    side = lambda name: F.transform("ring", lambda p: p[name])
    cells = lambda name: F.explode(F.sequence(at(F.array_min(side(name))), at(F.array_max(side(name)))))
    spread = areas.where(F.size("ring") > 2).withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    near = points.where("x IS NOT NULL AND y IS NOT NULL").withColumn("cx", at(F.col("x"))).withColumn("cy", at(F.col("y"))).join(spread, ["cx", "cy"])

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        reach = F.try_divide((b["x"] - a["x"]) * (F.col("y") - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > F.col("y")) != (b["y"] > F.col("y"))) & (F.col("x") < reach)

    return near.where(F.size(F.filter(_edges("ring"), crossed)) % 2 == 1).select("item_id", "area")


def extent(areas: DataFrame) -> DataFrame:
    """Rows (area, extent): the surface of each ring."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    return areas.select("area", (F.abs(F.aggregate(_edges("ring"), F.lit(0.0), lambda s, e: s + cross(e))) / 2.0).alias("extent"))


def near(centres: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Rows (a, b, distance): points b (item_id, x, y) within `radius` of centres a, by a join on cells as wide as that.

    A centre looks into its own cell and the eight around it, so distant pairs never meet. Points without a place are near
    nothing; equal places are at distance 0.
    """
    cell = lambda c, d=0: (F.floor(F.col(c) / radius) + d).cast("long")
    around = F.array(*[F.struct(cell("x", i).alias("cx"), cell("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = centres.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("item_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(around).alias("c")).select("a", "ax", "ay", "c.cx", "c.cy")
    held = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("item_id").alias("b"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    apart = F.sqrt((F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y")))
    return asked.join(held, ["cx", "cy"]).where(apart <= radius).select("a", "b", F.round(apart, 9).alias("distance"))
