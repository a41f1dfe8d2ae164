"""Spatial joins without an index: points meet by cells of a grid as wide as the radius, then by distance.

Points of one place are joined as one, so crowds in one place cost no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.functions.geo import M_PER_DEG_ROUTING


def metres(df: DataFrame, lat0: float) -> DataFrame:
    """Adds x, y in metres on a plane through latitude lat0."""
    import math

    return df.withColumns({"x": F.col("lon") * (M_PER_DEG_ROUTING * math.cos(math.radians(lat0))), "y": F.col("lat") * M_PER_DEG_ROUTING})


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """id, other, d for all pairs within the radius (inclusive). left, right: id, x, y.

    The right side is binned once; the left looks into its bin and the eight around it. An
    equi-join on bins that Spark may split where points crowd.
    """
    bin_of = lambda c: F.floor(F.col(c) / radius)
    around = F.sequence(F.lit(-1), F.lit(1))
    l = left.select("id", "x", "y", bin_of("x").alias("bx"), F.explode(F.transform(around, lambda d: bin_of("y") + d)).alias("by"))  # noqa: E741
    l = l.select("id", "x", "y", F.explode(F.transform(around, lambda d: F.col("bx") + d)).alias("bx"), "by")  # noqa: E741
    r = right.select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), bin_of("x").alias("bx"), bin_of("y").alias("by"))
    d = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
    return l.join(r, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= radius).select("id", "other", "d")


def _places(df: DataFrame) -> DataFrame:
    """The places where points lie, each once, named by its coordinates, with how many points there are."""
    return df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.struct("x", "y"))


def _first(df: DataFrame) -> DataFrame:
    """The point with the smallest id of each place."""
    return df.groupBy("x", "y").agg(F.min("id").alias("id"))


def nearest_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """For each left point the nearest right one within the radius (ties: the smaller id), else null."""
    best = near_pairs(_places(left), _first(right), radius).groupBy("id").agg(F.min(F.struct("d", "other")).alias("b")).select("id.x", "id.y", "b")
    return left.join(best, ["x", "y"], "left").select("id", F.col("b.other").alias("other"), F.col("b.d").alias("d"))


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Left points with a right one closer than the radius."""
    near = near_pairs(_places(left), _first(right), radius).where(F.col("d") < radius).select("id.x", "id.y").distinct()
    return left.join(near, ["x", "y"], "left_semi").select(*left.columns)


def crowd(points: DataFrame, radius: float) -> DataFrame:
    """How many points lie within the radius of each, itself included."""
    p = _places(points)
    pairs = near_pairs(p, p, radius).join(p.select(F.col("id").alias("other"), "n"), "other")
    near = pairs.groupBy("id").agg(F.sum("n").alias("near")).select("id.x", "id.y", "near")
    return points.join(near, ["x", "y"]).groupBy("id").agg(F.sum("near").alias("near"))


def sample_raster(points: DataFrame, raster: DataFrame, west: float, south: float, east: float, north: float, n: int) -> DataFrame:
    """The raster value under each point; points off the grid or on empty cells go."""
    row, col = F.floor((north - F.col("lat")) / (north - south) * n).cast("int"), F.floor((F.col("lon") - west) / (east - west) * n).cast("int")
    at = points.withColumn("row", row).withColumn("col", col).where(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1))
    return at.join(raster.where(F.col("value").isNotNull()), ["row", "col"])
