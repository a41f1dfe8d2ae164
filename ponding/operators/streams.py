"""Streams from routed cells: stream cells, terminals, links, their lines and catchments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ponding.operators.grid import jump, settle
from ponding.operators.runoff import strahler


def burn(cells: DataFrame, *layers: DataFrame) -> DataFrame:
    """cells: row, col and others; layers: row, col, depth. Adds burn, the deepest of all layers on each cell, 0 where there is none."""
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    deepest = every.groupBy("row", "col").agg(F.max("depth").alias("burn"))
    return cells.join(deepest, ["row", "col"], "left").withColumn("burn", F.greatest(F.coalesce("burn", F.lit(0.0)), F.lit(0.0)))


def sea(land_class: Column, z: Column, water_class: int = 80, level: float = 1.0) -> Column:
    """Open water at or below the level: no land. Unknown heights are not sea."""
    return F.coalesce((land_class == water_class) & (z <= level), F.lit(False))


def stream_cells(flow: DataFrame, acc: DataFrame, least: float) -> DataFrame:
    """cell, rec, acc, inflow (stream cells that drain into it) and terminal, of the cells with ``least`` drained through them.

    A link ends where its cell drains into itself, into no stream, or into a confluence.
    """
    cells = settle(flow.join(acc, "cell").where(F.col("acc") >= least))
    inflow = cells.where("rec <> cell").groupBy(F.col("rec").alias("cell")).agg(F.count(F.lit(1)).alias("inflow"))
    cells = cells.join(inflow, "cell", "left").withColumn("inflow", F.coalesce("inflow", F.lit(0)))
    below = cells.select(F.col("cell").alias("rec"), F.col("inflow").alias("below"))
    terminal = (F.col("rec") == F.col("cell")) | F.col("below").isNull() | (F.col("below") >= 2)
    return settle(cells.join(below, "rec", "left").select("cell", "rec", "acc", "inflow", terminal.alias("terminal")))


def links_of(cells: DataFrame, n: int | None = None) -> DataFrame:
    """cells of :func:`stream_cells` with link, the terminal cell of each one's link. n: as in :func:`jump`."""
    to = jump(cells.select("cell", F.when(F.col("terminal"), F.col("cell")).otherwise(F.col("rec")).alias("rec")), cells.where("terminal").select("cell"), n=n)
    return settle(cells.join(to.withColumnRenamed("target", "link"), "cell"))


def stream_links(linked: DataFrame, heights: DataFrame, n: int, cell_m: float) -> DataFrame:
    """One row per link: link, downstream, strahler, cells, length_m, drop_m, gradient, acc and line (row, col from the top, and the first cell below).

    linked: of :func:`links_of`; heights: cell, z. A link of one cell with none below has no length.
    """
    z = linked.join(heights, "cell")
    line = F.sort_array(F.collect_list(F.struct("acc", "cell", "z")))
    own = z.groupBy("link").agg(line.alias("path"), F.max("acc").alias("acc"))
    last = linked.where("terminal").select("link", F.when(F.col("rec") != F.col("cell"), F.col("rec")).alias("rec"))
    down = linked.select(F.col("cell").alias("rec"), F.col("link").alias("downstream"))
    own = own.join(last.join(down, "rec", "left").select("link", F.when(F.col("downstream").isNotNull(), F.col("rec")).alias("below"), "downstream"), "link")
    order = strahler(own.select(F.col("link").alias("id"), "downstream")).withColumnRenamed("id", "link")
    path = F.concat(F.transform("path", lambda p: p.cell), F.when(F.col("below").isNotNull(), F.array("below")).otherwise(F.array().cast("array<long>")))
    place = F.transform(path, lambda c: F.struct(F.floor(c / n).cast("int").alias("row"), F.pmod(c, F.lit(n)).cast("int").alias("col")))
    out = own.join(order, "link").withColumn("line", place)
    step = F.zip_with(F.slice("line", F.lit(1), F.size("line") - 1), F.slice("line", F.lit(2), F.size("line") - 1), lambda a, b: F.sqrt(((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)).cast("double")))
    out = out.withColumns({"length_m": F.aggregate(step, F.lit(0.0), lambda s, x: s + x) * cell_m, "drop_m": F.col("path")[0].z - F.element_at("path", -1).z, "cells": F.size("path")})
    return out.select("link", "downstream", "strahler", "cells", "length_m", "drop_m", gradient(F.col("drop_m"), F.col("length_m")).alias("gradient"), "acc", "line")


def gradient(drop: Column, length: Column) -> Column:
    """0 uphill and where there is no length."""
    return F.when(length > 0, F.greatest(drop, F.lit(0.0)) / length).otherwise(0.0)


def catchments(flow: DataFrame, linked: DataFrame, heights: DataFrame, at_least: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """cell, link (of the first stream cell downstream, null where none is reached) and hand, the height above it.

    ``at_least``: cells that count as streams for the height, instead of all linked ones: the
    major streams for the valley height. n: as in :func:`jump`.
    """
    stop = linked.select("cell") if at_least is None else at_least.select("cell")
    to = jump(flow.select("cell", "rec"), stop, n=n)
    link = linked.select(F.col("cell").alias("target"), "link")
    reached = to.join(stop.withColumnRenamed("cell", "target"), "target", "left_semi").join(link, "target")
    z, below = heights.select("cell", "z"), heights.select(F.col("cell").alias("target"), F.col("z").alias("z_t"))
    known = reached.join(z, "cell").join(below, "target").select("cell", "link", F.greatest(F.col("z") - F.col("z_t"), F.lit(0.0)).alias("hand"))
    return to.select("cell").join(known, "cell", "left")


def reached(flow: DataFrame, linked: DataFrame, n: int | None = None) -> DataFrame:
    """cell and link, of the first stream cell downstream; cells that reach none are left out. n: as in :func:`jump`."""
    to = jump(flow.select("cell", "rec"), linked.select("cell"), n=n)
    return to.join(linked.select(F.col("cell").alias("target"), "link"), "target").select("cell", "link")


def samples_along(drains: DataFrame, step: float) -> DataFrame:
    """drains: kind and coords (lon: column, lat: row, in cell units). kind, row, col of points along each segment, at most ``step`` apart, its start first, and the last end."""
    size = F.size("coords")
    pairs = F.zip_with(F.slice("coords", F.lit(1), size - 1), F.slice("coords", F.lit(2), size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    segs = drains.where(size >= 2).select("kind", size.alias("size"), F.posexplode(pairs).alias("at", "s"))
    parts = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("s.b.lon") - F.col("s.a.lon"), F.col("s.b.lat") - F.col("s.a.lat")) / step)).cast("int")
    last = F.when(F.col("at") == F.col("size") - 2, parts).otherwise(parts - 1)
    pts = segs.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    at = lambda k: F.floor(F.col(f"s.a.{k}") + (F.col(f"s.b.{k}") - F.col(f"s.a.{k}")) * F.col("i") / F.col("parts")).cast("int")
    return pts.select("kind", at("lat").alias("row"), at("lon").alias("col"))


def alignment(samples: DataFrame, near: DataFrame) -> DataFrame:
    """kind, share: of the samples (kind, row, col) along drains, how many lie on cells of ``near`` (row, col: streams, dilated)."""
    hit = samples.join(near.select("row", "col").distinct().withColumn("hit", F.lit(1)), ["row", "col"], "left")
    return hit.groupBy("kind").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"), F.count(F.lit(1)).alias("samples"))
