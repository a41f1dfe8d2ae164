"""The nearest of any number of points, exactly, by descending a quadtree of bounding boxes.

Every point begins at the root. At each level the boxes it may find its nearest in are split;
a box stays if it can hold something closer than another box must hold. So a point carries a
few boxes, however far it is from all others, and no table is compared with every row of
another. Boxes of few rows are compared row by row at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ponding.functions.geo import M_PER_DEG_NETWORK, flat_distance, metres_per_degree_lon
from ponding.operators.grid import drop, settle

#: Levels of the tree, rows that a box may have to be compared row by row, and levels whose boxes (at most 4 to that power) are broadcast.
DEPTH, LEAF, BROADCAST = 24, 32, 6
#: Bounds are widened by this share, for rounding.
SLACK = 1e-9


def _plane(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2))


def _bounds(metric: str) -> tuple[Column, Column]:
    """The least and the greatest distance of a point (x, y) from anything in a box (x0, x1, y0, y1)."""
    x, y = F.col("x"), F.col("y")
    near = lambda v, a, b: F.greatest(F.col(a) - v, v - F.col(b), F.lit(0.0))
    far = lambda v, a, b: F.greatest(F.abs(v - F.col(a)), F.abs(v - F.col(b)))
    if metric == "plane":
        scale = (F.lit(1.0),) * 3
    else:
        low, high = (y + F.col("y0")) / 2, (y + F.col("y1")) / 2
        at_low, at_high = metres_per_degree_lon(low), metres_per_degree_lon(high)
        most = F.when((low <= 0) & (high >= 0), metres_per_degree_lon(F.lit(0.0))).otherwise(F.greatest(at_low, at_high))
        scale = (F.least(at_low, at_high), most, F.lit(M_PER_DEG_NETWORK))
    least = F.hypot(near(x, "x0", "x1") * scale[0], near(y, "y0", "y1") * scale[2]) * (1 - SLACK)
    return least, F.hypot(far(x, "x0", "x1") * scale[1], far(y, "y0", "y1") * scale[2]) * (1 + SLACK)


def nearest(points: DataFrame, others: DataFrame, metric: str = "flat") -> DataFrame:
    """id, other, d: for each point the nearest other one (ties: the smaller id), at any distance; null where there is none.

    points, others: id and lon, lat (metric "flat", metres at the mean latitude of both) or x, y
    ("plane"). Points without coordinates, and repeated ids, are answered row by row like any other.
    """
    a, b = ("lon", "lat") if metric == "flat" else ("x", "y")
    xy = lambda df: df.select("id", F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    mine = settle(xy(points).withColumn("key", F.monotonically_increasing_id()))
    q = xy(others).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    box = q.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    if not box.n:
        return mine.select("id", F.lit(None).cast(dict(others.dtypes)["id"]).alias("other"), F.lit(None).cast("double").alias("d"))
    side = max(box.x1 - box.x0, box.y1 - box.y0) or 1.0
    place = lambda c, low: F.least(F.floor((F.col(c) - low) / side * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")
    q = settle(q.withColumns({"mx": place("x", box.x0), "my": place("y", box.y0)}))
    cell = lambda level, c: F.shiftright(F.col(c), DEPTH - level)
    least, most = _bounds(metric)
    open_ = settle(mine.where("x is not null and y is not null").select("key", "x", "y", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(float("inf")).alias("bound")))
    leaves, kept, level = [], [q], 0
    while level < DEPTH:
        level += 1
        boxes = q.groupBy(cell(level, "mx").alias("nx"), cell(level, "my").alias("ny")).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in ((0, F.min), (1, F.max))])
        boxes = boxes.withColumns({"cx": F.shiftright("nx", 1), "cy": F.shiftright("ny", 1)}).select("cx", "cy", "nx", "ny", "n", "x0", "x1", "y0", "y1")
        met = open_.join(F.broadcast(boxes) if level <= BROADCAST else boxes, ["cx", "cy"]).withColumns({"least": least, "most": most})
        best = met.groupBy("key").agg(F.min(F.least("most", "bound")).alias("bound"))
        now = settle(met.drop("bound").join(best, "key").where("least <= bound").select("key", "x", "y", F.col("nx").alias("cx"), F.col("ny").alias("cy"), "bound", "least", "n"))
        drop(open_)
        kept.append(now)
        small = now if level == DEPTH else now.where(F.col("n") <= LEAF)
        leaves.append((level, small.select("key", "x", "y", "cx", "cy", "least", "bound")))
        open_ = now.where(F.col("n") > LEAF).select("key", "x", "y", "cx", "cy", "bound")
        if not open_.limit(1).count():
            break
    found = reduce(DataFrame.unionByName, (leaf for _, leaf in leaves))
    bound = found.groupBy("key").agg(F.min("bound").alias("last"))
    rows = q.select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "mx", "my")
    apart = flat_distance if metric == "flat" else _plane
    pairs = []
    for at, leaf in leaves:
        at_level = rows.withColumns({"cx": cell(at, "mx"), "cy": cell(at, "my")}).drop("mx", "my")
        still = leaf.join(bound, "key").where("least <= last")
        pairs.append(still.join(at_level, ["cx", "cy"]).select("key", apart(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("d"), "other"))
    nearest_ = settle(reduce(DataFrame.unionByName, pairs).groupBy("key").agg(F.min(F.struct("d", "other")).alias("b")))
    drop(*kept)
    return mine.join(nearest_, "key", "left").select("id", F.col("b.other").alias("other"), F.col("b.d").alias("d"))
