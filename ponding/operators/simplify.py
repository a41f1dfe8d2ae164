"""Line simplification, rasterising lines and polygons, synthetic lattices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

#: Tolerance in degrees by class of drain (fixed values).
TOLERANCE = {"Primary": 1.8e-5, "Secondary": 2.8e-5, "Tertiary": 4.0e-5}


def kept_vertices(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with a stack: a vertex stays if it lies farther from its chord than the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b], y[a + 1 : b], x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / length, 0, 1) if length else np.zeros(b - a - 1)
        d = (px - x[a] - t * dx) ** 2 + (py - y[a] - t * dy) ** 2
        k = int(d.argmax())
        if d[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(lines: DataFrame, tolerance: str = "tolerance") -> DataFrame:
    """lines: coords (array of lon, lat), a tolerance column and others. Drops vertices that do not matter; one line is one value."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coords, tol = b.column("coords"), b.column(tolerance).to_pylist()
            flat, at = coords.flatten(), np.r_[0, np.cumsum(coords.value_lengths().fill_null(0).to_numpy())]
            x, y = flat.field("lon").to_numpy(), flat.field("lat").to_numpy()
            keep = [kept_vertices(x[i:j], y[i:j], t).tolist() if j - i > 2 else [True] * int(j - i) for i, j, t in zip(at, at[1:], tol)]
            yield b.append_column("keep", pa.array(keep, pa.list_(pa.bool_())))

    marked = lines.mapInArrow(mark, StructType([*lines.schema.fields, StructField("keep", ArrayType(BooleanType()))]))
    kept = F.transform(F.filter(F.arrays_zip(F.col("coords").alias("c"), F.col("keep").alias("k")), lambda z: z.k), lambda z: z.c)
    return marked.withColumn("coords", kept).drop("keep")


def rasterise_lines(lines: DataFrame, depth: str, n: int) -> DataFrame:
    """lines: coords in cell units (lon: column, lat: row) and a depth. Every cell that a line has a point in, with the deepest value.

    A cell has its north and west sides. In each row a segment runs over a stretch of columns,
    whose ends follow from where it enters and leaves the row; so no cell is missed, and the work grows with the cells touched.
    """
    size = F.size("coords")
    segs = lines.where(size >= 2).select(depth, F.explode(F.zip_with(F.slice("coords", F.lit(1), size - 1), F.slice("coords", F.lit(2), size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    up = F.col("s.a.lat") <= F.col("s.b.lat")
    end = lambda first, k: F.when(up if first else ~up, F.col(f"s.a.{k}")).otherwise(F.col(f"s.b.{k}")).cast("double")
    segs = segs.select(depth, end(True, "lon").alias("x0"), end(True, "lat").alias("y0"), end(False, "lon").alias("x1"), end(False, "lat").alias("y1"))
    first, last = F.greatest(F.floor("y0"), F.lit(0)), F.least(F.floor("y1"), F.lit(n - 1))
    rows = segs.where(first <= last).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = lambda y: F.when(y <= F.col("y0"), F.col("x0")).when(y >= F.col("y1"), F.col("x1")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0")))
    flat, leaves = F.col("y0") == F.col("y1"), F.col("y1") >= F.col("row") + 1
    enter, leave = F.when(flat, F.col("x0")).otherwise(at(F.col("row").cast("double"))), F.when(flat, F.col("x1")).otherwise(at(F.col("row") + 1.0))
    # Where it leaves the row, its point belongs to the next one: a column that it only reaches there is not in this row.
    right = F.when(~flat & leaves & (leave > enter), F.ceil(leave) - 1).otherwise(F.floor(F.greatest(enter, leave)))
    low, high = F.greatest(F.floor(F.least(enter, leave)), F.lit(0)), F.least(right, F.lit(n - 1))
    cells = rows.where(low <= high).select("row", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("col"), depth)
    return cells.groupBy("row", "col").agg(F.max(depth).alias(depth))


def rasterise_polygons(rings: DataFrame, value: str, n: int) -> DataFrame:
    """rings: id, coords in cell units (all rings of a polygon under one id), value. Cells whose centre lies inside, by crossings on each row."""
    size = F.size("coords")
    segs = rings.select("id", value, F.explode(F.zip_with(F.slice("coords", F.lit(1), size - 1), F.slice("coords", F.lit(2), size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    low, high = F.least("s.a.lat", "s.b.lat"), F.greatest("s.a.lat", "s.b.lat")
    first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5) - 1, F.lit(n - 1))
    rows = segs.where(first <= last).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    t = (F.col("row") + 0.5 - F.col("s.a.lat")) / (F.col("s.b.lat") - F.col("s.a.lat"))
    crossings = rows.select("id", value, "row", (F.col("s.a.lon") + (F.col("s.b.lon") - F.col("s.a.lon")) * t).alias("x"))
    sorted_x = crossings.groupBy("id", value, "row").agg(F.array_sort(F.collect_list("x")).alias("x"))
    pairs = sorted_x.withColumn("k", F.explode(F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1)))
    a, b = F.get("x", 2 * F.col("k")), F.get("x", 2 * F.col("k") + 1)
    first, last = F.greatest(F.ceil(a - 0.5), F.lit(0)), F.least(F.ceil(b - 0.5) - 1, F.lit(n - 1))
    cells = pairs.where(first <= last).select("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("col"), value)
    return cells.groupBy("row", "col").agg(F.max(value).alias(value))


def lattice(spark: SparkSession, n: int = 12, dropped: float = 0.06, seed: str = "3") -> DataFrame:
    """Edges u, v of an n by n street lattice with some left out, by a hash instead of a random stream."""
    cells = spark.range(n * n).select(F.col("id").alias("u"), (F.col("id") % n).alias("c"), F.floor(F.col("id") / n).alias("r"))
    right = cells.where(F.col("c") < n - 1).select("u", (F.col("u") + 1).alias("v"))
    down = cells.where(F.col("r") < n - 1).select("u", (F.col("u") + n).alias("v"))
    chance = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "u", "v")), 1, 6), 16, 10).cast("double") / float(1 << 24)
    return right.unionByName(down).where(chance >= dropped)
