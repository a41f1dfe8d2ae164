"""Zones of a grid as polygons: rings by following borders, holes in their outer rings, borders simplified once for both sides.

A border is followed side by side within each tile, with the zone on its right; what follows a side lies in the cells
around it. Rings within a tile are whole there. The others are pieces that end at the border of the tile, and only those
take part in the doubling that finds their ring; then all pieces of a ring come together, and a ring is one value.
Cells of a zone that touch only at a corner are apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ponding.operators.grid import drop, jump, settle
from ponding.operators.simplify import kept_vertices
from ponding.operators.tiles import TILE, by_tile, ends

#: Ways of a side: east along a cell's top, south along its right side, west along its bottom, north along its left side.
#: For each the step ahead, the step to the cell across the border, and where the side begins, seen from its cell.
AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
ACROSS = ((-1, 0), (0, 1), (1, 0), (0, -1))
BEGIN = ((0, 0), (0, 1), (1, 1), (1, 0))
PIECE = "zone long, start long, next long, least long, points array<long>"
RING = "zone long, ring long, area double, points array<struct<row:int,col:int,junction:boolean>>"


def _sides(z: np.ndarray, there: np.ndarray, top: int, left: int) -> tuple[np.ndarray, ...]:
    """The sides of a tile's cells that are borders, z and there having a rim of one.

    cell and name of each side; the place among them of the side that follows (its own where that one is outside the tile),
    whether it is inside, and its name; whether a vertex of the ring lies where the side begins; and that vertex.
    A side is named by where it begins and its way, which no other side shares.
    """
    t = len(z) - 2
    cut = lambda a, r, c: a[1 + r : 1 + r + t, 1 + c : 1 + c + t]
    same = lambda r, c: cut(there, 0, 0) & cut(there, r, c) & (cut(z, r, c) == cut(z, 0, 0))
    part = lambda a, b: (there[a] | there[b]) & ~(there[a] & there[b] & (z[a] == z[b]))
    lo, hi = slice(None, -1), slice(1, None)
    meeting = sum(part(a, b).astype("i1") for a, b in (((lo, lo), (lo, hi)), ((lo, hi), (hi, hi)), ((hi, hi), (hi, lo)), ((hi, lo), (lo, lo)))) >= 3
    found = []
    for way, ((r, c), (i, j), (y, x)) in enumerate(zip(AHEAD, ACROSS, BEGIN)):
        row, col = np.nonzero(cut(there, 0, 0) & ~same(i, j))
        on, beyond, behind = (a[row, col] for a in (same(r, c), same(r + i, c + j), same(-r, -c) & ~same(i - r, j - c)))
        # A border keeps to its own cells: it turns right where it can, else goes on, else turns left.
        way2 = np.where(~on, way + 1, np.where(beyond, way + 3, way)) % 4
        row2, col2 = row + np.where(on, r + np.where(beyond, i, 0), 0), col + np.where(on, c + np.where(beyond, j, 0), 0)
        joint = meeting[row + y, col + x]
        found.append((np.full(len(row), way), row, col, way2, row2, col2, joint, joint | ~behind))
    way, row, col, way2, row2, col2, joint, vertex = (np.concatenate(v) for v in zip(*found))
    y, x = np.array(BEGIN).T
    spot = lambda r, c, w: (r + y[w] + top + 1 << 33) + (c + x[w] + left + 1 << 2)
    place = np.full((4, t, t), -1)
    place[way, row, col] = np.arange(len(way))
    inside = (row2 >= 0) & (row2 < t) & (col2 >= 0) & (col2 < t)
    to = np.where(inside, place[way2, np.where(inside, row2, 0), np.where(inside, col2, 0)], np.arange(len(way)))
    return cut(z, 0, 0)[row, col], spot(row, col, way) + way, to, inside, spot(row2, col2, way2) + way2, vertex, spot(row, col, way) + joint


def pieces(df: DataFrame, zone: str = "zone", tile: int = TILE) -> DataFrame:
    """Stretches of border within a tile: zone, start (its first side), next (the side that follows its last, start where it closes), least (its least side), points.

    points: the vertices of the ring, numbered by row, column and whether borders meet there.
    """

    def follow(_: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        z = (np.where(there, arrays["high"], 0).astype("i8") << 32) + np.where(there, arrays["low"], 0).astype("i8")
        own, name, to, inside, after, vertex, point = _sides(z, there, top, left)
        if not len(name):
            return pd.DataFrame({k: pd.Series([], dtype=object) for k in ("zone", "start", "next", "least", "points")})
        least, far = name, to
        for _ in range(len(name).bit_length()):
            least, far = np.minimum(least, least[far]), far[far]
        closes = inside[far] & (name[to] == least)
        end, steps = ends(np.where(closes, np.arange(len(to)), to))
        order = np.lexsort((-steps, end))
        first = np.flatnonzero(np.r_[True, np.diff(end[order]) != 0])
        last = np.r_[first[1:], len(order)] - 1
        at = np.r_[0, np.cumsum(vertex[order])]
        points = np.split(point[order][vertex[order]], at[first[1:]])
        return pd.DataFrame({"zone": own[order[first]], "start": name[order[first]], "next": after[order[last]], "least": np.minimum.reduceat(name[order], first), "points": pd.Series(points, dtype=object)})

    z = F.col(zone).cast("long")
    cells = df.where(F.col(zone).isNotNull()).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.shiftright(z, 32).alias("high"), z.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))
    return by_tile(cells, follow, PIECE, tile=tile)


def ringed(open_pieces: DataFrame) -> DataFrame:
    """start and ring, the least side of the ring. Strides along the pieces are doubled."""
    at = settle(open_pieces.select("start", F.col("next").alias("to"), F.col("least").alias("ring")))
    while True:
        other = at.select(F.col("start").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"))
        new = settle(at.join(other.hint("merge"), "to").select("start", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("sank")))
        drop(at)
        if not new.where("sank").limit(1).count():
            out = new.select("start", "ring")
            out.stored_at = new.stored_at
            return out
        at = new.drop("sank")
        at.stored_at = new.stored_at


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rings from their pieces (zone, ring, start, next, least, points), which follow each other by ring: many at a time."""
    held, of = [], None
    for batch in batches:
        if batch.num_rows:
            ring = batch.column("ring").to_numpy()
            begin = int(np.searchsorted(ring, ring[-1]))
            if begin or (held and of != ring[-1]):
                yield _in_order([*held, batch.slice(0, begin)])
                held = []
            held.append(batch.slice(begin))
            of = ring[-1]
    if held:
        yield _in_order(held)


def _in_order(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each ring: its area and its vertices, from the first at which borders meet after its least side."""
    t = pa.Table.from_batches(parts).combine_chunks()
    zone, ring, start, after, least = (t[k].to_numpy() for k in ("zone", "ring", "start", "next", "least"))
    by = np.argsort(start)
    to = by[np.searchsorted(start[by], after)]
    _, steps = ends(np.where(least[to] == ring[to], np.arange(len(to)), to))
    order = np.lexsort((-steps, ring))
    points = t["points"].combine_chunks()
    flat, size = points.flatten().to_numpy(), points.value_lengths().to_numpy()
    begin = (np.cumsum(size) - size)[order]
    size = size[order]
    p = flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    head = np.flatnonzero(np.r_[True, np.diff(ring[order]) != 0])
    count = np.add.reduceat(size, head)
    off = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    # The least vertex of a ring is passed once, so the least point tells where it begins.
    lowest = np.flatnonzero(p == np.minimum.reduceat(p, off)[of])
    at = (np.arange(len(p)) - lowest[of]) % count[of]
    shift = np.minimum.reduceat(np.where(p & 3, at, count[of]), off) % count
    out = np.empty_like(p)
    out[off[of] + (at - shift[of]) % count[of]] = p
    row = (out + (1 << 32)) >> 33
    col = (out - (row << 33)) >> 2
    nxt = np.arange(1, len(p) + 1)
    nxt[off + count - 1] = off
    area = np.add.reduceat(col * row[nxt] - col[nxt] * row, off) / 2
    vertices = pa.StructArray.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(out & 3 > 0)], ["row", "col", "junction"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[off, len(p)], pa.int32()), vertices)
    return pa.RecordBatch.from_arrays([pa.array(zone[order][head]), pa.array(ring[order][head]), pa.array(area), lists], ["zone", "ring", "area", "points"])


def _outer(rings: DataFrame) -> DataFrame:
    """ring, outer of the holes: the ring a hole lies in. West of a hole's westernmost side its zone's cells go on to a border: of the outer ring or of another hole further west."""
    holes = rings.where("area < 0")
    n = F.size("points")
    stretch = F.explode(F.zip_with("points", F.concat(F.slice("points", F.lit(2), n - 1), F.slice("points", F.lit(1), F.lit(1))), lambda a, b: F.struct(a.row.alias("row"), a.col.alias("col"), b.row.alias("row2")))).alias("s")
    probe = holes.select("zone", "ring", stretch).where("s.row2 > s.row").groupBy("zone", "ring").agg(F.min(F.struct("s.col", "s.row")).alias("p")).select("zone", F.col("p.row").alias("at"), F.col("p.col").alias("col"), F.col("ring").alias("hole"), F.lit(None).cast("long").alias("met"))
    around = rings.join(holes.select("zone").distinct(), "zone", "left_semi").select("zone", "ring", stretch).where("s.row2 < s.row")
    west = around.select("zone", F.explode(F.sequence("s.row2", F.col("s.row") - 1)).alias("at"), "s.col", F.lit(None).cast("long").alias("hole"), F.col("ring").alias("met"))
    w = Window.partitionBy("zone", "at").orderBy("col", F.col("hole").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = probe.unionByName(west).withColumn("met", F.last("met", True).over(w)).where("hole is not null")
    flow = settle(met.select(F.col("hole").alias("cell"), F.coalesce("met", "hole").alias("rec")))
    ways = flow.unionByName(flow.select(F.col("rec").alias("cell"), "rec").distinct().join(flow.select("cell"), "cell", "left_anti"))
    return jump(ways, flow.where("false").select("cell")).join(flow.select("cell"), "cell", "left_semi").select(F.col("cell").alias("ring"), F.col("target").alias("outer"))


def _kept(points: list, tolerance: float) -> list:
    r, c = (np.array([p[k] for p in points], float) for k in ("row", "col"))
    keep = kept_vertices(r, c, tolerance)
    return [p for p, k in zip(points, keep) if k]


def _arcs(rings: DataFrame) -> DataFrame:
    """A ring's vertices as arcs between the places where borders meet; an arc's name is the same from both sides."""
    n = F.size("points")
    meets = F.filter(F.transform("points", lambda p, i: F.when(p.junction, i + 1)), lambda i: i.isNotNull())
    cuts = rings.withColumn("cuts", F.when(F.size(meets) > 0, meets).otherwise(F.array(F.lit(1)))).withColumn("points", F.concat(F.transform("points", lambda p: F.struct(p.row.alias("row"), p.col.alias("col"))), F.transform(F.slice("points", F.lit(1), F.lit(1)), lambda p: F.struct(p.row.alias("row"), p.col.alias("col")))))
    parts = F.zip_with("cuts", F.concat(F.slice("cuts", F.lit(2), F.size("cuts") - 1), F.array(n)), lambda a, b: F.slice("points", a, b - a + 1))
    arcs = cuts.select("zone", "ring", "area", F.posexplode(parts).alias("seq", "points")).withColumn("forward", F.col("points") <= F.reverse("points"))
    arcs = arcs.withColumn("points", F.when(F.col("forward"), F.col("points")).otherwise(F.reverse("points")))
    return arcs.withColumn("arc", F.concat_ws(" ", F.get("points", F.lit(0)).row, F.get("points", F.lit(0)).col, F.get("points", F.lit(1)).row, F.get("points", F.lit(1)).col))


def vectorise(df: DataFrame, zone: str = "zone", tolerance: float | None = None, tile: int = TILE) -> DataFrame:
    """zone, ring, outer (the ring it lies in, itself if it is no hole), area (in cells, before simplifying; negative for holes), coords.

    df: row, col and a zone as a whole number; cells without a zone may be null or missing. coords: closed rings of
    (lon: column, lat: row) at cell corners, outer rings clockwise as seen on a map with rows downwards, holes the other way.
    tolerance: in cells. A border between two zones is simplified once and is the same in both; the arcs of rings that would
    collapse keep every vertex.
    """
    stretches = settle(pieces(df, zone, tile))
    whole = stretches.where("start = next").withColumn("ring", F.col("start"))
    ring_of = ringed(stretches.where("start <> next"))
    broken = stretches.join(ring_of, "start").repartition("ring").sortWithinPartitions("ring")
    columns = ["zone", "ring", "start", "next", "least", "points"]
    # Pieces that close are rings by themselves and stay where they are.
    rings = settle(whole.select(columns).sortWithinPartitions("ring").mapInArrow(_closed, RING).unionByName(broken.select(columns).mapInArrow(_closed, RING)))
    drop(stretches, ring_of)
    outer = _outer(rings)
    if tolerance is None:
        point = lambda p: F.struct(p.col.cast("double").alias("lon"), p.row.cast("double").alias("lat"))
        shapes = rings.select("zone", "ring", "area", F.transform(F.concat("points", F.slice("points", F.lit(1), F.lit(1))), point).alias("coords"))
    else:
        shapes = _joined(_simplified(_arcs(rings), tolerance))
    columns = ["zone", "ring", "outer", "area", "coords"]
    return shapes.where("area > 0").withColumn("outer", F.col("ring")).select(columns).unionByName(shapes.where("area < 0").join(outer, "ring").select(columns))


def _simplified(arcs: DataFrame, tolerance: float) -> DataFrame:
    """Arcs with fewer vertices; those of rings that would collapse keep all."""
    arcs = settle(arcs)

    @F.pandas_udf("array<struct<row:int,col:int>>")
    def simplified(points: pd.Series) -> pd.Series:
        return points.map(lambda p: _kept(list(p), tolerance))

    thin = settle(arcs.dropDuplicates(["arc"]).select("arc", "points", simplified("points").alias("thin")))
    tried = _joined(arcs.drop("points").join(thin.select("arc", F.col("thin").alias("points")), "arc"))
    turns = F.zip_with(F.slice("coords", F.lit(1), F.size("coords") - 1), F.slice("coords", F.lit(2), F.size("coords") - 1), lambda a, b: a.lon * b.lat - b.lon * a.lat)
    collapsed = tried.where((F.size("coords") < 4) | (F.aggregate(turns, F.lit(0.0), lambda s, x: s + x) * F.signum("area") <= 0)).select("ring")
    whole = arcs.join(collapsed, "ring", "left_semi").select("arc").distinct().withColumn("whole", F.lit(True))
    chosen = thin.join(whole, "arc", "left").select("arc", F.when(F.col("whole"), F.col("points")).otherwise(F.col("thin")).alias("points"))
    return arcs.drop("points").join(chosen, "arc")


def _joined(arcs: DataFrame) -> DataFrame:
    """Rings from their arcs in order; where one ends the next begins, so that vertex is left out once."""
    way = F.when(F.col("forward"), F.col("points")).otherwise(F.reverse("points"))
    parts = arcs.select("zone", "ring", "area", F.struct("seq", way.alias("points")).alias("a")).groupBy("zone", "ring", "area").agg(F.sort_array(F.collect_list("a")).alias("a"))
    body = F.flatten(F.transform("a", lambda a: F.slice(a.points, F.lit(1), F.size(a.points) - 1)))
    points = F.concat(body, F.slice(body, F.lit(1), F.lit(1)))
    return parts.select("zone", "ring", "area", F.transform(points, lambda p: F.struct(p.col.cast("double").alias("lon"), p.row.cast("double").alias("lat"))).alias("coords"))


def polygons(rings: DataFrame) -> DataFrame:
    """zone, area and polygons, an array of polygons of rings of (lon, lat), the outer ring first. A zone's polygon is one value."""
    one = rings.groupBy("zone", "outer").agg(F.sum("area").alias("area"), F.sort_array(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), "ring", "coords"))).alias("r"))
    each = one.select("zone", "area", F.struct("outer", F.transform("r", lambda r: r.coords).alias("rings")).alias("p"))
    return each.groupBy("zone").agg(F.sum("area").alias("area"), F.transform(F.sort_array(F.collect_list("p")), lambda p: p.rings).alias("polygons"))
