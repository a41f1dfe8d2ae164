"""Corridor networks: clip, chunk, snap, sample, compare parallel edges, routes, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ponding.functions.geo import cell_of, flat_distance, snap_key
from ponding.operators.grid import drop, settle


def clip_runs(lines: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """lines: id, coords. Runs of at least two vertices inside the box, in order; nothing is cut at the border."""
    v = lines.select("id", F.posexplode("coords").alias("pos", "c")).withColumn("inside", F.col("c.lon").between(west, east) & F.col("c.lat").between(south, north))
    island = F.sum((~F.col("inside")).cast("int")).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    runs = v.withColumn("run", island).where("inside").groupBy("id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("v")).where(F.size("v") >= 2)
    return runs.select("id", F.get("v", F.lit(0)).pos.alias("first"), F.transform("v", lambda x: x.c).alias("coords"))


def chunk_points(coords: Column, target_m: float) -> Column:
    """Cuts a polyline into pieces of at least target_m; the counter starts anew at the cut vertex, which both pieces share.

    A fold over the vertices: what is done, the open piece, and its length so far.
    """
    kind = "struct<done: array<array<struct<lon: double, lat: double>>>, piece: array<struct<lon: double, lat: double>>, m: double>"
    start = F.struct(F.array().cast("array<array<struct<lon: double, lat: double>>>").alias("done"), F.slice(coords, 1, 1).alias("piece"), F.lit(0.0).alias("m")).cast(kind)

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc.piece, -1)
        m = acc.m + flat_distance(last.lon, last.lat, c.lon, c.lat)
        piece = F.concat(acc.piece, F.array(c))
        full = m >= target_m
        return F.struct(F.when(full, F.concat(acc.done, F.array(piece))).otherwise(acc.done).alias("done"), F.when(full, F.array(c)).otherwise(piece).alias("piece"), F.when(full, F.lit(0.0)).otherwise(m).alias("m")).cast(kind)

    return F.aggregate(F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0))), start, step, lambda acc: F.when(F.size(acc.piece) > 1, F.concat(acc.done, F.array(acc.piece))).otherwise(acc.done))


def build_network(pieces: DataFrame, lat0: float, snap_m: float = 25.0, least_m: float = 15.0) -> DataFrame:
    """pieces: name, ord, coords. Directed edges between snapped ends, each both ways: u, v (keys), length_m, name, coords."""
    a, b = F.element_at("coords", 1), F.element_at("coords", -1)
    n = F.size("coords")
    steps = F.zip_with(F.slice("coords", F.lit(1), n - 1), F.slice("coords", F.lit(2), n - 1), lambda p, q: flat_distance(p.lon, p.lat, q.lon, q.lat))
    e = pieces.where(n >= 2).select("name", "ord", "coords", snap_key(a.lon, a.lat, lat0, snap_m).alias("u"), snap_key(b.lon, b.lat, lat0, snap_m).alias("v"), F.aggregate(steps, F.lit(0.0), lambda s, x: s + x).alias("length_m"))
    e = e.where((F.col("length_m") >= least_m) & (F.col("u") != F.col("v")))
    back = e.select("name", "ord", F.reverse("coords").alias("coords"), F.col("v").alias("u"), F.col("u").alias("v"), "length_m")
    return e.unionByName(back)


def nodes_of(edges: DataFrame) -> DataFrame:
    """Node keys with the place of the first edge end that fell there."""
    ends = edges.select(F.col("u").alias("node"), "ord", F.element_at("coords", 1).alias("c"))
    return ends.groupBy("node").agg(F.min_by("c", F.struct("ord", "c")).alias("c")).select("node", "c.lon", "c.lat")


def summary(edges: DataFrame) -> DataFrame:
    """Distinct corridors, segments (each edge stands for two directions) and km by name, and in all."""
    return edges.rollup("name").agg(F.count_distinct("ord").alias("pieces"), F.floor(F.count(F.lit(1)) / 2).alias("segments"), (F.sum("length_m") / 2000).alias("km"))


def edge_cells(edges: DataFrame, west: float, south: float, east: float, north: float, step_m: float = 6.0, n: int = 240) -> DataFrame:
    """Which cells each edge crosses, each cell once. Independent of any depth."""
    return edge_points(edges, west, south, east, north, step_m, n).distinct()


def edge_points(edges: DataFrame, west: float, south: float, east: float, north: float, step_m: float = 6.0, n: int = 240) -> DataFrame:
    """eid, row, col of points at k/n of every segment, at most step_m apart, and of the last vertex: a cell for each point. Nothing is shuffled."""
    size = F.size("coords")
    segs = edges.select("eid", F.posexplode(F.zip_with(F.slice("coords", F.lit(1), size - 1), F.slice("coords", F.lit(2), size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "s"), (size - 2).alias("last"))
    parts = F.greatest(F.lit(1), F.ceil(flat_distance(F.col("s.a.lon"), F.col("s.a.lat"), F.col("s.b.lon"), F.col("s.b.lat"), 111_320.0) / step_m)).cast("int")
    pts = segs.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - F.when(F.col("k") == F.col("last"), 0).otherwise(1))))
    t = F.col("i") / F.col("parts")
    lon, lat = F.col("s.a.lon") + (F.col("s.b.lon") - F.col("s.a.lon")) * t, F.col("s.a.lat") + (F.col("s.b.lat") - F.col("s.a.lat")) * t
    at = cell_of(lat, lon, F.lit(west), F.lit(south), F.lit(east), F.lit(north), n)
    return pts.select("eid", at.alias("at")).select("eid", "at.row", "at.col")


def edge_depths(bridge: DataFrame, cube: DataFrame) -> DataFrame:
    """Deepest water on each edge at each lead; only the join depends on the cube. A bridge may name a cell of an edge more than once."""
    return bridge.join(cube, ["row", "col"]).groupBy("eid", "lead").agg(F.max("depth_cm").alias("depth_cm"))


def first_of_pair(edges: DataFrame) -> DataFrame:
    """Of edges between the same two nodes, either way, the first."""
    w = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("eid", "name")
    return edges.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def shortest_parallel(edges: DataFrame) -> DataFrame:
    """The shortest of parallel directed edges (ties: the first)."""
    best = edges.groupBy("u", "v").agg(F.min(F.struct("length_m", "eid")).alias("b"))
    return best.select("u", "v", F.col("b.length_m").alias("length_m"), F.col("b.eid").alias("eid"))


def distances(edges: DataFrame, source: Column) -> DataFrame:
    """Bellman-Ford over (u, v, w), w not negative: node, cost and the node before it on a cheapest path from the source.

    Only nodes that improved are expanded, two edges far in each round, until none improves.
    """
    e = settle(edges.select("u", "v", "w"))
    best = settle(e.sparkSession.range(1).select(source.cast("long").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("prev")))
    front = best
    while True:
        first = front.join(e, front.node == e.u).select(F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("u").alias("prev"))
        first = first.groupBy("node").agg(F.min(F.struct("cost", "prev")).alias("o")).select("node", "o.cost", "o.prev")
        second = first.join(e, first.node == e.u).select(F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("u").alias("prev"))
        offer = first.unionByName(second).groupBy("node").agg(F.min(F.struct("cost", "prev")).alias("o"))
        both = best.join(offer, "node", "full")
        better = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o.cost") < F.col("cost")))
        new = settle(both.select("node", F.when(better, F.col("o.cost")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("o.prev")).otherwise(F.col("prev")).alias("prev"), better.alias("new")))
        drop(best)
        best, front = new.drop("new"), new.where("new").drop("new")
        best.stored_at = new.stored_at
        if not front.limit(1).count():
            return best


def path_to(best: DataFrame, target: int) -> DataFrame:
    """node, cost and prev of the cheapest path to the target, to be read by cost; no rows where there is none.

    The nodes before it are found by doubling: with all within k steps and each node's k-th
    predecessor, the next round has all within 2 k.
    """
    jump = settle(best.where(F.col("cost").isNotNull() & F.col("prev").isNotNull()).select("node", F.col("prev").alias("to")))
    path = settle(best.where((F.col("node") == target) & F.col("cost").isNotNull()).select("node"))
    while True:
        more = path.join(jump, "node").select(F.col("to").alias("node"))
        grown = settle(path.union(more).distinct())
        if grown.count() == path.count():
            return best.join(grown, "node", "left_semi")
        drop(path)
        path = grown
        further = settle(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("to2")), "to").select("node", F.col("to2").alias("to")))
        drop(jump)
        jump = further


def path_profile(path: DataFrame, edges: DataFrame, threshold_cm: float) -> DataFrame:
    """One row for a path (of :func:`path_to`): its length, deepest water, edges, and those at the threshold or deeper. edges: u, v, length_m, depth_cm, one per pair."""
    steps = path.where(F.col("prev").isNotNull()).select(F.col("prev").alias("u"), F.col("node").alias("v")).join(edges, ["u", "v"])
    return steps.agg(F.count(F.lit(1)).alias("edges"), F.sum("length_m").alias("length_m"), F.max("depth_cm").alias("max_depth_cm"), F.count_if(F.col("depth_cm") >= threshold_cm).alias("blocked"))


def ranked(path: DataFrame) -> DataFrame:
    """Adds rank, the edges from the source to each node of a path (of :func:`path_to`), by doubling along the nodes before."""
    steps = settle(path.select("node", F.col("prev").alias("to"), F.col("prev").isNotNull().cast("long").alias("rank")))
    while steps.where("to is not null").limit(1).count():
        ahead = steps.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("more"))
        new = settle(steps.join(ahead, "to", "left").select("node", F.col("to2").alias("to"), (F.col("rank") + F.coalesce("more", F.lit(0).cast("long"))).alias("rank")))
        drop(steps)
        steps = new
    return path.join(steps.select("node", "rank"), "node")


def path_edges(path: DataFrame, edges: DataFrame) -> DataFrame:
    """rank (from 1) and the path's edges in order. edges: u, v and others, one per pair."""
    return ranked(path).where(F.col("prev").isNotNull()).select("rank", F.col("prev").alias("u"), F.col("node").alias("v")).join(edges, ["u", "v"])


def joined_line() -> tuple[Column, Column]:
    """Aggregates edges (rank, coords) to one line: the coordinates in order, a vertex where two edges meet once. The second: what to select after."""
    gathered = F.sort_array(F.collect_list(F.struct("rank", "coords"))).alias("line")
    first = F.slice(F.get(F.transform("line", lambda e: e.coords), F.lit(0)), F.lit(1), F.lit(1))
    rest = F.flatten(F.transform("line", lambda e: F.slice(e.coords, F.lit(2), F.size(e.coords))))
    return gathered, F.concat(first, rest).alias("coords")


def path_lines(path: DataFrame, edges: DataFrame, threshold_cm: float) -> DataFrame:
    """kind, first, last (ranks), length_m, max_depth_cm, coords: the whole path (kind "way"), and each stretch of it in a row at the threshold or deeper ("blocked").

    edges: u, v, length_m, depth_cm, coords. A way's line is one value; without a way there are no rows.
    """
    e = settle(path_edges(path, edges))
    # Edges of a stretch keep the same distance to their number among blocked ones. A path is one sequence, ranked already.
    numbered = e.where(F.col("depth_cm") >= threshold_cm).withColumn("stretch", F.col("rank") - F.row_number().over(Window.orderBy("rank")))
    parts = e.select("*", F.lit("way").alias("kind"), F.lit(0).cast("long").alias("stretch")).unionByName(numbered.select(*e.columns, F.lit("blocked").alias("kind"), F.col("stretch").cast("long").alias("stretch")))
    gathered, line = joined_line()
    out = parts.groupBy("kind", "stretch").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("length_m").alias("length_m"), F.max("depth_cm").alias("max_depth_cm"), gathered)
    return out.select("kind", "first", "last", "length_m", "max_depth_cm", line)


def compare_routes(edges: DataFrame, source: int, target: int, threshold_cm: float) -> DataFrame:
    """One row: the shortest way and the passable one, how much longer it is, and what to tell the driver.

    edges: u, v, length_m, depth_cm. Without any way, or with both ends at one node, the
    message says so and the rest is null.
    """
    one = edges.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(target).alias("target"))
    if source == target:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("normal_m", "double"), ("normal_edges", "long"), ("max_depth_cm", "double"), ("blocked", "long"), ("safe_m", "double"), ("extra_m", "double"))]
        return one.select(*nothing, F.lit("both ends are at one junction").alias("message"))
    ways = []
    for name, usable in (("normal", edges.withColumn("w", F.col("length_m"))), ("safe", passable(edges, threshold_cm))):
        best = distances(usable.groupBy("u", "v").agg(F.min("w").alias("w")), F.lit(source))
        profile = path_profile(path_to(best, target), edges, threshold_cm)
        ways.append(profile.select(F.col("edges").alias(f"{name}_edges"), F.col("length_m").alias(f"{name}_m"), F.col("max_depth_cm").alias(f"{name}_depth"), F.col("blocked").alias(f"{name}_blocked")))
    both = one.crossJoin(F.broadcast(ways[0])).crossJoin(F.broadcast(ways[1]))  # one row each
    deep = F.col("normal_depth") >= threshold_cm
    around = F.format_string("keeps clear of %d flooded stretches, %.0f m longer", F.col("normal_blocked"), F.col("safe_m") - F.col("normal_m"))
    message = F.when(F.col("normal_m").isNull(), "no way between these points").when(~deep, "the normal way is passable").when(F.col("safe_m").isNull(), "no passable way").otherwise(around)
    return both.select("normal_m", "normal_edges", F.col("normal_depth").alias("max_depth_cm"), F.col("normal_blocked").alias("blocked"), "safe_m", (F.col("safe_m") - F.col("normal_m")).alias("extra_m"), message.alias("message"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges between nodes of the component with most nodes (ties: the smallest label)."""
    labels = components(edges)
    top = labels.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(1).select("comp")
    inside = labels.join(F.broadcast(top), "comp").select(F.col("node").alias("u"))
    return edges.join(inside, "u", "left_semi")


def passable(edges: DataFrame, threshold_cm: float) -> DataFrame:
    """Edges that a vehicle passes, longer the deeper they are under water. edges: u, v, length_m, depth_cm."""
    return edges.where(F.col("depth_cm") < threshold_cm).withColumn("w", F.col("length_m") * (1 + F.col("depth_cm") / threshold_cm))


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable either way."""
    both = settle(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = settle(labels.join(up, "comp").join(near, "node").select("node", F.least("up", "near").alias("comp"), F.col("comp").alias("old")))
        labels = new.select("node", "comp")
        if not new.where("comp <> old").limit(1).count():
            return labels
