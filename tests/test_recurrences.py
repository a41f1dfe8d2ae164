"""Relational rewrites against plain loops, and the invariants of the water balance."""

import heapq
import math
import random

import numpy as np
from pyspark.sql import functions as F

from ponding.functions import geo, hydro
from ponding.operators import grid, network, runoff, stats
from ponding.plans.runoff_queries import excess


def test_storage_is_the_loop(spark):
    n = 12
    g = grid.cells(spark, n)
    x, y = F.col("x"), F.col("y")
    got = {(r.row, r.col, r.lead): r.storage for r in grid.storage_balance(g, hydro.storm(F.col("t"), x, y), hydro.synthetic_imperviousness(x, y), hydro.drain_capacity(x, y)).collect()}
    for row in range(n):
        for col in range(n):
            px, py, s = col / (n - 1), row / (n - 1), 0.0
            for t in range(0, 181, 5):
                cx, cy = 0.15 + 0.7 * t / 180, 0.55 + 0.05 * math.sin(t / 40)
                rain = 6 + 145 * math.exp(-((px - cx) ** 2 + (py - cy) ** 2) / (2 * 0.22**2)) * math.exp(-(((t - 70) / 70) ** 2))
                imp = 0.78 - 0.3 * math.exp(-((px - 0.7) ** 2 + (py - 0.25) ** 2) / (2 * 0.08**2))
                cap = 32 - 24 * sum(math.exp(-((px - a) ** 2 + (py - b) ** 2) / (2 * 0.04**2)) for a, b in hydro.BLOCKED_DRAINS)
                s = max(0.0, s + (rain * imp - cap) * 5 / 60)
                if t % 15 == 0:
                    assert abs(got[row, col, t] - s) < 1e-9


def test_gaussian_is_separable_reflection(spark):
    n, sigma = 15, 1.2
    rng = np.random.default_rng(0)
    a = rng.random((n, n))
    df = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i in range(n) for j in range(n)], "row int, col int, v double")
    got = np.zeros((n, n))
    for r in grid.gaussian(df, n, sigma, "v", []).collect():
        got[r.row, r.col] = r.v
    w = np.exp(-0.5 * (np.arange(-5, 6) / sigma) ** 2)
    w /= w.sum()
    pad = np.pad(a, 5, mode="symmetric")
    rows = np.stack([np.convolve(line, w, "valid") for line in pad])
    want = np.stack([np.convolve(line, w, "valid") for line in rows.T]).T
    assert np.abs(got - want).max() < 1e-12


def catchments(spark, n=40):
    rng = random.Random(4)
    rows = [(i, i // 2 if i > 1 else None, rng.uniform(5, 60), rng.uniform(0.1, 0.9), rng.uniform(62, 90), rng.uniform(0.2, 4), rng.uniform(50, 1500), 0.4 if i % 9 == 0 else 0.0, rng.random(), rng.random()) for i in range(1, n)]
    return rows, spark.createDataFrame(rows, "id long, downstream long, area_ha double, imperv double, cn double, slope_pct double, length_m double, water_share double, x double, y double")


def test_runoff_chain(spark):
    rows, c = catchments(spark)
    ex, uh = excess(c), runoff.unit_hydrographs(c)
    e, u = {}, {}
    for r in ex.collect():
        e.setdefault(r.id, np.zeros(73))[r.step] = r.excess_mm
    for r in uh.collect():
        u.setdefault(r.id, {})[r.j] = r.q
    for r in ex.groupBy("id").agg(F.max("rain_mm").alias("rain"), F.max("runoff_mm").alias("runoff")).collect():
        assert 0 <= r.runoff <= r.rain
    q = {}
    for i, *_ in rows:
        ordinates = np.array([u[i].get(j, 0.0) for j in range(73)])
        area = next(r[2] for r in rows if r[0] == i)
        if len(u[i]) < 73:
            assert abs(ordinates.sum() * 300 - area * 10) < 1e-6 * area  # one mm over the area
        q[i] = np.convolve(e[i], ordinates)[:73]
    conv = runoff.convolve(ex, uh)
    for r in conv.collect():
        assert abs(r.q - q[r.id][r.step]) < 1e-9 * max(1, abs(r.q))
    # Routing: headwaters first, each passes on at most its capacity, later by the receiver's travel time.
    by = {r[0]: r for r in rows}
    acc = {i: (r[2], r[3] * r[2]) for i, r in by.items()}
    want = {}
    for i in sorted(by, reverse=True):
        area, imp = acc[i]
        cap = (0.3 + 0.6 * imp / area) * 40 * area / 360
        want[i] = (q[i].max(), cap, np.maximum(q[i] - cap, 0).sum() * 300)
        d = by[i][1]
        if d is not None:
            shift = round(by[d][6] / 60 / 5)
            sent = np.minimum(q[i], cap)
            q[d][shift:] += sent[: 73 - shift]
            acc[d] = (acc[d][0] + area, acc[d][1] + imp)
    for r in runoff.cascade(c, conv).collect():
        assert np.allclose((r.peak_m3s, r.capacity_m3s, r.overflow_m3), want[r.id], rtol=1e-9, atol=1e-9)


def test_strahler(spark):
    links = [(1, 3), (2, 3), (3, 6), (4, 6), (5, 7), (6, 7), (7, None), (8, 9), (9, None)]
    got = {r.id: r.strahler for r in runoff.strahler(spark.createDataFrame(links, "id long, downstream long")).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 2, 8: 1, 9: 1}


def plain_strahler(links):
    ups = {}
    for i, d in links:
        ups.setdefault(d, []).append(i)
    order = {}

    def visit(i):
        above = sorted((visit(u) for u in ups.get(i, ())), reverse=True)
        order[i] = 1 if not above else above[0] + (len(above) > 1 and above[0] == above[1])
        return order[i]

    for i in ups.get(None, ()):
        visit(i)
    return order


def test_strahler_of_long_chains_and_random_forests(spark):
    """Two headwaters meet, then a chain of 200 links; and a forest of 300 links."""
    chain = [(-1, 0), (-2, 0), *[(k, k + 1) for k in range(200)], (200, None)]
    rng = random.Random(3)
    forest = [(i, rng.randrange(i) + 1000 if i else None) for i in range(300)]
    forest = [(i + 1000, d) for i, d in forest]
    links = chain + forest
    got = {r.id: r.strahler for r in runoff.strahler(spark.createDataFrame(links, "id long, downstream long")).collect()}
    assert got == plain_strahler(links) and got[200] == 2


def test_depressions_fill_to_the_spill_level(spark):
    n = 12
    rng = random.Random(7)
    z = {(i, j): float(rng.randrange(100)) for i in range(n) for j in range(n)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in z.items()], "row int, col int, z double")
    got, small = ({(r.row, r.col): r.w for r in grid.fill_depressions(df, n, tile=t).collect()} for t in (64, 5))
    assert got == small
    level = {p: v for p, v in z.items() if p[0] in (0, n - 1) or p[1] in (0, n - 1)}
    heap = [(v, p) for p, v in level.items()]
    heapq.heapify(heap)
    while heap:
        v, (i, j) = heapq.heappop(heap)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                p = (i + a, j + b)
                if p in z and p not in level:
                    level[p] = max(z[p], v)
                    heapq.heappush(heap, (level[p], p))
    assert got == level


def test_nearest_fill(spark):
    """Against all distances: gaps of any shape, ties, and a table without a filled cell."""
    rng = random.Random(11)
    for n, share in ((8, 0.03), (14, 0.1), (9, 0.5)):
        filled = {(i, j): float(i * 100 + j) for i in range(n) for j in range(n) if rng.random() < share} or {(5, 5): 1.0, (0, 6): 2.0}
        df = spark.createDataFrame([(i, j, filled.get((i, j))) for i in range(n) for j in range(n)], "row int, col int, z double")
        got = {(r.row, r.col): r.z for r in grid.fill_nearest(df).collect()}
        assert got == {(i, j): filled[min(filled, key=lambda p: ((p[0] - i) ** 2 + (p[1] - j) ** 2, p))] for i in range(n) for j in range(n)}
    none = spark.createDataFrame([(0, 0, None), (0, 1, None)], "row int, col int, z double")
    assert [r.z for r in grid.fill_nearest(none).collect()] == [None, None]


def test_chunks(spark):
    pts = [(77.6 + 0.001 * i, 12.9 + 0.0005 * (i % 3)) for i in range(12)]
    df = spark.createDataFrame([(1, [{"lon": a, "lat": b} for a, b in pts])], "id long, coords array<struct<lon: double, lat: double>>")
    got = df.select(network.chunk_points(F.col("coords"), 260.0).alias("c")).first().c
    want, piece, m = [], [pts[0]], 0.0
    for p in pts[1:]:
        a = piece[-1]
        m += math.hypot((p[0] - a[0]) * 111_320 * math.cos(math.radians((a[1] + p[1]) / 2)), (p[1] - a[1]) * 110_570)
        piece.append(p)
        if m >= 260:
            want.append(piece)
            piece, m = [p], 0.0
    if len(piece) > 1:
        want.append(piece)
    assert [[(q.lon, q.lat) for q in x] for x in got] == want


def test_network_and_route(spark):
    line = lambda *p: [{"lon": 77.6 + 0.001 * a, "lat": 12.9 + 0.001 * b} for a, b in p]
    pieces = spark.createDataFrame([("main", 1, line((0, 0), (1, 0), (2, 0))), ("loop", 2, line((0, 0), (0, 2), (2, 2), (2, 0))), ("dot", 3, line((5, 5), (5.01, 5)))], "name string, ord long, coords array<struct<lon: double, lat: double>>")
    e = network.build_network(pieces, 12.9)
    assert e.count() == 4 and network.nodes_of(e).count() == 2
    flat = spark.createDataFrame([(0, 1, 100.0, 50.0), (1, 2, 100.0, 0.0), (0, 3, 150.0, 5.0), (3, 2, 150.0, 0.0)], "u long, v long, length_m double, depth_cm double")
    normal = network.distances(flat.withColumn("w", F.col("length_m")), F.lit(0))
    safe = network.distances(network.passable(flat, 30.0), F.lit(0))
    nodes = lambda best, to: [r.node for r in network.path_to(best, to).orderBy("cost").collect()]
    assert nodes(normal, 2) == [0, 1, 2] and nodes(safe, 2) == [0, 3, 2] and nodes(safe, 9) == [] and nodes(safe, 0) == [0]
    both = network.compare_routes(flat, 0, 2, 30.0).first()
    assert (both.normal_m, both.blocked, both.max_depth_cm, both.safe_m, both.extra_m, both.message) == (200.0, 1, 50.0, 300.0, 100.0, "keeps clear of 1 flooded stretches, 100 m longer")
    assert network.compare_routes(flat, 0, 0, 30.0).first().message == "both ends are at one junction"
    assert network.compare_routes(flat, 2, 0, 30.0).first().message == "no way between these points"
    assert network.compare_routes(flat, 0, 2, 2.0).first().message == "no passable way"
    two = flat.union(spark.createDataFrame([(10, 11, 1.0, 0.0)], flat.schema))
    assert network.largest_component(two).count() == 4
    assert {r.node: r.cost for r in safe.collect()}[2] == 150 * (1 + 5 / 30) + 150


def test_functions(spark):
    r = spark.range(1).select(
        geo.utm(F.lit(13.0), F.lit(80.0), 44).alias("u"),
        hydro.scs_runoff(F.lit(100.0), F.lit(80.0)).alias("q"),
        hydro.piecewise(F.lit(10.0), hydro.OPACITY).alias("o"),
        hydro.lowness(F.lit(float("nan")), F.lit(0.0)).alias("low"),
        hydro.bounded_number(F.lit("abc"), 0, 1).alias("none"),
        F.sqrt(geo.segment_distance_sq(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).alias("d"),
        stats.normal_tail(F.lit(1.96)).alias("p"),
    ).first()
    assert abs(r.u.easting - 391_600) < 300 and abs(r.u.northing - 1_437_300) < 300
    assert abs(r.q - (100 - 12.7) ** 2 / (100 + 0.8 * 63.5)) < 1e-9
    assert abs(r.o - 0.575) < 1e-12 and r.none is None and r.d == 1.0 and abs(r.p - 0.0249979) < 1e-6
    assert abs(r.low - (math.exp(-12) + 0.25)) < 1e-12


def test_path_of_a_long_chain(spark):
    best = spark.createDataFrame([(k, float(k), k - 1 if k else None) for k in range(150)] + [(900, 3.5, 3)], "node long, cost double, prev long")
    assert [r.node for r in network.path_to(best, 100).orderBy("cost").collect()] == list(range(101))


def dem(spark, n):
    """A bumpy slope."""
    c = grid.cells(spark, n)
    return c.select("row", "col", (F.col("row") * n + F.col("col")).cast("long").alias("cell"), ((F.col("row") * 37 + F.col("col") * 11) % 101 + 30 * ((n - F.col("row")) + F.abs(F.col("col") - n // 2))).cast("double").alias("z"))


def test_streams_and_valleys(spark):
    """Links, their orders and both heights against plain walks."""
    from ponding.operators import streams
    n = 30
    cells = [(r.cell, r.z) for r in dem(spark, n).select("cell", "z").collect()]
    z = dict(cells)
    flow_df = grid.settle(grid.receivers(grid.flow_direction(dem(spark, n)), n))
    flow = {r.cell: r.rec for r in flow_df.collect()}
    acc = dict.fromkeys(flow, 0)
    for c in flow:
        at = c
        acc[at] += 1
        while flow[at] != at:
            at = flow[at]
            acc[at] += 1
    river = {c for c, a in acc.items() if a >= 6}
    inflow = {c: sum(flow[d] == c and d != c for d in river) for c in river}
    ends = {c for c in river if flow[c] == c or flow[c] not in river or inflow[flow[c]] >= 2}

    def walk(c, stop):
        while c not in stop and flow[c] != c:
            c = flow[c]
        return c

    linked = streams.links_of(streams.stream_cells(flow_df, grid.accumulate(flow_df), 6))
    assert {r.cell: (r.inflow, r.terminal, r.link) for r in linked.collect()} == {c: (inflow[c], c in ends, walk(c, ends)) for c in river}
    heights = dem(spark, n).select("cell", "z")
    links = {r.link: r for r in streams.stream_links(linked, heights, n, 10.0).collect()}
    down = {e: walk(flow[e], ends) if flow[e] != e and flow[e] in river else None for e in ends}
    order = plain_strahler(list(down.items()))
    assert {k: (r.downstream, r.strahler) for k, r in links.items()} == {e: (down[e], order[e]) for e in ends}
    for r in links.values():
        own = sorted((c for c in river if walk(c, ends) == r.link), key=acc.get)
        assert [p.row * n + p.col for p in r.line] == own + ([flow[r.link]] if down[r.link] is not None else [])
        assert r.drop_m == z[own[0]] - z[own[-1]] and r.cells == len(own)
    major = [c for c in river if order[walk(c, ends)] >= 2]
    for stop, only in ((river, None), (set(major), spark.createDataFrame([(c,) for c in major], "cell long"))):
        got = {r.cell: (r.link, r.hand) for r in streams.catchments(flow_df, linked, heights, only).collect()}
        assert got == {c: (walk(t, ends), max(z[c] - z[t], 0.0)) if (t := walk(c, stop)) in stop else (None, None) for c in flow}
