"""Zones as polygons, against a plain tracer."""

import numpy as np
import pytest

from ponding.operators import zones


def traced(z):
    """Rings of each zone by walking along its border with the zone on the right, turning right where that is possible."""
    n, m = z.shape
    has = lambda r, c, v: 0 <= r < n and 0 <= c < m and z[r, c] == v
    step = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    out = {}
    for v in np.unique(z[z >= 0]):
        edges = {}
        for r in range(n):
            for c in range(m):
                if z[r, c] == v:
                    for way, (a, b), start in ((0, (-1, 0), (r, c)), (1, (0, 1), (r, c + 1)), (2, (1, 0), (r + 1, c + 1)), (3, (0, -1), (r + 1, c))):
                        if not has(r + a, c + b, v):
                            edges.setdefault(start, set()).add(way)
        rings = []
        while edges:
            at = min(edges)
            way, ring, first = min(edges[at]), [], None
            while (at, way) != first:
                first = first or (at, way)
                edges[at].discard(way)
                if not edges[at]:
                    del edges[at]
                ring.append((at, way))
                at = (at[0] + step[way][0], at[1] + step[way][1])
                options = edges.get(at, set()) | ({first[1]} if at == first[0] else set())
                way = next(w for w in ((way + 1) % 4, way, (way + 3) % 4) if w in options)
            rings.append(ring)
        out[int(v)] = [[p for (p, w), (_, before) in zip(ring, ring[-1:] + ring[:-1]) if w != before] for ring in rings]
    return out


def corners(coords):
    """Without the vertices at which a ring goes straight on."""
    p = [(int(c.lat), int(c.lon)) for c in coords[:-1]]
    keep = [q for a, q, b in zip(p[-1:] + p[:-1], p, p[1:] + p[:1]) if (q[0] - a[0]) * (b[1] - q[1]) != (q[1] - a[1]) * (b[0] - q[0])]
    k = keep.index(min(keep))
    return tuple(keep[k:] + keep[:k])


def start(ring):
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


def area(p):
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(p, p[1:] + p[:1])) / 2


def inside(point, ring):
    r, c = point
    return sum((a[0] > r) != (b[0] > r) and c < a[1] + (r - a[0]) / (b[0] - a[0]) * (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def grid_of(seed, n=17, kinds=3):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, kinds, (n, n))
    z[2:9, 2:9] = 7  # a block with holes, one of them with an island, and two that touch at a corner
    z[3:8, 3:6] = 1
    z[5, 4] = 7
    z[3, 7], z[4, 6] = 2, 2
    z[14:, :3] = -1  # no zone
    return z


def frame(spark, z):
    rows = [(int(r), int(c), int(z[r, c]) if z[r, c] >= 0 else None) for r in range(len(z)) for c in range(z.shape[1]) if (r, c) != (16, 0)]
    return spark.createDataFrame(rows, "row int, col int, zone long").repartition(5)


@pytest.mark.parametrize("seed, kinds", [(1, 3), (2, 2)])
def test_rings_of_random_grids(spark, seed, kinds):
    z = grid_of(seed, kinds=kinds)
    got = zones.vectorise(frame(spark, z)).collect()
    want = traced(z)
    for v, rings in want.items():
        own = [r for r in got if r.zone == v]
        assert sorted(corners(r.coords) for r in own) == sorted(start(r) for r in rings)
        assert sum(r.area for r in own) == (z == v).sum()
    by = {r.ring: r for r in got}
    for r in got:
        ring = [(p.lat, p.lon) for p in r.coords[:-1]]
        assert area(ring) == r.area
        if r.area > 0:
            assert r.outer == r.ring
        else:  # the smallest outer ring of the zone around it
            r0, c0 = min((p.lat, p.lon) for p in r.coords)
            around = [o for o in got if o.zone == r.zone and o.area > 0 and inside((r0 - 0.5, c0 + 0.5), [(p.lat, p.lon) for p in o.coords[:-1]])]
            assert by[r.outer].ring == min(around, key=lambda o: o.area).ring
    shapes = {r.zone: r for r in zones.polygons(zones.vectorise(frame(spark, z))).collect()}
    assert {v: s.area for v, s in shapes.items()} == {v: (z == v).sum() for v in want}
    assert all(sum(len(p) for p in shapes[v].polygons) == len(want[v]) for v in want)


def test_shared_borders_stay_shared(spark):
    """After simplifying, every stretch of border inside the area is in two rings, once each way, and areas still add up."""
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 40, (9, 2))
    rr, cc = np.mgrid[:40, :40]
    z = ((rr[..., None] - seeds[:, 0]) ** 2 + (cc[..., None] - seeds[:, 1]) ** 2).argmin(-1)
    z[10, 10], z[30:33, 20] = 50, 51  # a cell and a bar that would collapse
    df = spark.createDataFrame([(int(r), int(c), int(z[r, c])) for r in range(40) for c in range(40)], "row int, col int, zone long")
    full, thin = zones.vectorise(df).collect(), zones.vectorise(df, tolerance=0.8).collect()
    assert {(r.zone, r.ring, r.outer, r.area) for r in full} == {(r.zone, r.ring, r.outer, r.area) for r in thin}
    assert sum(len(r.coords) for r in thin) < 0.6 * sum(len(r.coords) for r in full)
    edges = {}
    for r in thin:
        p = [(c.lat, c.lon) for c in r.coords]
        assert p[0] == p[-1] and len(p) >= 4 and area(p[:-1]) * r.area > 0
        for a, b in zip(p, p[1:]):
            assert (a, b) not in edges
            edges[a, b] = r.zone
    rim = {0, 40}
    lone = [(a, b) for a, b in edges if (b, a) not in edges]
    assert all((a[0] == b[0] and a[0] in rim) or (a[1] == b[1] and a[1] in rim) for a, b in lone)
    assert sum(area([(c.lat, c.lon) for c in r.coords[:-1]]) for r in thin) == 1600


def test_no_zones(spark):
    assert zones.vectorise(spark.createDataFrame([], "row int, col int, zone long")).collect() == []
    one = zones.vectorise(spark.createDataFrame([(5, 6, 3)], "row int, col int, zone long"), tolerance=0.8).collect()
    assert [(r.zone, r.area, len(r.coords)) for r in one] == [(3, 1.0, 5)]


@pytest.mark.parametrize("tolerance", [None, 0.8])
def test_tiles_make_no_difference(spark, tolerance):
    """Rings within a tile and rings over many tiles, with zones that need all 64 bits and cells left of and above the first."""
    z = grid_of(3, kinds=2)
    rows = [(r - 7, c - 3, int(z[r, c]) - (1 << 62)) for r in range(len(z)) for c in range(z.shape[1]) if z[r, c] >= 0]
    df = spark.createDataFrame(rows, "row int, col int, zone long").repartition(3)
    whole, small = ({(r.zone, r.ring, r.outer, r.area, tuple(r.coords)) for r in zones.vectorise(df, tolerance=tolerance, tile=t).collect()} for t in (64, 3))
    assert whole == small and {r[0] for r in whole} == {int(v) - (1 << 62) for v in np.unique(z[z >= 0])}


def test_rings_come_in_batches(spark, monkeypatch):
    """No call of Python for each ring, and rings within a tile take no part in the rounds."""
    seen, keep = [], zones.settle
    monkeypatch.setattr(zones, "settle", lambda df: (seen.append((df._jdf.queryExecution().executedPlan().toString(), out := keep(df), out.count())), out)[1])
    df = spark.createDataFrame([(r, c, r // 4 * 20 + c // 4) for r in range(70) for c in range(60)], "row int, col int, zone long")
    assert len(zones.vectorise(df).collect()) == 18 * 15
    assert not any("FlatMapGroupsInPandas [ring" in plan for plan, _, _ in seen)
    # One row of zones lies across the border of two tiles: two pieces each do not make rounds of all 1,080 sides or more.
    rounds = [n for _, out, n in seen if "to" in out.columns]
    assert rounds and max(rounds) <= 2 * 15
    assert [r.area for r in zones.vectorise(df).where("zone = 320").collect()] == [16.0]


def test_pieces_of_a_ring_that_batches_cut():
    """Rings whose rows are cut by batches come out whole, a long one over many batches too."""
    import pyarrow as pa

    square = lambda k, n: [(k, k, s, s + 1 if s + 1 < k + n else k, s, [((s - k) << 33) + (k << 2)] + ([((n - 1) << 33) + ((k + 5) << 2)] if s + 1 == k + n else [])) for s in range(k, k + n)]
    rows = square(0, 3) + square(10, 9) + square(30, 4)
    names = ["zone", "ring", "start", "next", "least", "points"]
    table = pa.table({k: list(v) for k, v in zip(names, zip(*rows))})
    want = None
    for size in (1, 2, 5, 100):
        got = [r for b in zones._closed(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        want = want or got
        assert got == want and [(r["ring"], len(r["points"])) for r in got] == [(0, 4), (10, 10), (30, 5)]
