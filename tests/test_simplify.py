import random

from ponding.operators import network, simplify


def test_lines(spark):
    rng = random.Random(2)
    pts = [{"lon": 0.01 * i, "lat": rng.choice([0.0, 1e-6, 0.02])} for i in range(60)]
    df = spark.createDataFrame([(1, pts, 1e-5), (2, pts[:2], 1e-5), (3, [], 1e-5)], "id long, coords array<struct<lon: double, lat: double>>, tolerance double")
    got = {r.id: [(c.lon, c.lat) for c in r.coords] for r in simplify.simplify(df).collect()}
    assert got[2] == [(p["lon"], p["lat"]) for p in pts[:2]] and got[3] == []
    assert got[1][0] == (pts[0]["lon"], pts[0]["lat"]) and 2 < len(got[1]) < 60
    assert all((p["lon"], p["lat"]) in got[1] for a, p, b in zip(pts, pts[1:], pts[2:]) if p["lat"] == 0.02 and a["lat"] < 0.01 and b["lat"] < 0.01)


def test_rasters(spark):
    line = spark.createDataFrame([([{"lon": 0.5, "lat": 0.5}, {"lon": 3.5, "lat": 0.5}], 4.0), ([{"lon": 2.5, "lat": 0.5}, {"lon": 2.5, "lat": 2.5}], 9.0)], "coords array<struct<lon: double, lat: double>>, depth double")
    assert {(r.row, r.col): r.depth for r in simplify.rasterise_lines(line, "depth", 5).collect()} == {(0, 0): 4.0, (0, 1): 4.0, (0, 2): 9.0, (0, 3): 4.0, (1, 2): 9.0, (2, 2): 9.0}
    ring = lambda a, b: [{"lon": float(x), "lat": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    poly = spark.createDataFrame([(1, ring(0, 4), 1), (1, ring(1, 3), 1)], "id long, coords array<struct<lon: double, lat: double>>, v int")
    cells = {(r.row, r.col) for r in simplify.rasterise_polygons(poly, "v", 10).collect()}
    assert cells == {(i, j) for i in range(4) for j in range(4)} - {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_lattice(spark):
    e = simplify.lattice(spark, 6)
    assert 45 <= e.count() <= 60
    comp = network.components(e)
    assert comp.groupBy("comp").count().agg({"count": "max"}).first()[0] >= 30


def test_every_touched_cell(spark):
    """Against a test of each cell: does it, with its north and west sides, hold a point of a segment?"""
    from fractions import Fraction

    rng, n, rows = random.Random(9), 12, []
    for _ in range(60):  # quarters, so that many lines run through corners and along sides
        rows.append([(Fraction(rng.randint(-8, 56), 4), Fraction(rng.randint(-8, 56), 4)) for _ in range(rng.choice([2, 2, 3]))])

    def touches(a, b, r, c):
        lo, hi, lo_open, hi_open = Fraction(0), Fraction(1), False, False
        for p, d, k in ((a[0], b[0] - a[0], c), (a[1], b[1] - a[1], r)):
            if d == 0:
                if not k <= p < k + 1:
                    return False
                continue
            t0, t1 = (k - p) / d, (k + 1 - p) / d  # the first is reached, the second is not
            first, last = ((t0, False), (t1, True)) if d > 0 else ((t1, True), (t0, False))
            if first[0] > lo or (first[0] == lo and first[1]):
                lo, lo_open = first
            if last[0] < hi or (last[0] == hi and last[1]):
                hi, hi_open = last
        return lo < hi or (lo == hi and not lo_open and not hi_open)

    for k, line in enumerate(rows):
        frame = spark.createDataFrame([(float(k), [(float(x), float(y)) for x, y in line])], "depth double, coords array<struct<lon:double,lat:double>>")
        rows[k] = (frame, {(r, c): float(k) for r in range(n) for c in range(n) if any(touches(a, b, r, c) for a, b in zip(line, line[1:]))})
    frames, want = [f for f, _ in rows], {}
    for _, cells in rows:
        for x, d in cells.items():
            want[x] = max(d, want.get(x, -1.0))
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    assert {(r.row, r.col): r.depth for r in simplify.rasterise_lines(whole, "depth", n).collect()} == want
