"""Queries over whole tables and the whole grid, which have no SQL, against plain loops."""

import math

import duckdb
import numpy as np

from ponding.functions import hydro
from ponding.operators import flats, grid, stats
from ponding.plans import QUERIES
from ponding.plans.domain import CONDUITS

SF = "/root/testdata/sf0.001"


def conduits():
    duckdb.sql(f"create or replace view lineitem as select * from '{SF}/lineitem.parquet'")
    return duckdb.sql(f"WITH {CONDUITS} SELECT u, v, depth::DOUBLE, width FROM conduits WHERE u <> v").fetchall()


def test_components_of_all_conduits(spark):
    label = {}
    edges = conduits()
    for u, v, *_ in edges:
        label[u], label[v] = u, v
    moved = True
    while moved:
        moved = False
        for u, v, *_ in edges:
            if label[u] != label[v]:
                label[u] = label[v] = min(label[u], label[v])
                moved = True
    assert {tuple(r) for r in QUERIES["components"](spark, SF).collect()} == set(label.items())


def test_route_over_all_conduits(spark):
    """The normal and the passable way against Dijkstra."""
    import heapq

    duckdb.sql(f"create or replace view lineitem as select * from '{SF}/lineitem.parquet'")
    rows = duckdb.sql(f"WITH {CONDUITS} SELECT u, v, length_m::DOUBLE, eid, depth::DOUBLE * 400 FROM conduits WHERE u <> v ORDER BY length_m, eid, depth").fetchall()
    edges = {}
    for u, v, m, _, d in rows:
        edges.setdefault((u, v), (m, d))

    def way(weight):
        out, heap, done = {}, [(0.0, 0, None)], set()
        while heap:
            cost, n, prev = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            out[n] = prev
            for (u, v), (m, d) in edges.items():
                if u == n and (w := weight(m, d)) is not None:
                    heapq.heappush(heap, (cost + w, v, n))
        path, at = [], 233
        while at in out and out[at] is not None:
            path.append(edges[out[at], at])
            at = out[at]
        return path

    normal, safe = way(lambda m, d: m), way(lambda m, d: None if d >= limit else m * (1 + d / limit)) if (limit := hydro.PASSABLE_CM["two-wheeler"]) else []
    r = QUERIES["flood_safe_route"](spark, SF).first()
    assert r.normal_edges == len(normal) and abs(r.normal_m - sum(m for m, _ in normal)) < 0.1
    assert r.blocked == sum(d >= limit for _, d in normal) and (r.safe_m is None) == (not safe)
    assert not safe or abs(r.safe_m - sum(m for m, _ in safe)) < 0.1


def test_route_lines(spark):
    """The normal way's coordinates and its stretches under water, walked in a loop."""
    import heapq

    duckdb.sql(f"create or replace view lineitem as select * from '{SF}/lineitem.parquet'")
    rows = duckdb.sql(f"WITH {CONDUITS} SELECT u, v, length_m::DOUBLE, eid, depth::DOUBLE * 400 FROM conduits WHERE u <> v ORDER BY length_m, eid, depth").fetchall()
    edges = {}
    for u, v, m, _, d in rows:
        edges.setdefault((u, v), (m, d))
    before, heap, done = {}, [(0.0, 0, None)], set()
    while heap:
        cost, at, prev = heapq.heappop(heap)
        if at not in done:
            done.add(at)
            before[at] = prev
            for (u, v), (m, _) in edges.items():
                if u == at:
                    heapq.heappush(heap, (cost + m, v, at))
    nodes = [233]
    while before[nodes[-1]] is not None:
        nodes.append(before[nodes[-1]])
    nodes.reverse()
    place = lambda k: (77.5 + (k % 20) / 100, 12.9 + (k // 20) / 100)
    text = lambda ps: " ".join(f"{a:.3f},{b:.3f}" for a, b in ps)

    def line(part):
        out = [place(part[0])]
        for u, v in zip(part, part[1:]):
            (a, b), (c, d) = place(u), place(v)
            out += [((a + c) / 2, (b + d) / 2), (c, d)]
        return text(out)

    ways = [edges[p] for p in zip(nodes, nodes[1:])]
    want = [("way", 1, len(ways), line(nodes))]
    k = 0
    while k < len(ways):
        if ways[k][1] >= 4.0:
            j = k
            while j < len(ways) and ways[j][1] >= 4.0:
                j += 1
            want.append(("blocked", k + 1, j, line(nodes[k : j + 1])))
            k = j
        else:
            k += 1
    got = QUERIES["route_lines"](spark, SF).collect()
    numbers = lambda t: [tuple(round(float(x), 2) for x in p.split(",")) for p in t.split(" ")]
    assert sorted((r.kind, r.first, r.last) for r in got) == sorted(w[:3] for w in want) and len(want) > 1
    for r in got:
        expected = next(w[3] for w in want if w[:3] == (r.kind, r.first, r.last))
        assert np.abs(np.array(numbers(r.line)) - np.array(numbers(expected))).max() <= 0.011
        assert abs(r.length_m - sum(m for m, _ in ways[r.first - 1 : r.last])) < 0.1


def test_nearest_of_all_vectors(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    ids, e = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {r.vec_id: r.nearest for r in QUERIES["nearest_vector_whole"](spark, SF).collect()}
    assert got.keys() == set(ids.tolist())
    for i, x in zip(ids.tolist(), e):
        d = np.sqrt(((e - x) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        assert d[np.flatnonzero(ids == got[i])[0]] <= d.min() + 2e-5


def surveyed():
    from ponding.plans.domain import SURVEY

    duckdb.sql(f"create or replace view orders as select * from '{SF}/orders.parquet'")
    rows = duckdb.sql(f"WITH {SURVEY} SELECT row, col, z FROM dem").fetchall()
    n = int(len(rows) ** 0.5)
    z = np.empty((n, n))
    for r, c, v in rows:
        z[r, c] = v
    return z


def near(n, r, c):
    return [(r + a, c + b) for _, a, b in grid.D8 if 0 <= r + a < n and 0 <= c + b < n]


def filled(z):
    """Priority flood: the lowest way out of each cell."""
    import heapq

    n, out = len(z), np.full(z.shape, np.inf)
    heap = [(z[r, c], r, c) for r in range(n) for c in range(n) if r in (0, n - 1) or c in (0, n - 1)]
    for v, r, c in heap:
        out[r, c] = v
    heapq.heapify(heap)
    while heap:
        v, r, c = heapq.heappop(heap)
        for a, b in near(n, r, c):
            if out[a, b] == np.inf:
                out[a, b] = max(v, z[a, b])
                heapq.heappush(heap, (out[a, b], a, b))
    return out


def test_depressions_of_the_survey(spark):
    z = surveyed()
    want = filled(z)
    rows = QUERIES["filled_depressions"](spark, SF).collect()
    assert len(rows) == z.size and all(r.z == z[r.row, r.col] and r.w == want[r.row, r.col] for r in rows)
    assert (want > z).any()


def crossed(w):
    """Plain loops: distances over each flat to what drains and from what is higher, then the steepest way."""
    from collections import deque

    n = len(w)
    cells = [(r, c) for r in range(n) for c in range(n)]
    drains = {x: x[0] in (0, n - 1) or x[1] in (0, n - 1) or any(w[y] < w[x] for y in near(n, *x)) for x in cells}

    def far(begin):
        out, queue = dict.fromkeys(begin, 1), deque(begin)
        while queue:
            x = queue.popleft()
            for y in near(n, *x):
                if w[y] == w[x] and not drains[y] and y not in out:
                    out[y] = out[x] + 1
                    queue.append(y)
        return out

    flat = [x for x in cells if not drains[x]]
    towards = far([x for x in flat if any(drains[y] and w[y] == w[x] for y in near(n, *x))])
    away = far([x for x in flat if any(w[y] > w[x] for y in near(n, *x))])
    mask, seen = dict.fromkeys(cells, 0), set()
    for x in flat:
        if x not in seen:
            part, queue = {x}, [x]
            while queue:
                a = queue.pop()
                for b in near(n, *a):
                    if b not in part and not drains[b] and w[b] == w[a]:
                        part.add(b)
                        queue.append(b)
            seen |= part
            tallest = max((away[a] for a in part if a in away), default=0)
            mask |= {a: 2 * towards[a] + (tallest - away[a] if a in away else 0) for a in part}
    out = {}
    for x in cells:
        ways = [(w[x] - w[y], mask[x] - mask[y], math.sqrt(abs(a) + abs(b)), code, y) for code, a, b in grid.D8 if (y := (x[0] + a, x[1] + b)) in mask]
        down = [(f / d, code, y) for f, _, d, code, y in ways if f > 0] or [(m / d, code, y) for f, m, d, code, y in ways if f == 0 and m > 0 and not drains[x]]
        out[x] = max(down, key=lambda t: t[0])[1:] if down else None
    return out


def test_flow_across_flats(spark, monkeypatch):
    monkeypatch.setattr(flats.flat_gradient, "__defaults__", ("w", 11))  # flats that reach over tiles
    z = np.floor(surveyed() / 50) * 50
    want = crossed(filled(z))
    rows = QUERIES["flow_across_flats"](spark, SF).collect()
    assert {(r.row, r.col): (r.code, (r.row2, r.col2)) if r.code is not None else None for r in rows} == want
    n = len(z)
    assert all(want[x] for x in want if 0 < x[0] < n - 1 and 0 < x[1] < n - 1)
    level = spark.createDataFrame([(r, c, 5.0 if 0 < r < 19 and 0 < c < 19 else 9.0 if (r, c) != (0, 7) else 1.0) for r in range(20) for c in range(20)], "row int, col int, w double")
    flat = np.array([[5.0 if 0 < r < 19 and 0 < c < 19 else 9.0 if (r, c) != (0, 7) else 1.0 for c in range(20)] for r in range(20)])
    got = {(r.row, r.col): (r.code, (r.row2, r.col2)) if r.code is not None else None for r in flats.flow_across_flats(level, 20).collect()}
    assert got == crossed(flat)
    for x in [(10, 10), (18, 1)]:  # one plain leads out through its only outlet
        while x[0]:
            x = got[x][1]
        assert x == (0, 7)


def test_quantiles_of_groups(spark):
    """With ties, a group of one, a null group and one group with most rows, against numpy."""
    rng = np.random.default_rng(12)
    rows = [("big", float(v)) for v in rng.integers(0, 50, 900)] + [("one", 3.5), (None, 1.0), (None, 2.0), ("big", None)] + [("few", float(v)) for v in rng.normal(size=7)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = stats.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(6), "x", shares, ["g"]).collect()
    for g in {r[0] for r in rows}:
        want = np.quantile([v for k, v in rows if k == g and v is not None], shares)
        assert np.allclose([r.cut for r in sorted((r for r in got if r.g == g), key=lambda r: r.share)], want)


def test_bootstrap_interval(spark):
    """Close to the interval of resamples that numpy draws."""
    duckdb.sql(f"create or replace view supplier as select * from '{SF}/supplier.parquet'")
    x = np.array([r[0] for r in duckdb.sql("select s_acctbal from supplier").fetchall()])
    low, high = np.percentile(np.random.default_rng(0).choice(x, (20_000, len(x))).mean(1), [2.5, 97.5])
    r = QUERIES["bootstrap_interval"](spark, SF).first()
    assert r.low < x.mean() < r.high and abs(r.high - r.low - (high - low)) < 0.15 * (high - low)
