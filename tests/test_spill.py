"""Depressions filled by tiles and groups of tiles, against a priority queue."""

import heapq
import random

import pytest

from ponding.operators import grid


@pytest.mark.parametrize("n", [19, 41])
def test_depressions_fill_in_passes_whose_number_does_not_grow(spark, monkeypatch, n):
    """A spiral of low cells, cells that never drain, missing ones, and noise; groups of groups of tiles of three."""
    rng = random.Random(n)
    z = {(i, j): float(rng.randrange(40)) for i in range(n) for j in range(n)}
    r, c, d, way, seen = 1, 1, 0, ((0, 1), (1, 0), (0, -1), (-1, 0)), set()
    for i in range(1, n - 1):
        for j in range(1, n // 2):
            z[i, j] = 90.0
    for _ in range(n * n):
        z[r, c] = 1.0 + len(seen) % 5
        seen.add((r, c))
        a, b = way[d]
        ahead = (r + 2 * a, c + 2 * b)
        if not (0 < ahead[0] < n - 1 and 0 < ahead[1] < n // 2) or ahead in seen:
            d = (d + 1) % 4
            a, b = way[d]
            if (r + 2 * a, c + 2 * b) in seen or not (0 < r + a < n - 1 and 0 < c + b < n // 2):
                break
        r, c = r + a, c + b
    for i in range(n - 7, n - 2):
        for j in range(n - 7, n - 2):
            if i in (n - 7, n - 3) or j in (n - 7, n - 3):
                del z[i, j]
    rows = [(i, j, v) for (i, j), v in z.items()]
    written, keep = [], grid.settle
    monkeypatch.setattr(grid, "settle", lambda df: (out := keep(df), written.append(out.count()))[0])
    got = grid.fill_depressions(spark.createDataFrame(rows, "row int, col int, z double").repartition(4), n, tile=3).collect()
    # The grid twice, and a graph and its levels for tiles and for groups of tiles.
    assert len(written) == (4 if n < 24 else 6)
    level = {p: v for p, v in z.items() if p[0] in (0, n - 1) or p[1] in (0, n - 1)}
    heap = [(v, p) for p, v in level.items()]
    heapq.heapify(heap)
    while heap:
        v, (i, j) = heapq.heappop(heap)
        for p in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if p in z and p not in level:
                level[p] = max(z[p], v)
                heapq.heappush(heap, (level[p], p))
    assert {(r.row, r.col): r.w for r in got} == {p: level.get(p, 1e9) for p in z} and len(level) == len(z) - 9
