"""Routing by tiles against the same walks cell by cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ponding.operators import grid


def terrain(spark, n, seed):
    z = np.random.default_rng(seed).integers(0, 60, (n, n)) + 5 * np.arange(n)[::-1, None]
    rows = [(r, c, float(z[r, c])) for r in range(n) for c in range(n) if (r * 31 + c * 17) % 41]
    return spark.createDataFrame(rows, "row int, col int, z double"), {(r, c): v for r, c, v in rows}


@pytest.mark.parametrize("seed", [0, 1])
def test_routes_by_tiles(spark, seed):
    n = 37
    df, z = terrain(spark, n, seed)
    got = {(r.row, r.col): (r.code, r.row2, r.col2) for r in grid.flow_direction(df).collect()}
    assert got.keys() == z.keys()
    for (r, c), v in z.items():
        drops = [((v - z[r + a, c + b]) / (abs(a) + abs(b)) ** 0.5, -k, (code, r + a, c + b)) for k, (code, a, b) in enumerate(grid.D8) if z.get((r + a, c + b), v) < v]
        assert got[r, c] == (max(drops)[2] if drops else (None, None, None))
    flow = grid.settle(grid.receivers(grid.flow_direction(df), n))
    plain = {r.cell: r.acc for r in grid.accumulate(flow, F.col("cell") + 1.0).collect()}
    assert {r.cell: r.acc for r in grid.accumulate(flow, F.col("cell") + 1.0, n=n, tile=5).collect()} == plain
    stop = flow.where("cell % 29 = 0").select("cell")
    want = {r.cell: r.target for r in grid.jump(flow, stop).collect()}
    assert {r.cell: r.target for r in grid.jump(flow, stop, n=n, tile=5).collect()} == want
    assert len(want) == len(z)


def test_circles_across_tiles_are_told(spark):
    flow = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (4, 4)], "cell long, rec long")
    for tile in (2, 64):
        with pytest.raises(Exception, match="drain in a circle"):
            grid.jump(flow, flow.where("cell = 4").select("cell"), rounds=4, n=5, tile=tile)


def test_only_border_cells_take_part_in_the_rounds(spark, monkeypatch):
    n, seen = 32, []
    keep = grid.settle
    flow = keep(grid.receivers(grid.flow_direction(terrain(spark, n, 2)[0]), n))
    monkeypatch.setattr(grid, "settle", lambda df: (out := keep(df), seen.append(out.count()))[0])
    grid.accumulate(flow, n=n, tile=16).count()
    assert sorted(seen)[-2] <= 4 * 60 and max(seen) == flow.count()


def exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_filters_over_several_tiles(spark):
    from ponding.operators import resample

    n = 70
    a = np.random.default_rng(5).random((n, n))
    df = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(n) for c in range(n)], "row int, col int, v double")

    def array(out, m):
        got = np.full((m, m), np.nan)
        for r in out.collect():
            got[r.row, r.col] = r.v
        return got

    w = np.exp(-0.5 * (np.arange(-5, 6) / 1.2) ** 2)
    rows = np.stack([np.convolve(line, w / w.sum(), "valid") for line in np.pad(a, 5, mode="symmetric")])
    smooth = grid.gaussian(df, n, 1.2, "v", [])
    assert exchanged(smooth) == 1
    assert np.abs(array(smooth, n) - np.stack([np.convolve(line, w / w.sum(), "valid") for line in rows.T]).T).max() < 1e-12
    m = 2 * n
    y = np.arange(m) * ((n - 1) / (m - 1))
    lin = np.maximum(1 - np.abs(y[:, None] - np.arange(n)), 0)
    large = resample.bilinear(df, n, m, "v")
    assert exchanged(large) == 1
    assert np.abs(array(large, m) - lin @ a @ lin.T).max() < 1e-12
    d = np.abs((np.arange(3 * n)[:, None] + 0.5) / 3 - 0.5 - np.arange(n))
    cub = np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
    cub /= cub.sum(1, keepdims=True)
    larger = resample.bicubic(df, 3, n, "v")
    assert exchanged(larger) == 1
    assert np.abs(array(larger, 3 * n) - cub @ a @ cub.T).max() < 1e-12


def test_storage_shuffles_nothing(spark):
    g = grid.cells(spark, 30)
    out = grid.storage_balance(g, F.col("t") * 1.0, F.lit(1.0), F.lit(40.0))
    assert exchanged(out) == 0 and out.count() == 900 * 13
