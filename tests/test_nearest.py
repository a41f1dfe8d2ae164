"""Nearest neighbours against brute force, with clusters, ties, far outliers and missing coordinates."""

import math

import numpy as np
import pytest

from ponding.operators import nearest


def flat(a, b):
    return math.hypot((b[0] - a[0]) * 111_320.0 * math.cos(math.radians((a[1] + b[1]) / 2)), (b[1] - a[1]) * 110_570.0)


def brute(points, others, apart):
    return {i: min((apart(p, q), j) for j, q in others) for i, p in points}


@pytest.mark.parametrize("metric", ["flat", "plane"])
def test_nearest(spark, metric, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 4)
    monkeypatch.setattr(nearest, "BROADCAST", 2)
    rng = np.random.default_rng(6)
    others = [(i, tuple(p)) for i, p in enumerate(np.r_[rng.normal((77.6, 12.95), 0.01, (120, 2)), rng.normal((80.2, 13.1), 1e-6, (60, 2)), [[77.0, -3.0]], [[77.6, 12.95]] * 12].tolist())]
    points = [(1000 + i, tuple(p)) for i, p in enumerate(np.r_[rng.normal((77.6, 12.95), 0.02, (150, 2)), rng.uniform((-170, -60), (170, 60), (40, 2)), [[77.6, 12.95], [80.2, 13.1]]].tolist())]
    a, b = ("lon", "lat") if metric == "flat" else ("x", "y")
    frame = lambda rows: spark.createDataFrame([(i, *p) for i, p in rows], f"id long, {a} double, {b} double").repartition(4)
    got = {r.id: (r.d, r.other) for r in nearest.nearest(frame([*points, (1, (None, 3.0))]), frame([*others, (-5, (None, None))]), metric).collect()}
    assert got.pop(1) == (None, None)
    want = brute(points, others, flat if metric == "flat" else math.dist)
    assert got.keys() == want.keys()
    for i, (d, j) in want.items():
        assert got[i][0] == pytest.approx(d, rel=1e-12, abs=1e-9)
        assert got[i][1] == j or dict(others)[got[i][1]] == dict(others)[j]


def test_points_in_one_place(spark):
    same = spark.createDataFrame([(i, 5.0, 5.0) for i in range(200)], "id long, x double, y double")
    assert {(r.id, r.other, r.d) for r in nearest.nearest(same, same, "plane").collect()} == {(i, 0, 0.0) for i in range(200)}
    none = same.where("id < 0")
    assert nearest.nearest(none, same, "plane").collect() == []
    assert {(r.other, r.d) for r in nearest.nearest(same, none, "plane").collect()} == {(None, None)}
