"""Radius joins where many points share a place."""

import math

import pytest

from ponding.operators import spatial


def test_crowded_places(spark, monkeypatch):
    spots = [(0.0, 0.0), (3.0, 4.0), (5.0, 0.0), (40.0, 40.0), (-0.0, 5.0)]
    points = [(i, *spots[i % 5]) for i in range(200)]
    others = [(1000 - i, *spots[(i * 3) % 4]) for i in range(60)]
    df = lambda rows: spark.createDataFrame([*rows, (7777, None, 1.0)], "id long, x double, y double")
    pairs, keep = [], spatial.near_pairs

    def counted(*args):
        out = keep(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "near_pairs", counted)
    apart = lambda p, q: math.dist(p[1:], q[1:])
    assert {r.id: r.near for r in spatial.crowd(df(points), 5.0).collect()} == {p[0]: sum(apart(p, q) <= 5 for q in points) for p in points}
    got = {r.id: (r.other, r.d) for r in spatial.nearest_within(df(points), df(others), 4.5).collect()}
    best = {p[0]: min(((apart(p, q), q[0]) for q in others if apart(p, q) <= 4.5), default=(None, None)) for p in points}
    assert got == {7777: (None, None), **{i: (j, d) for i, (d, j) in best.items()}}
    got = spatial.within(df(points), df(others), 5.0)
    assert got.columns == ["id", "x", "y"]
    assert sorted(r.id for r in got.collect()) == sorted(p[0] for p in points if any(apart(p, q) < 5 for q in others))
    assert max(pairs) <= 25
