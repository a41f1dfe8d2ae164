"""Whitening against numpy's eigenvectors, and exact counts and deviations against Python integers."""

import numpy as np
import pytest

from ponding.llm import tree, whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component int, part string"


def table(spark, rows, parts=6):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], "x", 1, "x") for i, v in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(6, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1])[:, None]
    out = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 6)) @ mix + 3)]
    out += [(1, out[0][1]), (1, out[0][1]), (None, out[5][1])]  # repeats, a null id
    out += [(900, None), (901, []), (902, [1.0, None, 1, 1, 1, 1]), (903, [float("nan")] * 6), (904, [float("inf"), 1, 1, 1, 1, 1]), (905, [1.0] * 5), (906, [1e300, 0, 0, 0, 0, 0])]
    return out


def whole(v):
    return [int(np.floor(64 * float(c))) + 1_000_000 for c in v]


@pytest.mark.parametrize("fan", [2, 16])
def test_whitening(spark, rows, fan, monkeypatch):
    monkeypatch.setattr(tree, "FAN", fan)
    monkeypatch.setattr(whitening, "ROWS", 50)
    got = whitening.whiten(table(spark, rows), components=4).collect()
    kept = [(i, whole(v)) for i, v in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) and abs(c) < 1e100 for c in v)]
    x = np.array([v for _, v in kept], np.float64)
    n, sums = len(kept), [sum(v[d] for _, v in kept) for d in range(6)]
    values, vectors = np.linalg.eigh(np.cov((x - x.mean(0)).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in kept)
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == want
    assert {r.n for r in got} == {n} and len(got) == 4 * n
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.component, str(r.vec_id), r.deviation)) if r.component == k + 1] for k in range(4)]).T
    y = np.array([(v - x.mean(0)) for _, _, v in sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(v, sums)), v) for i, v in kept)]) @ vectors[:, :4] / np.sqrt(values[:4])
    assert np.abs(np.abs(w) - np.abs(y)).max() < 1e-8
    assert np.abs(w.T @ w / n - np.eye(4)).max() < 1e-10
    assert {r.identity_error for r in got}.pop() < 1e-10
    assert np.allclose([{r.explained for r in got if r.component == k + 1}.pop() for k in range(4)], values[:4] / values.sum(), rtol=1e-10)


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    # One direction only: one component, however many dimensions.
    got = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in got} == {1} and len(got) == 9
    # Of equally frequent lengths the longest counts.
    assert {r.vec_id for r in whitening.whiten(table(spark, [(1, [1.0]), (2, [2.0]), (3, [1.0, 0.0]), (4, [2.0, 1.0])])).collect()} == {3, 4}


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e15 * (i % 7), float(i)]) for i in range(40)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    sums = [sum(whole(v)[d] for _, v in rows) for d in (0, 1)]
    for i, v in rows:
        exact = sum((40 * c - s) ** 2 for c, s in zip(whole(v), sums))
        assert got[i] == (exact if exact < 2**63 else None)


def test_jacobi():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 5, 33):
        r = np.triu(rng.normal(size=(dim, dim))) * np.logspace(0, -6, dim)
        norms, vectors = whitening.jacobi(r)
        assert np.allclose(norms, np.linalg.svd(r, compute_uv=False), rtol=1e-9)
        assert np.abs(vectors.T @ vectors - np.eye(dim)).max() < 1e-13
        assert np.abs((r @ vectors).T @ (r @ vectors) - np.diag(norms**2)).max() < 1e-13
    wide = rng.normal(size=(3, 8))  # fewer rows than dimensions
    norms, vectors = whitening.jacobi(wide)
    assert np.allclose(norms[:3], np.linalg.svd(wide, compute_uv=False)) and norms[3:].max() < 1e-12
