"""The drainage model's input file against a plain writer, and enlargement against numpy."""

import numpy as np

from ponding.operators import rain, resample
from ponding.sources import model


def test_model_file(spark, tmp_path):
    links = [(k, k % 7, (k * 3 + 1) % 7, 10.0 + k / 8, 9.5 + (k % 3) / 4, 12.25 + k / 8, 12.5, 30.0 + k, 1.25, 0.75 + k / 4, k % 2 == 0, k % 5 == 0) for k in range(40) if k % 7 != (k * 3 + 1) % 7]
    subs = [(k, k % 3, 1.5 + k, 0.25 + k / 64, 4.0 * k, 0.125 * k, 70.5 + k / 4) for k in range(9)]
    at = {n: (1000.0 + n, 2000.5 + n) for n in range(7) if n != 3}
    pipes = spark.createDataFrame(links, "link long, u long, v long, invert_u double, invert_v double, top_u double, top_v double, length_m double, depth double, width double, closed boolean, bad boolean").repartition(4)
    places = spark.createDataFrame([(n, *p) for n, p in at.items()], "node long, x double, y double")
    nodes = model.nodes_of(pipes, spark.createDataFrame([(4,)], "node long")).join(places, "node")
    storm = rain.block_hyetograph(spark, 30.0, 60).selectExpr("t minute", "mm_per_h")
    lines = model.model_lines(spark, "a test", 1500, pipes, nodes, spark.createDataFrame(subs, "id long, node long, area_ha double, imperv double, length_m double, slope_pct double, cn double"), storm)
    model.write_model(lines, str(tmp_path / "m"), files=5)
    parts = sorted((tmp_path / "m").glob("part-*"))
    text = "".join(p.read_text() for p in parts)

    floor, street = {}, {}
    for _, u, v, a, b, s, t, *_ in links:
        for n, low, top in ((u, a, s), (v, b, t)):
            floor[n], street[n] = min(low, floor.get(n, 1e9)), max(top, street.get(n, -1e9))
    want = {"TITLE": ["a test"], "OPTIONS": [*model.OPTIONS, "START_DATE 01/01/2026", "START_TIME 00:00:00", "END_DATE 01/02/2026", "END_TIME 01:00:00"], "RAINGAGES": [model.GAGE]}
    want["SUBCATCHMENTS"] = [f"S{k} RG1 N{n} {a:.4f} {i * 100 + 1e-9:.1f} {max(a * 1e4 / max(m, 10), 5) + 1e-9:.1f} {max(s, 0.3) + 1e-9:.2f} 0" for k, n, a, i, m, s, _ in subs]
    want["SUBAREAS"] = [f"S{k} 0.013 0.15 1.27 5.08 25 OUTLET" for k, *_ in subs]
    want["INFILTRATION"] = [f"S{k} {cn + 1e-9:.1f} 0.5 7" for k, *_, cn in subs]
    want["JUNCTIONS"] = [f"N{n} {floor[n]:.3f} {max(street[n] - floor[n], 0.2):.3f} 0 0 0" for n in sorted(floor) if n != 4]
    want["OUTFALLS"] = [f"N4 {floor[4]:.3f} FREE NO"]
    want["CONDUITS"] = [f"C{k} N{u} N{v} {m:.1f} {0.03 if bad else 0.015} {a - floor[u]:.3f} {b - floor[v]:.3f} 0 0" for k, u, v, a, b, _, _, m, _, _, _, bad in links]
    want["XSECTIONS"] = [f"C{k} {'RECT_CLOSED' if closed else 'RECT_OPEN'} {d:.3f} {w:.3f} 0 0 1" for k, *_, d, w, closed, _ in links]
    want["TIMESERIES"] = [f"STORM {t // 60}:{t % 60:02d} {30.0 if t < 60 else 0.0:.3f}" for t in range(0, 361, 5)]
    want |= {"REPORT": list(model.REPORT), "COORDINATES": [f"N{n} {x:.2f} {y:.2f}" for n, (x, y) in at.items()]}
    assert text == "\n\n".join("\n".join([f"[{s}]", *want[s]]) for s in model.SECTIONS) + "\n"
    assert len(parts) == 5


def test_bicubic(spark):
    n, f = 7, 3
    z = np.random.default_rng(3).random((n, n))
    i = np.arange(n * f)
    d = np.abs((i[:, None] + 0.5) / f - 0.5 - np.arange(n))
    w = np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
    w /= w.sum(1, keepdims=True)
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(n) for c in range(n)], "row int, col int, z double")
    got = np.full((n * f, n * f), np.nan)
    for r in resample.bicubic(df, f, n, "z").collect():
        got[r.row, r.col] = r.z
    assert np.abs(got - w @ z @ w.T).max() < 1e-12
