"""Layers with an error contract, summaries, reports, and small functions of sources."""

import json

import pytest
from pyspark.sql import functions as F

from ponding.functions import geo, hydro, presentation
from ponding.operators import grid, profile, resample
from ponding.sources import geojson, layers, tabular


def test_layers(spark, tmp_path):
    store = layers.Layers(spark, str(tmp_path), ("chennai", "delhi"), most=2)
    with pytest.raises(layers.UnknownCity):
        store.load("paris", "streams")
    with pytest.raises(layers.NotBuilt):
        store.load("delhi", "streams")
    for k, name in enumerate(("streams", "zones", "drains")):
        store.save(spark.range(k + 1), "Chennai", name)
    assert [store.load("chennai", n).count() for n in ("streams", "zones", "drains")] == [1, 2, 3]
    assert list(store.open) == [("chennai", "zones"), ("chennai", "drains")]
    store.load("chennai", "zones")
    assert list(store.open)[-1] == ("chennai", "zones")
    store.save(spark.range(9), "chennai", "zones")
    assert store.load("CHENNAI", "zones").count() == 9


def test_summary_and_report(spark, tmp_path):
    row = spark.createDataFrame([("delhi", 1.5, None, {"1": 4})], "city string, km double, note string, orders map<string,int>")
    layers.write_summary(row, str(tmp_path / "s"))
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("part-*"))
    assert json.loads(text) == {"city": "delhi", "km": 1.5, "note": None, "orders": {"1": 4}}
    classes = spark.createDataFrame([("Primary", 1200, 45_300.0), ("Tertiary", 3, 90.0)], "kind string, n long, metres double")
    props = spark.createDataFrame([(0, {"Width": "2", "Name": "x" * 50}), (1, {"Width": ""})], "ord long, props map<string,string>")
    attributes = profile.attribute_profile(props, "props", "ord")
    fields = profile.missing_fields(attributes.select("name"), {"width": ["width"], "invert": ["invert"]})
    report = layers.profile_report("Drains", classes, attributes, fields)
    for line in ("# Drains", "| Primary | 1,200 | 45.3 km |", "| `Width` | 1/2 | 2 |", f"| `Name` | 1/1 | {'x' * 40}... |", "- **invert**: not in the source, to be derived", "- **width**: present"):
        assert line in report.splitlines()


def test_small_functions(spark, tmp_path):
    (tmp_path / "r.csv").write_text("minutes,mm_per_h\n0.9,2\n30.7,4\nbad,1\n")
    assert [tuple(r) for r in tabular.read_rain(spark, str(tmp_path / "r.csv"), whole_minutes=True).collect()] == [(0.0, 2.0), (30.0, 4.0)]
    t = (10.0, 2.0, 500.0, -1.0, -8.0, 900.0)
    cell = spark.createDataFrame([(3, 7), (0, 0)], "row int, col int").withColumn("p", geo.affine_point(F.col("row"), F.col("col"), t))
    got = cell.select("row", "col", geo.affine_cell(F.col("p.x"), F.col("p.y"), t).alias("c"), "p").collect()
    assert all((r.row, r.col) == tuple(r.c) for r in got)
    assert tuple(got[0].p) == (10 * 7.5 + 2 * 3.5 + 500, -7.5 - 8 * 3.5 + 900)
    with pytest.raises(ValueError):
        geo.affine_cell(F.col("x"), F.col("y"), (1, 1, 0, 1, 1, 0))
    streets = spark.createDataFrame([(2, 1, 0, "primary", None), (1, 2, 0, "primary", " "), (1, 2, 1, None, "Main"), (5, 4, 0, None, "")], "u long, v long, key int, highway string, name string")
    assert sorted((r.u, r.v, r.key, r.name) for r in geojson.first_of_ways(streets).collect()) == [(1, 2, 0, "unnamed primary"), (1, 2, 1, "Main"), (5, 4, 0, "unnamed street")]
    flooding, nodes = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "node string, volume_ml double"), spark.createDataFrame([("a", "canal")], "node string, near string")
    assert [tuple(r) for r in tabular.flooded_features(flooding, nodes).collect()] == [("a", 2.0, "canal")]
    heights = spark.createDataFrame([(-1.0,), (1.0,), (14.0,), (None,), (float("nan"),)], "h double")
    assert [tuple(r.c) for r in heights.select(presentation.hand_colour(F.col("h")).alias("c")).collect()] == [(8, 48, 107, 230), (20, 80, 144, 217), (222, 235, 247, 0), (222, 235, 247, 0), (222, 235, 247, 0)]
    files = spark.createDataFrame([("31523c86-a.kml",), ("zzz",)], "name string")
    manifest = spark.createDataFrame([("31523c86", "chennai")], "id string, city string")
    assert [r.city for r in resample.registered(files, manifest).collect()] == ["chennai"]
    for bad in ({"city": "paris"}, {"city": "delhi", "mode": "boat"}, {"city": "delhi", "lead": 200}):
        with pytest.raises(ValueError):
            presentation.check_request(**bad)
    presentation.check_request("delhi", "two-wheeler", 15)
    shares = spark.createDataFrame([(0.005,), (0.02,), (0.5,), (0.99,)], "x double").select(hydro.clamp_imperviousness(F.col("x")).alias("y")).collect()
    assert [r.y for r in shares] == [0.0, 0.05, 0.5, 0.98]


def test_circles_are_told(spark):
    flow = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 5)], "cell long, rec long")
    with pytest.raises(ValueError):
        grid.jump(flow, flow.where("cell = 5").select("cell"), rounds=4)
