"""Files in and out, and streams."""

from pyspark.sql import functions as F

from ponding.operators import profile
from ponding.sources import geojson, kml, tabular
from ponding.streaming import rain_stream

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>zone a</name>
<Placemark><name>1</name><ExtendedData><SchemaData><SimpleData name="depth">2.5</SimpleData><SimpleData name="note">a &amp; b</SimpleData></SchemaData></ExtendedData><LineString><coordinates>77.1,12.1,0 bad 77.2,12.2</coordinates></LineString></Placemark>
<Folder><name>inner</name><Placemark><ExtendedData><Data name="k"><value>v</value></Data><Data name="k"><value>w</value></Data></ExtendedData><Point><coordinates>77.5,12.5</coordinates></Point></Placemark></Folder>
<Placemark><Point><coordinates>77.6,12.6,3</coordinates></Point></Placemark></Folder></Document></kml>"""
LAYER = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[77.1,12.1],[77.2,12.2]]},"properties":{"u":"1","v":"2","oneway":"False"}},{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[77.5,12.5],[77.6,12.6]],[[1,2],[3,4]]]},"properties":{"u":"1","v":"9"}},{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{}},{"type":"Feature","geometry":{"type":"Point","coordinates":[77.55,12.5]},"properties":{"a":"<Null>","b":"x"}}]}'
REPORT = """
  Continuity Error (%) .....        -0.058
  Continuity Error (%) .....         0.587

  *********************
  Node Flooding Summary
  *********************
  J1            1.50     0.200      0   01:30      0.750
  J22           0.25     0.010      0   02:00      0.004

  *********************
  Outfall Loading Summary
  *********************
  O1            9.00     1.000      0   01:30      9.750
"""


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    p = kml.placemarks(spark, str(tmp_path)).select("pos", "folder", kml.attributes(F.col("xml")).alias("a"), kml.lines(F.col("xml")).alias("l")).orderBy("pos").collect()
    assert [r.folder for r in p] == ["zone a", "inner", "zone a"]
    assert p[0].a == {"depth": "2.5", "note": "a & b"} and p[1].a == {"k": "w"}
    assert [(c.lon, c.lat) for c in p[0].l[0]] == [(77.1, 12.1), (77.2, 12.2)] and p[1].l == []
    assert [(r.lon, r.lat) for r in kml.points(spark, str(tmp_path)).orderBy("pos").collect()] == [(77.5, 12.5), (77.6, 12.6)]
    i = kml.inventory(spark, str(tmp_path)).first()
    assert (i.placemark, i.point, i.linestring, i.west, i.north) == (3, 2, 1, 77.1, 12.6)


def test_geojson(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.geojson").write_text(LAYER)
    f = geojson.read_features(spark, str(tmp_path / "in")).orderBy("fid")
    rows = f.collect()
    assert [len(r.parts) for r in rows] == [1, 2, 1, 1] and rows[3].parts[0][0].lon == 77.55
    assert geojson.touching(f, 77.4, 12.4, 77.7, 12.7).count() == 2
    assert geojson.layer_index(f).first().geometries == {"LineString": 1, "MultiLineString": 1, "Point": 1, "Polygon": 1}
    assert f.select(profile.clean_properties(F.col("props")).alias("p")).collect()[3].p == {"b": "x"}
    geojson.write_features(f, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).select(F.get_json_object("value", "$.geometry.coordinates").alias("c")).collect()
    assert "[[[77.5,12.5],[77.6,12.6]],[[1.0,2.0],[3.0,4.0]]]" in {r.c for r in back}
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    e = geojson.road_edges(f.where("geom_type like '%Line%'"), nodes).collect()
    assert {(r.u, r.v) for r in e} == {(1, 2), (2, 1)} and all(r.length_m == 1.0 and r.name == "unnamed" for r in e)
    assert geojson.parse_box("1,2,3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "3,2,1,4", "a,b,c,d"):
        try:
            geojson.parse_box(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text("minutes,mm_per_h\n0,1.5\n60,x\n-5,2\n120,4\n")
    rain = tabular.read_rain(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in rain.orderBy("minute").collect()] == [(0.0, 1.5), (120.0, 4.0)]
    tabular.write_rain(rain, str(tmp_path / "w"), 180)
    assert [tuple(r) for r in tabular.read_rain(spark, str(tmp_path / "w")).orderBy("minute").collect()][-1] == (180.0, 0.0)
    (tmp_path / "m.rpt").write_text(REPORT)
    got = tabular.read_report(spark, str(tmp_path / "m.rpt")).orderBy("node").collect()
    assert [(r.node, r.hours, r.max_cms, r.volume_ml, r.runoff_continuity_pct, r.routing_continuity_pct) for r in got] == [("J1", 1.5, 0.2, 0.75, -0.058, 0.587), ("J22", 0.25, 0.01, 0.004, -0.058, 0.587)]
    (tmp_path / "f.json").write_text('{"runoff_continuity_pct": -0.1, "routing_continuity_pct": 0.2, "flooded": [{"node": "a", "volume_ml": 1.0}, {"node": "b", "volume_ml": 3.0}]}')
    assert [r.node for r in tabular.read_flooding(spark, str(tmp_path / "f.json")).collect()] == ["b", "a"]
    lines = spark.createDataFrame([(0, "J1 1.0"), (1, "J2 2.0")], "ord long, line string")
    text = profile.inp_lines([("JUNCTIONS", lines), ("RAIN", lines.limit(0))]).orderBy("section", "ord").collect()
    assert [r.line for r in text] == ["[JUNCTIONS]", "J1 1.0", "J2 2.0", "[RAIN]"]


def test_profile(spark):
    names = spark.createDataFrame([("Invert_Level",), ("WIDTH m",)], "name string")
    got = {r.field: r.present for r in profile.missing_fields(names, {"invert": ["invert"], "depth": ["depth", "dep_"], "width": ["width"]}).collect()}
    assert got == {"invert": True, "depth": False, "width": True}
    p = F.create_map(F.lit("a"), F.lit("0"), F.lit("Length"), F.lit("1.5"))
    r = spark.range(1).select(profile.length_with_fallback(p, ["a", "b"], "Length", F.lit(7.0)).alias("m"), profile.place_label(F.lit(" "), F.lit("Town")).alias("l")).first()
    assert r.m == 1500.0 and r.l == "near Town"


def events(spark, folder, rows):
    df = spark.createDataFrame([(k, ts, g, "rain", v, None) for k, (ts, g, v) in enumerate(rows)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark, folder, [("2024-01-01 00:05:00", 1, 2.0), ("2024-01-01 00:20:00", 1, 3.0), ("2024-01-01 00:40:00", 2, -1.0)])
    s = rain_stream.readings(spark, folder, 100)
    drain(rain_stream.window_sums(s).writeStream.format("memory").queryName("w").outputMode("complete").start())
    assert {(r.gauge, r.mm, r.readings) for r in spark.table("w").collect()} == {(1, 5.0, 2), (2, 0.0, 1)}
    drain(rain_stream.latest(s).writeStream.format("memory").queryName("l").outputMode("complete").start())
    assert {(r.gauge, r.mm_per_h) for r in spark.table("l").collect()} == {(1, 3.0), (2, 0.0)}
    drain(rain_stream.storms(s).writeStream.format("memory").queryName("s").outputMode("complete").start())
    assert spark.table("s").count() == 2
    drain(rain_stream.storage(s, 4.0).writeStream.format("memory").queryName("b").outputMode("update").start())
    assert {(r.gauge, round(r.storage_mm, 6)) for r in spark.table("b").collect()} == {(1, 4.0), (2, 0.0)}
