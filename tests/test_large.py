"""Large documents in pieces: the same rows as from the whole document, whatever the splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ponding.sources import geojson, kml, large


@pytest.fixture(params=[150, 1000, 1 << 27])
def split_bytes(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def collection(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        note = rng.choice(["plain", 'a "quoted" } brace', "back\\slash\\", "{[", "}]}", "ünïcode ✓", "\\\"}"])
        line = [[round(rng.uniform(77, 78), 6), 12.5] for _ in range(rng.choice([2, 3, 3, 60]))]
        f = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": line}, "properties": {"note": note, "i": str(i)}}
        out.append(dict(sorted(f.items(), reverse=rng.random() < 0.5)))
    return {"name": "x}{", "type": "FeatureCollection", "crs": {"a": {"b": ["c"]}}, "bbox": [1, 2], "features": out, "after": {"k": "}"}}


def test_features(spark, tmp_path, split_bytes):
    want = {}
    for name, n, indent in (("a", 40, None), ("b", 23, 2), ("c", 0, None)):
        doc = collection(n, n)
        (tmp_path / f"{name}.geojson").write_text(json.dumps(doc, indent=indent, ensure_ascii=name == "a"))
        want |= {(name, i): f for i, f in enumerate(doc["features"])}
    got = {(r.layer.rsplit("/", 1)[1][0], r.fid): r for r in geojson.read_features(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for k, f in want.items():
        assert got[k].props == f["properties"]
        assert [[c.lon, c.lat] for c in got[k].parts[0]] == f["geometry"]["coordinates"]
    if split_bytes == 150:
        assert large.pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 50


def test_placemarks(spark, tmp_path, split_bytes):
    rng, body, stack, want = random.Random(2), [], [], []
    for i in range(60):
        for _ in range(rng.randint(0, 2)):
            if stack and rng.random() < 0.5:
                stack.pop()
                body.append("</Folder>")
            else:
                stack.append(f"folder {i}")
                body.append(f"<Folder><name>folder {i}</name>")
        mark = f"<name>{i}</name><Point><coordinates>77.{i:02d},12.5,0</coordinates></Point>{'<!-- long -->' * rng.choice([0, 0, 30])}"
        body.append(f'<Placemark id="p{i}">{mark}</Placemark>\n')
        want.append((i, stack[-1] if stack else None, mark))
    body += ["</Folder>"] * len(stack)
    (tmp_path / "a.kml").write_text(f"<?xml version='1.0'?><kml><Document>{''.join(body)}</Document></kml>")
    got = large.placemarks(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.folder) for r in got] == [w[:2] for w in want]
    assert all(r.xml.endswith(w[2]) for r, w in zip(got, want))
    points = kml.points(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.lon) for r in points] == [(i, float(f"77.{i:02d}")) for i in range(60)]


def test_a_large_collection_is_shared(spark, tmp_path):
    """Some 25 MB in one file: several tasks, no row lost."""
    one = json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[77.123456, 12.5]] * 100}, "properties": {"i": 1}})
    with (tmp_path / "big.geojson").open("w") as f:
        f.write('{"type":"FeatureCollection","features":[')
        f.write(",".join([one] * 12_000))
        f.write("]}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
    try:
        rows = large.objects(spark, str(tmp_path))
        assert rows.agg(F.count("*"), F.count_distinct("fid"), F.max("fid"), F.count_distinct("feature")).first() == (12_000, 12_000, 11_999, 1)
        assert large.pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() >= 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
