"""Feature collections in and out. Coordinates are parsed by geometry type, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ponding.sources import large

POINT = "array<double>"
DEPTH = {"Point": POINT, "MultiPoint": f"array<{POINT}>", "LineString": f"array<{POINT}>", "MultiLineString": f"array<array<{POINT}>>", "Polygon": f"array<array<{POINT}>>", "MultiPolygon": f"array<array<array<{POINT}>>>"}


def _pair(p: Column) -> Column:
    return F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))


def _parts(raw: Column, kind: Column) -> Column:
    """Parts of a geometry as arrays of (lon, lat): the lines, rings or points that it has."""
    line = lambda x: F.transform(x, _pair)
    parsed = {k: F.from_json(raw, d) for k, d in DEPTH.items()}
    out = F.when(kind == "Point", F.array(F.array(_pair(parsed["Point"]))))
    out = out.when(kind == "MultiPoint", F.transform(parsed["MultiPoint"], lambda p: F.array(_pair(p))))
    out = out.when(kind == "LineString", F.array(line(parsed["LineString"])))
    out = out.when(kind == "MultiLineString", F.transform(parsed["MultiLineString"], line)).when(kind == "Polygon", F.transform(parsed["Polygon"], line))
    return out.when(kind == "MultiPolygon", F.transform(F.flatten(parsed["MultiPolygon"]), line))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """layer (file path), fid, geom_type, parts, props. A collection is one document; tasks share it, whatever its size."""
    f = large.objects(spark, path).withColumnRenamed("feature", "f")
    f = f.select("layer", F.col("fid").cast("int").alias("fid"), F.get_json_object("f", "$.geometry.type").alias("geom_type"), F.get_json_object("f", "$.geometry.coordinates").alias("raw"), F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("props"))
    return f.select("layer", "fid", "geom_type", _parts(F.col("raw"), F.col("geom_type")).alias("parts"), "props")


def family(geom_type: Column) -> Column:
    return F.regexp_replace(geom_type, "^Multi", "")


def touching(features: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Features with any vertex in the box."""
    return features.where(F.exists("parts", lambda p: F.exists(p, lambda c: c.lon.between(west, east) & c.lat.between(south, north))))


def parse_box(text: str) -> tuple[float, float, float, float]:
    """"west,south,east,north" as numbers in order; ValueError otherwise."""
    try:
        w, s, e, n = (float(x) for x in text.split(","))
    except ValueError:
        raise ValueError(f"a box is west,south,east,north; this is {text!r}") from None
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError(f"not a box: {text!r}")
    return w, s, e, n


def to_feature(geom_type: Column, parts: Column, props: Column) -> Column:
    """One feature as compact JSON; Multi types and polygons keep their parts."""
    pairs = F.transform(parts, lambda p: F.transform(p, lambda c: F.array(c.lon, c.lat)))
    inner = F.when(geom_type == "Point", F.to_json(F.get(F.get(pairs, F.lit(0)), F.lit(0)))).when(geom_type == "LineString", F.to_json(F.get(pairs, F.lit(0))))
    inner = inner.when(geom_type == "MultiPoint", F.to_json(F.transform(pairs, lambda p: F.get(p, F.lit(0))))).when(geom_type == "MultiPolygon", F.to_json(F.transform(pairs, lambda p: F.array(p)))).otherwise(F.to_json(pairs))
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), geom_type, F.lit('","coordinates":'), inner, F.lit('},"properties":'), F.coalesce(F.to_json(props), F.lit("{}")), F.lit("}"))


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features, one file per partition: a large layer is never one value in one task."""
    features.select(to_feature(F.col("geom_type"), F.col("parts"), F.col("props")).alias("value")).write.mode("overwrite").text(path)


def layer_index(features: DataFrame) -> DataFrame:
    """Features and geometry histogram per layer."""
    kinds = features.groupBy("layer", "geom_type").count()
    return kinds.groupBy("layer").agg(F.sum("count").alias("features"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("geom_type", "count")))).alias("geometries"))


def road_edges(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges of a road layer: both ends known, at least two points, both ways unless one-way, a length of 1 where none is given."""
    e = features.select(F.col("fid").alias("eid"), F.col("props.u").cast("long").alias("u"), F.col("props.v").cast("long").alias("v"), F.coalesce(F.nullif(F.col("props.length_m").try_cast("double"), F.lit(0.0)), F.lit(1.0)).alias("length_m"), F.coalesce("props.name", F.lit("unnamed")).alias("name"), F.coalesce(F.lower("props.oneway") == "true", F.lit(False)).alias("oneway"), F.get("parts", F.lit(0)).alias("coords"))
    e = e.where(F.size("coords") >= 2)
    e = e.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi")
    back = e.where(~F.col("oneway")).select("eid", F.col("v").alias("u"), F.col("u").alias("v"), "length_m", "name", "oneway", F.reverse("coords").alias("coords"))
    return e.select(*back.columns).unionByName(back)


def first_of_ways(streets: DataFrame) -> DataFrame:
    """streets: u, v, key, highway, name. Of the two directions of a street the first met (the smaller u), and "unnamed" with its kind where it has no name."""
    w = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), "key").orderBy("u", "v")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("unnamed "), F.coalesce("highway", F.lit("street"))))
    return streets.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("name", name)
