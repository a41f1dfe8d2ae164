"""KML placemarks: attributes in both encodings, lines, points, and an inventory of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ponding.functions.geo import parse_coordinates
from ponding.sources import large

SIMPLE = '(?s)<SimpleData name="([^"]*)"\\s*>(.*?)</SimpleData>'
DATA = '(?s)<Data name="([^"]*)"\\s*>.*?<value>(.*?)</value>'


def _unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def placemarks(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """file, pos, folder, xml: one row per placemark of every file, with the name of the innermost folder it stands in. Tasks share a file."""
    return large.placemarks(spark, path, prefix)


def attributes(xml: Column) -> Column:
    """Attributes of either encoding as a map; the last of equal names counts."""
    pairs = lambda p: F.zip_with(F.regexp_extract_all(xml, F.lit(p), F.lit(1)), F.regexp_extract_all(xml, F.lit(p), F.lit(2)), lambda k, v: F.struct(k.alias("key"), _unescape(F.trim(v)).alias("value")))
    both = F.concat(pairs(SIMPLE), pairs(DATA))
    last = F.filter(F.transform(both, lambda e, i: F.struct(e.key.alias("key"), e.value.alias("value"), F.exists(F.slice(both, i + 2, F.size(both)), lambda o: o.key == e.key).alias("again"))), lambda e: ~e.again)
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e.key, e.value)))


def lines(xml: Column) -> Column:
    """Line strings of a placemark with at least two points."""
    raw = F.regexp_extract_all(xml, F.lit("(?s)<LineString\\b.*?<coordinates>(.*?)</coordinates>"), F.lit(1))
    return F.filter(F.transform(raw, parse_coordinates), lambda c: F.size(c) >= 2)


def points(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, lon, lat of every point; pos counts the points of a file."""
    w = Window.partitionBy("file").orderBy("mark", "k")
    raw = placemarks(spark, path).select("file", F.col("pos").alias("mark"), F.posexplode(F.regexp_extract_all("xml", F.lit("(?s)<Point>.*?<coordinates>(.*?)</coordinates>"), F.lit(1))).alias("k", "c"))
    found = raw.select("file", "mark", "k", F.get(parse_coordinates(F.col("c")), F.lit(0)).alias("c")).where(F.col("c").isNotNull())
    return found.select("file", (F.row_number().over(w) - 1).alias("pos"), "c.lon", "c.lat")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per file: bytes, content hash, placemarks, geometry counts, and the box of its coordinates."""
    f = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", F.sha1("content").alias("sha"), F.decode("content", "UTF-8").alias("t"))
    count = lambda tag: F.size(F.regexp_extract_all("t", F.lit(f"<{tag}[ >]"), F.lit(0))).alias(tag.lower())
    all_c = F.flatten(F.transform(F.regexp_extract_all("t", F.lit("(?s)<coordinates>(.*?)</coordinates>"), F.lit(1)), parse_coordinates))
    side = lambda k: F.transform(all_c, lambda c: c[k])
    return f.select("file", "length", "sha", count("Placemark"), count("Point"), count("LineString"), count("Polygon"), F.array_min(side("lon")).alias("west"), F.array_min(side("lat")).alias("south"), F.array_max(side("lon")).alias("east"), F.array_max(side("lat")).alias("north"))
