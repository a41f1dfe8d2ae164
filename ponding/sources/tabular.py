"""Rain series files, drainage-model reports and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rain(spark: SparkSession, path: str, whole_minutes: bool = False) -> DataFrame:
    """minute, mm_per_h; header lines, malformed rows and negative times are left out. whole_minutes: times cut to whole minutes, as the drainage model takes them."""
    raw = spark.read.csv(path, schema="minutes string, mm_per_h string")
    out = raw.select(F.col("minutes").try_cast("double").alias("minute"), F.col("mm_per_h").try_cast("double").alias("mm_per_h"))
    out = out.where((F.col("minute") >= 0) & F.col("mm_per_h").isNotNull())
    return out.withColumn("minute", F.floor("minute").cast("double")) if whole_minutes else out


def write_rain(series: DataFrame, path: str, end_minute: int) -> None:
    """The series in order with a closing row of no rain at its end."""
    last = series.sparkSession.range(1).select(F.lit(end_minute).cast("int").alias("minutes"), F.lit(0.0).alias("mm_per_h"))
    rows = series.select(F.col("minute").cast("int").alias("minutes"), "mm_per_h").unionByName(last)
    rows.orderBy("minutes").write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """file, runoff_continuity_pct, routing_continuity_pct, node, hours, max_cms, volume_ml from text reports."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    errors = F.regexp_extract_all("value", F.lit("Continuity Error \\(%\\)[ .]*(-?[0-9.]+)"), F.lit(1))
    table = F.regexp_extract("value", "(?s)Node Flooding Summary\\s*\\*+(.*?)(?:\\*{5,}|$)", 1)
    rows = F.regexp_extract_all(table, F.lit("(?m)^\\s*([A-Za-z]\\S*\\s+[0-9.]+\\s+[0-9.]+\\s+\\d+\\s+[0-9:]+\\s+[0-9.]+)"), F.lit(1))
    f = t.select("file", F.get(errors, F.lit(0)).cast("double").alias("runoff_continuity_pct"), F.get(errors, F.lit(1)).cast("double").alias("routing_continuity_pct"), F.explode_outer(rows).alias("r"))
    w = F.split(F.trim("r"), "\\s+")
    return f.select("file", "runoff_continuity_pct", "routing_continuity_pct", F.get(w, F.lit(0)).alias("node"), F.get(w, F.lit(1)).cast("double").alias("hours"), F.get(w, F.lit(2)).cast("double").alias("max_cms"), F.get(w, F.lit(5)).cast("double").alias("volume_ml"))


FLOODING = "runoff_continuity_pct double, routing_continuity_pct double, flooded array<struct<node: string, hours: double, max_cms: double, volume_ml: double, lon: double, lat: double, bad_drain: boolean, near: string>>"


def read_flooding(spark: SparkSession, path: str) -> DataFrame:
    """Flooded nodes of model results, the largest volume first within a file."""
    f = spark.read.schema(FLOODING).json(path, multiLine=True).withColumn("file", F.input_file_name())
    return f.select("file", "runoff_continuity_pct", "routing_continuity_pct", F.explode("flooded").alias("n")).select("file", "runoff_continuity_pct", "routing_continuity_pct", "n.*").orderBy("file", F.desc("volume_ml"), "node")


def flooded_features(flooding: DataFrame, nodes: DataFrame) -> DataFrame:
    """flooding: of :func:`read_flooding`; nodes: node and the network's attributes. Flooded nodes that the network knows, with its attributes."""
    return flooding.join(nodes, "node")
