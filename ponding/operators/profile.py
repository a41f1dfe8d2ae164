"""Profiles of attributes, classes and files; identities and labels; drainage-model text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute_profile(df: DataFrame, props: str, order: str) -> DataFrame:
    """props: a map. For each attribute: how often seen, how often filled, its first filled value; the commonest first."""
    kv = df.select(F.col(order).alias("ord"), F.explode(props).alias("name", "value"))
    filled = F.coalesce(F.trim("value") != "", F.lit(False))
    out = kv.groupBy("name").agg(F.count(F.lit(1)).alias("seen"), F.count_if(filled).alias("filled"), F.min_by(F.when(filled, F.col("value")), F.when(filled, F.col("ord"))).alias("example"))
    return out.orderBy(F.desc("seen"), "name")


def clean_properties(props: Column, keep: list[str] | None = None) -> Column:
    """Properties without empty and null-like values, and only those of the keep-list."""
    ok = lambda k, v: ~v.isin("", "<Null>", "Null") & v.isNotNull() & (k.isin(keep) if keep else F.lit(True))
    return F.map_filter(props, ok)


def missing_fields(names: DataFrame, needles: dict[str, list[str]]) -> DataFrame:
    """field, present: whether any attribute name contains one of the field's needles. names: name."""
    spark = names.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(f, n) for f, ns in needles.items() for n in ns], "field string, needle string"))
    return wanted.join(names.distinct(), F.contains(F.lower("name"), F.col("needle")), "left").groupBy("field").agg(F.bool_or(F.col("name").isNotNull()).alias("present"))


def class_totals(df: DataFrame, kind: str, amount: str) -> DataFrame:
    """Count and sum by class and, under a null class, in all."""
    return df.rollup(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))


def numbered(df: DataFrame, kind: str, order: str, prefixes: dict[str, str]) -> DataFrame:
    """Adds label: the class's prefix and a running number within the class."""
    rn = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(prefixes.items()) for x in kv]), F.col(kind)), F.lit("GEN"))
    return df.withColumn("label", F.format_string("%s-%05d", prefix, rn))


def first_seen(points: DataFrame, order: list[str], digits: int = 6) -> DataFrame:
    """Each place once, to six decimals, as first met in the order given."""
    w = Window.partitionBy(F.round("lon", digits), F.round("lat", digits)).orderBy(*order)
    return points.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def duplicate_files(files: DataFrame) -> DataFrame:
    """files: name, content. Adds sha, rank (1: the original; copies named "name (1)" come after) and original."""
    f = files.where(F.octet_length("content") > 0).withColumn("sha", F.sha1("content"))
    w = Window.partitionBy("sha").orderBy(F.contains("name", F.lit(" (")), "name")
    return f.select("name", "sha", F.octet_length("content").alias("bytes"), F.row_number().over(w).alias("rank"), F.first("name").over(w).alias("original"))


def length_with_fallback(props: Column, keys: list[str], km_key: str, measured: Column) -> Column:
    """The first positive length in metres among the keys, else kilometres, else what was measured."""
    tries = [F.when(props[k].try_cast("double") > 0, props[k].try_cast("double")) for k in keys]
    return F.coalesce(*tries, F.when(props[km_key].try_cast("double") > 0, props[km_key].try_cast("double") * 1000), measured)


def place_label(ident: Column, near: Column) -> Column:
    """"id · near place", or whichever is known."""
    known = F.nullif(F.trim(ident), F.lit(""))
    return F.coalesce(F.concat(known, F.lit(" · near "), near), known, F.concat(F.lit("near "), near), F.lit("unnamed"))


def inp_lines(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """Text of a drainage-model file: for each section a header and its lines. Frames have ord and line; write in order of (section, ord)."""
    out = None
    for k, (name, lines) in enumerate(sections):
        spark = lines.sparkSession
        head = spark.range(1).select(F.lit(k).alias("section"), F.lit(-1).cast("long").alias("ord"), F.lit(f"[{name}]").alias("line"))
        part = head.unionByName(lines.select(F.lit(k).alias("section"), F.col("ord").cast("long").alias("ord"), "line"))
        out = part if out is None else out.unionByName(part)
    return out
