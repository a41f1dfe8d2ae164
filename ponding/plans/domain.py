"""The test tables in the roles of the flood domain, and the same projections in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain gauge readings: gauge, ts, minute since 2024-01-01, mm_per_h."""
    e = read(spark, sf_dir, "events")
    minute = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(60_000_000.0)
    return e.select(F.col("user_id").alias("gauge"), "event_id", "ts", minute.alias("minute"), F.col("value").alias("mm_per_h"))


GAUGES = """gauges AS (SELECT user_id AS gauge, event_id, ts, (epoch_us(ts) - 1704067200000000) / 60000000.0::DOUBLE AS minute, value AS mm_per_h FROM events)"""


def catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-catchments: id, downstream (null at an outlet), area_ha, imperv, cn, slope_pct, length_m, water_share, low_share, overflow_m3, x, y."""
    p = read(spark, sf_dir, "part")
    i = F.col("p_partkey")
    return p.select(
        i.alias("id"),
        F.when(i > 1, F.floor(i / 2)).alias("downstream"),
        F.col("p_size").cast("double").alias("area_ha"),
        ((i % 98) / 100.0).alias("imperv"),
        (60.0 + i % 35).alias("cn"),
        (0.1 + (i % 37) / 10.0).alias("slope_pct"),
        (50.0 + (i * 7919) % 900).cast("double").alias("length_m"),
        ((i % 11) / 20.0).alias("water_share"),
        ((i % 13) / 40.0).alias("low_share"),
        F.greatest(F.floor(F.col("p_retailprice")) - 930, F.lit(0)).cast("double").alias("overflow_m3"),
        (((i * 7919) % 10000) / 10000.0).alias("x"),
        (((i * 104729) % 10000) / 10000.0).alias("y"),
    )


CATCHMENTS = """catchments AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS downstream, p_size::DOUBLE AS area_ha,
 (p_partkey % 98) / 100.0::DOUBLE AS imperv, 60.0::DOUBLE + p_partkey % 35 AS cn, 0.1::DOUBLE + (p_partkey % 37) / 10.0::DOUBLE AS slope_pct,
 (50 + (p_partkey * 7919) % 900)::DOUBLE AS length_m, (p_partkey % 11) / 20.0::DOUBLE AS water_share,
 (p_partkey % 13) / 40.0::DOUBLE AS low_share, greatest(floor(p_retailprice)::BIGINT - 930, 0)::DOUBLE AS overflow_m3,
 ((p_partkey * 7919) % 10000) / 10000.0::DOUBLE AS x, ((p_partkey * 104729) % 10000) / 10000.0::DOUBLE AS y FROM part)"""


def stations(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Points with lon and lat in a city box."""
    k = F.col(key)
    return read(spark, sf_dir, table).select(k.alias("id"), (77.58 + 0.12 * ((k * 7919) % 10000) / 10000.0).alias("lon"), (12.90 + 0.12 * ((k * 104729) % 10000) / 10000.0).alias("lat"))


def stations_sql(name: str, table: str, key: str) -> str:
    return f"{name} AS (SELECT {key} AS id, 77.58::DOUBLE + 0.12::DOUBLE * (({key} * 7919) % 10000) / 10000.0::DOUBLE AS lon, 12.90::DOUBLE + 0.12::DOUBLE * (({key} * 104729) % 10000) / 10000.0::DOUBLE AS lat FROM {table})"


def conduits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register of conduits between the nodes of a lattice: eid, u, v, depth, width, length_m, bad, name."""
    li = read(spark, sf_dir, "lineitem")
    u, step = F.col("l_orderkey") % 400, 1 + F.col("l_partkey") % 3
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("eid"),
        u.alias("u"),
        ((u + F.when(F.col("l_suppkey") % 2 == 0, step).otherwise(step * 20)) % 400).alias("v"),
        F.col("l_tax").alias("depth"),
        F.col("l_quantity").cast("double").alias("width"),
        F.round(F.col("l_extendedprice") / 10, 1).alias("length_m"),
        (F.col("l_returnflag") == "R").alias("bad"),
        F.concat(F.lit("corridor "), (F.col("l_partkey") % 50).cast("string")).alias("name"),
    )


CONDUITS = """conduits AS (SELECT l_orderkey * 8 + l_linenumber AS eid, l_orderkey % 400 AS u,
 (l_orderkey % 400 + CASE WHEN l_suppkey % 2 = 0 THEN 1 + l_partkey % 3 ELSE (1 + l_partkey % 3) * 20 END) % 400 AS v, l_tax AS depth, l_quantity::DOUBLE AS width,
 round(l_extendedprice / 10, 1) AS length_m, l_returnflag = 'R' AS bad, 'corridor ' || (l_partkey % 50) AS name FROM lineitem)"""


def side(spark: SparkSession, sf_dir: str) -> int:
    """Cells along each axis of the surveyed grid: it grows with the table of survey points."""
    return int(read(spark, sf_dir, "orders").count() ** 0.5)


def survey(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The surveyed terrain, a row for each point of the survey, and its side: row, col, cell, x, y (unit square), z (whole centimetres), class, blocked."""
    n, k = side(spark, sf_dir), F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").where(k < n * n)
    row, col = F.floor(k / n).cast("int"), (k % n).cast("int")
    z = F.pmod(F.floor("o_totalprice"), F.lit(101)) + 30 * ((n - row) + F.abs(col - n // 2))
    return o.select(row.alias("row"), col.alias("col"), k.alias("cell"), (col / F.lit(n - 1.0)).alias("x"), (row / F.lit(n - 1.0)).alias("y"), z.cast("double").alias("z"), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (1 + F.col("o_custkey") % 11).cast("int")).alias("class"), ((F.col("o_custkey") % 10) / 10.0).alias("blocked")), n


#: Land-cover codes in the order of the test tables' keys.
CLASSES = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)
SURVEY = f"""g AS (SELECT floor(sqrt(count(*)))::INT AS n FROM orders), dem AS (SELECT (o_orderkey // n)::INT AS row, (o_orderkey % n)::INT AS col, o_orderkey AS cell, (o_orderkey % n) / (n - 1.0)::DOUBLE AS x, (o_orderkey // n) / (n - 1.0)::DOUBLE AS y,
 (floor(o_totalprice)::BIGINT % 101 + 30 * ((n - o_orderkey // n) + abs(o_orderkey % n - n // 2)))::DOUBLE AS z, {list(CLASSES)}[1 + o_custkey % 11] AS class, (o_custkey % 10) / 10.0::DOUBLE AS blocked FROM orders, g WHERE o_orderkey < n * n)"""
