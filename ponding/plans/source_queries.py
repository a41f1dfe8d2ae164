"""Queries that read text through the sources' parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ponding.functions import geo
from ponding.plans.domain import read
from ponding.plans.registry import query


@query("""WITH c AS (SELECT o_orderkey AS id, (77 + (o_orderkey % 100) / 100.0::DOUBLE) AS lon, (12 + (o_custkey % 100) / 100.0::DOUBLE) AS lat FROM orders)
SELECT id, 2 AS points, round(lon, 6) AS lon, round(lat, 6) AS lat, (lon BETWEEN 77.2 AND 77.6 AND lat BETWEEN 12.1 AND 12.5) OR (12.3 BETWEEN 12.1 AND 12.5 AND 77.3 BETWEEN 77.2 AND 77.6 AND id % 2 = 0) AS touches FROM c""")
def coordinate_text(spark, sf_dir):
    """"lon,lat[,alt] ..." with bad tokens, and whether a vertex lies in a box."""
    lon, lat = 77 + (F.col("o_orderkey") % 100) / 100.0, 12 + (F.col("o_custkey") % 100) / 100.0
    second = F.when(F.col("o_orderkey") % 2 == 0, F.lit("77.3,12.3")).otherwise(F.lit("80.0,13.0,5"))
    raw = F.concat_ws(" ", F.concat_ws(",", lon.cast("string"), lat.cast("string"), F.lit("0")), F.lit("bad,token"), second)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.valid_coordinates(geo.parse_coordinates(raw)).alias("c"))
    return o.select("id", F.size("c").alias("points"), F.get("c", F.lit(0)).lon.alias("lon"), F.get("c", F.lit(0)).lat.alias("lat"), geo.touches(F.col("c"), 77.2, 12.1, 77.6, 12.5).alias("touches"))
