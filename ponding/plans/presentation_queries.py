"""Queries for colours, leads, labels, resampling and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ponding.functions import presentation
from ponding.operators import resample
from ponding.plans.domain import SURVEY, read, survey
from ponding.plans.registry import query

STOPS = ((0.0, "#ffffff"), (15.0, "#ffd27f"), (50.0, "#d7301f"), (80.0, "#4a0010"))
LIN = "CASE WHEN d <= 0 THEN {a} WHEN d < 15 THEN {a} + ({b} - {a}) * d / 15 WHEN d < 50 THEN {b} + ({c} - {b}) * (d - 15) / 35 WHEN d < 80 THEN {c} + ({e} - {c}) * (d - 50) / 30 ELSE {e} END"


@query(f"WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE * 2 AS d FROM lineitem) SELECT DISTINCT d, round({LIN.format(a='255.0', b='255.0', c='215.0', e='74.0')})::INT AS r, round({LIN.format(a='255.0', b='210.0', c='48.0', e='0.0')})::INT AS g, round({LIN.format(a='255.0', b='127.0', c='31.0', e='16.0')})::INT AS b FROM s")
def colour_ramp(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("double") * 2).alias("d")).distinct()
    return d.select("d", presentation.ramp(F.col("d"), STOPS).alias("c")).select("d", "c.*")


@query("SELECT event_id, CASE WHEN m BETWEEN 0 AND 180 THEN (CASE WHEN m % 15 <= 7.5 THEN floor(m / 15) ELSE floor(m / 15) + 1 END * 15)::INT END AS lead, strftime(ts + INTERVAL 330 MINUTES, '%Y-%m-%dT%H:00') AS hour FROM (SELECT event_id, ts, (event_id % 200)::DOUBLE AS m FROM events)")
def leads_and_local_hours(spark, sf_dir):
    m = (F.col("event_id") % 200).cast("double")
    return read(spark, sf_dir, "events").select("event_id", presentation.nearest_lead(m).alias("lead"), presentation.local_hour(F.col("ts").cast("timestamp")).alias("hour"))


@query(f"""WITH {SURVEY}, t AS (SELECT (range // (2 * n))::INT AS i, (range % (2 * n))::INT AS j, n, (n - 1) / (2 * n - 1.0)::DOUBLE AS step FROM range((SELECT 4 * n * n FROM g)::BIGINT), g),
p AS (SELECT *, i * step AS y, j * step AS x, least(floor(i * step), n - 2)::INT AS r0, least(floor(j * step), n - 2)::INT AS c0 FROM t) SELECT i AS row, j AS col, round(sum(z * (CASE WHEN d.row = r0 THEN 1 - (p.y - r0) ELSE p.y - r0 END) * (CASE WHEN d.col = c0 THEN 1 - (p.x - c0) ELSE p.x - c0 END)), 4) AS v
FROM p JOIN dem d ON d.row IN (r0, r0 + 1) AND d.col IN (c0, c0 + 1) GROUP BY i, j""")
def bilinear_resize(spark, sf_dir):
    """The survey at twice as many nodes along each axis."""
    c, n = survey(spark, sf_dir)
    return resample.bilinear(c, n, 2 * n, "z").select("row", "col", F.round("z", 4).alias("v"))


KERNEL = "CASE WHEN abs({d}) < 1 THEN 1.5 * abs({d}) ** 3 - 2.5 * {d} ** 2 + 1 WHEN abs({d}) < 2 THEN -0.5 * abs({d}) ** 3 + 2.5 * {d} ** 2 - 4 * abs({d}) + 2 ELSE 0 END"


@query(f"""WITH {SURVEY}, t AS (SELECT range::INT AS i, (range + 0.5::DOUBLE) / 3 - 0.5 AS p FROM range((SELECT 3 * n FROM g)::BIGINT)), taps AS (SELECT i, k::INT AS k, p - k AS d FROM t, g, LATERAL (SELECT unnest(range(floor(p)::BIGINT - 1, floor(p)::BIGINT + 3)) AS k) WHERE k BETWEEN 0 AND n - 1),
w AS (SELECT i, k, ({KERNEL.format(d='d')}) / sum({KERNEL.format(d='d')}) OVER (PARTITION BY i) AS w FROM taps), a AS (SELECT row, w.i AS col, sum(z * w) AS z FROM dem JOIN w ON k = col GROUP BY ALL)
SELECT w.i AS row, col, round(sum(z * w), 4) AS z FROM a JOIN w ON k = row GROUP BY ALL""")
def bicubic_enlargement(spark, sf_dir):
    """The survey at three times as many pixels along each axis, as the overlay is drawn."""
    c, n = survey(spark, sf_dir)
    return resample.bicubic(c.select("row", "col", "z"), 3, n, "z").select("row", "col", F.round("z", 4).alias("z"))


@query("SELECT date_trunc('hour', ts) AS begin, round(avg(CASE WHEN value - 2 >= 0 THEN value - 2 END), 4) AS mean_mm_per_h, round(max(CASE WHEN value - 2 >= 0 THEN value - 2 END), 4) AS peak_mm_per_h FROM events WHERE user_id % 36 BETWEEN 5 AND 20 AND user_id % 18 BETWEEN 2 AND 9 GROUP BY 1")
def box_rain(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("begin"), (F.col("user_id") % 36).alias("lon"), (F.col("user_id") % 18).alias("lat"), (F.col("value") - 2).alias("mm_per_h"))
    return resample.box_rain(e, 5, 2, 20, 9).select("begin", F.round("mean_mm_per_h", 4).alias("mean_mm_per_h"), F.round("peak_mm_per_h", 4).alias("peak_mm_per_h"))


@query("SELECT event_type || user_id AS token, max(event_id) AS seq FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def newest_tokens(spark, sf_dir):
    return resample.newest(read(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("token"), F.col("event_id").alias("seq")))
