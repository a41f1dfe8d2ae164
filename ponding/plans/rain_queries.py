"""Queries on gauge readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ponding.operators import rain
from ponding.plans.domain import GAUGES, gauges
from ponding.plans.registry import query


@query(f"""WITH {GAUGES}, n AS (SELECT gauge, mm_per_h, lead(mm_per_h) OVER w AS v2, lead(minute) OVER w - minute AS dt FROM gauges WINDOW w AS (PARTITION BY gauge ORDER BY minute, event_id))
SELECT gauge, round(sum((mm_per_h + v2) * dt / 2 / 60), 3) AS trapezoid_mm, round(sum(mm_per_h * dt / 60), 3) AS left_mm FROM n GROUP BY gauge""")
def rain_totals(spark, sf_dir):
    return rain.totals(gauges(spark, sf_dir)).select("gauge", F.round("trapezoid_mm", 3).alias("trapezoid_mm"), F.round("left_mm", 3).alias("left_mm"))


HOURLY = f"{GAUGES}, hourly AS (SELECT gauge, floor(minute / 60)::BIGINT AS hour, sum(mm_per_h) AS mm, count(*) AS readings FROM gauges GROUP BY ALL)"


@query(f"""WITH {HOURLY} SELECT gauge, hour, round(mm, 4) AS mm, readings, round(coalesce(sum(mm) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0), 4) AS past_mm,
round(sum(mm) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 4) AS next_mm FROM hourly WINDOW w AS (PARTITION BY gauge ORDER BY hour)""")
def rain_six_hours_around(spark, sf_dir):
    out = rain.around(rain.hourly(gauges(spark, sf_dir)))
    return out.select("gauge", "hour", F.round("mm", 4).alias("mm"), "readings", F.round("past_mm", 4).alias("past_mm"), F.round("next_mm", 4).alias("next_mm"))


@query(f"""WITH {HOURLY}, m AS (SELECT gauge, round(sum(mm), 4) AS total_mm, round(max(mm), 4) AS max_mm FROM hourly GROUP BY gauge),
f AS (SELECT gauge, hour AS wettest_hour FROM hourly QUALIFY row_number() OVER (PARTITION BY gauge ORDER BY mm DESC, hour) = 1)
SELECT gauge, total_mm, max_mm, wettest_hour FROM m JOIN f USING (gauge)""")
def rain_wettest_hour(spark, sf_dir):
    return rain.wettest(rain.hourly(gauges(spark, sf_dir))).select("gauge", F.round("total_mm", 4).alias("total_mm"), F.round("max_mm", 4).alias("max_mm"), "wettest_hour")


@query(f"""WITH {GAUGES}, one AS (SELECT gauge, minute, min(mm_per_h) AS v FROM gauges GROUP BY ALL),
s AS (SELECT gauge, minute AS t0, v AS v0, lead(minute) OVER w AS t1, lead(v) OVER w AS v1, row_number() OVER w AS k FROM one WINDOW w AS (PARTITION BY gauge ORDER BY minute)),
times AS (SELECT g.gauge, (r.range * 180)::DOUBLE AS t FROM (SELECT DISTINCT gauge FROM gauges) g, range(0, 241) r)
SELECT t.gauge, t.t, round(coalesce(CASE WHEN s.t1 IS NOT NULL THEN s.v0 + (s.v1 - s.v0) * (t.t - s.t0) / (s.t1 - s.t0) WHEN s.t0 = t.t THEN s.v0 END, CASE WHEN f.t0 > t.t THEN f.v0 END, 0), 4) AS mm_per_h
FROM times t ASOF LEFT JOIN s ON t.gauge = s.gauge AND t.t >= s.t0 LEFT JOIN s f ON f.gauge = t.gauge AND f.k = 1""")
def rain_interpolated(spark, sf_dir):
    g = gauges(spark, sf_dir)
    times = g.select("gauge").distinct().crossJoin(F.broadcast(spark.range(0, 241).select((F.col("id") * 180).cast("double").alias("t"))))
    return rain.interpolated(g, times).select("gauge", "t", F.round("mm_per_h", 4).alias("mm_per_h"))


@query(f"""WITH {GAUGES}, n AS (SELECT *, CASE WHEN minute - lag(minute) OVER w <= 360 THEN 0 ELSE 1 END AS new FROM gauges WINDOW w AS (PARTITION BY gauge ORDER BY minute, event_id)),
m AS (SELECT *, sum(new) OVER (PARTITION BY gauge ORDER BY minute, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS storm FROM n)
SELECT gauge, storm, round(min(minute), 3) AS begin, round(max(minute), 3) AS "end", count(*) AS readings, round(sum(mm_per_h), 4) AS mm FROM m GROUP BY gauge, storm""")
def rain_storms(spark, sf_dir):
    return rain.storms(gauges(spark, sf_dir)).select("gauge", "storm", F.round("begin", 3).alias("begin"), F.round("end", 3).alias("end"), "readings", F.round("mm", 4).alias("mm"))


@query("""SELECT date_trunc('minute', time_bucket(INTERVAL 30 MINUTES, ts)) AS begin, count(*) AS readings, round(sum(value), 4) AS mm, round(max(value), 4) AS peak FROM events GROUP BY 1""")
def rain_half_hours(spark, sf_dir):
    g = gauges(spark, sf_dir)
    return g.groupBy(F.window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("readings"), F.round(F.sum("mm_per_h"), 4).alias("mm"), F.round(F.max("mm_per_h"), 4).alias("peak")).select(F.col("w.start").alias("begin"), "readings", "mm", "peak")


SCS = "CASE WHEN rain_mm > 0.2 * (25400.0::DOUBLE / {cn} - 254) THEN (rain_mm - 0.2 * (25400.0::DOUBLE / {cn} - 254)) ** 2 / (rain_mm + 0.8 * (25400.0::DOUBLE / {cn} - 254)) ELSE 0 END"


@query(f"""WITH {HOURLY}, s AS (SELECT gauge, hour, sum(mm) OVER (PARTITION BY gauge ORDER BY hour) AS rain_mm FROM hourly),
q AS (SELECT *, 0.4 * ({SCS.format(cn=98.0)}) + 0.6 * ({SCS.format(cn=79.0)}) AS runoff_mm FROM s)
SELECT gauge, hour, round(rain_mm, 4) AS rain_mm, round(runoff_mm, 4) AS runoff_mm, round(runoff_mm - coalesce(lag(runoff_mm) OVER (PARTITION BY gauge ORDER BY hour), 0), 4) AS excess_mm FROM q""")
def rain_cumulative_excess(spark, sf_dir):
    steps = rain.hourly(gauges(spark, sf_dir)).withColumnRenamed("hour", "step")
    out = rain.cumulative_excess(steps, F.lit(0.4), F.lit(79.0), key="gauge")
    return out.select("gauge", F.col("step").alias("hour"), *[F.round(c, 4).alias(c) for c in ("rain_mm", "runoff_mm", "excess_mm")])


@query("""WITH c AS (SELECT event_type, CASE WHEN value > 15 THEN 'heavy' WHEN value > 7 THEN 'moderate' ELSE 'light' END AS class, count(*) AS readings,
 sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END)::BIGINT AS flooded, round(sum(value), 2)::DECIMAL(18,2)::VARCHAR AS s FROM events GROUP BY 1, 2)
SELECT event_type, class, readings, flooded, sha1(event_type || '|' || s)[1:12] AS token FROM c""")
def rain_classes_and_token(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.when(F.col("value") > 15, "heavy").when(F.col("value") > 7, "moderate").otherwise("light").alias("class")
    token = F.substring(F.sha1(F.concat_ws("|", "event_type", F.round(F.sum("value"), 2).cast("decimal(18,2)").cast("string"))), 1, 12)
    return g.groupBy("event_type", label).agg(F.count(F.lit(1)).alias("readings"), F.count_if(F.col("value") >= 10).alias("flooded"), token.alias("token"))
