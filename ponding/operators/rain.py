"""Rain series: totals, sums around a moment, interpolation, losses, storms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ponding.functions.hydro import STEP_MIN, composite_runoff


def by_series(*extra: str) -> Window:
    return Window.partitionBy("gauge").orderBy("minute", *extra)


def clean(points: DataFrame) -> DataFrame:
    """Readings with a numeric time and value, negative rain taken as none; malformed points go."""
    p = points.select("gauge", F.col("minute").try_cast("double").alias("minute"), F.greatest(F.col("mm_per_h").try_cast("double"), F.lit(0.0)).alias("mm_per_h"))
    return p.where(F.col("minute").isNotNull() & F.col("mm_per_h").isNotNull() & ~F.isnan("minute") & ~F.isnan("mm_per_h"))


def totals(points: DataFrame) -> DataFrame:
    """Two totals in mm: by trapezoids (nowcast) and by left rectangles (drainage model)."""
    w = by_series("event_id")
    nxt = points.select("gauge", "mm_per_h", F.lead("mm_per_h").over(w).alias("v2"), (F.lead("minute").over(w) - F.col("minute")).alias("dt"))
    return nxt.groupBy("gauge").agg(F.sum((F.col("mm_per_h") + F.col("v2")) * F.col("dt") / 2 / 60).alias("trapezoid_mm"), F.sum(F.col("mm_per_h") * F.col("dt") / 60).alias("left_mm"))


def hourly(points: DataFrame) -> DataFrame:
    """Sum and number of readings in each clock hour with any."""
    hour = F.floor(F.col("minute") / 60).alias("hour")
    return points.groupBy("gauge", hour).agg(F.sum("mm_per_h").alias("mm"), F.count(F.lit(1)).alias("readings"))


def around(hours: DataFrame, before: int = 6, after: int = 6) -> DataFrame:
    """For each hour the sums of the ``before`` entries before it and of the ``after`` entries from it on."""
    w = Window.partitionBy("gauge").orderBy("hour")
    return hours.withColumn("past_mm", F.coalesce(F.sum("mm").over(w.rowsBetween(-before, -1)), F.lit(0.0))).withColumn("next_mm", F.sum("mm").over(w.rowsBetween(0, after - 1)))


def wettest(hours: DataFrame) -> DataFrame:
    """The total and the wettest hour; the first of equals."""
    return hours.groupBy("gauge").agg(F.sum("mm").alias("total_mm"), F.max("mm").alias("max_mm"), F.min_by("hour", F.struct(-F.col("mm"), "hour")).alias("wettest_hour"))


def segments(points: DataFrame) -> DataFrame:
    """Pieces between neighbouring readings, one before the first, that holds its value."""
    w = by_series()
    one = points.groupBy("gauge", "minute").agg(F.min("mm_per_h").alias("mm_per_h"))
    inner = one.select("gauge", F.col("minute").alias("t0"), F.lead("minute").over(w).alias("t1"), F.col("mm_per_h").alias("v0"), F.lead("mm_per_h").over(w).alias("v1"), F.row_number().over(w).alias("k"))
    first = inner.where("k = 1").select("gauge", F.lit(float("-inf")).alias("t0"), F.col("t0").alias("t1"), "v0", F.col("v0").alias("v1"))
    last = inner.where(F.col("t1").isNull()).select("gauge", "t0", F.col("t0").alias("t1"), "v0", F.col("v0").alias("v1"))
    return inner.where(F.col("t1").isNotNull()).drop("k").unionByName(first).unionByName(last)


def interpolated(points: DataFrame, times: DataFrame, block: float = 720.0) -> DataFrame:
    """times: gauge, t. Rain at each time: linear between readings, the first value before them, 0 after the last.

    Segments and times meet by blocks of time, so that the range join is an equi-join first.
    """
    seg = segments(points)
    lo, hi = F.floor(F.greatest(F.col("t0"), F.lit(0.0)) / block), F.floor(F.least(F.col("t1"), F.lit(1e9)) / block)
    blocks = seg.withColumn("b", F.explode(F.sequence(F.least(lo, hi), hi)))
    at = times.withColumn("b", F.floor(F.col("t") / block))
    inside = (F.col("t") >= F.col("t0")) & ((F.col("t") < F.col("t1")) | ((F.col("t0") == F.col("t1")) & (F.col("t") == F.col("t1"))))
    value = F.when(F.col("t1") > F.col("t0"), F.when(F.col("t0") == float("-inf"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))).otherwise(F.col("v0"))
    hit = at.join(blocks, ["gauge", "b"]).where(inside).groupBy("gauge", "t").agg(F.max(value).alias("mm_per_h"))
    return times.join(hit, ["gauge", "t"], "left").withColumn("mm_per_h", F.coalesce("mm_per_h", F.lit(0.0)))


def cumulative_excess(steps: DataFrame, impervious: Column, cn: Column, key: str = "id") -> DataFrame:
    """steps: key, step, mm. Running rain, running runoff and each step's share of it."""
    w = Window.partitionBy(key).orderBy("step")
    run = steps.withColumn("rain_mm", F.sum("mm").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("runoff_mm", composite_runoff(F.col("rain_mm"), impervious, cn))
    return run.withColumn("excess_mm", F.col("runoff_mm") - F.coalesce(F.lag("runoff_mm").over(w), F.lit(0.0)))


def storms(points: DataFrame, gap_min: float = 360.0) -> DataFrame:
    """Rain events: runs of readings with no pause longer than the gap."""
    w = by_series("event_id")
    new = F.coalesce((F.col("minute") - F.lag("minute").over(w) > gap_min).cast("int"), F.lit(1))
    marked = points.withColumn("new", new)
    marked = marked.withColumn("storm", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("gauge", "storm").agg(F.min("minute").alias("begin"), F.max("minute").alias("end"), F.count(F.lit(1)).alias("readings"), F.sum("mm_per_h").alias("mm"))


def block_hyetograph(spark, total_mm: float, duration_min: int, horizon_min: int = 360) -> DataFrame:
    """A uniform block of rain on the model's steps: step, t, mm_per_h."""
    t = F.col("id") * STEP_MIN
    return spark.range(horizon_min // STEP_MIN + 1).select(F.col("id").alias("step"), t.alias("t"), F.when(t < duration_min, F.lit(total_mm * 60.0 / duration_min)).otherwise(F.lit(0.0)).alias("mm_per_h"))
