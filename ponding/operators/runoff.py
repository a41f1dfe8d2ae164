"""Rain to runoff: unit hydrographs, convolution, and routing down a forest of catchments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ponding.functions.hydro import STEP_MIN, lag_hours, ponding_cm, rational_capacity, waterlogging
from ponding.operators.grid import drop, settle

HORIZON_STEPS = 73
DT_H = STEP_MIN / 60.0


def unit_hydrographs(catchments: DataFrame) -> DataFrame:
    """id, j, q: triangular ordinates at step midpoints in m3/s per mm, scaled to one mm over the area. catchments: id, area_ha, cn, slope_pct."""
    lag = lag_hours(F.col("area_ha"), F.col("cn"), F.col("slope_pct"))
    c = catchments.select("id", "area_ha", (F.lit(DT_H / 2) + lag).alias("tp")).withColumn("tb", 2.67 * F.col("tp"))
    steps = F.least(F.ceil(F.col("tb") / DT_H), F.lit(HORIZON_STEPS - 1))
    o = c.withColumn("j", F.explode(F.sequence(F.lit(0), steps.cast("int")))).withColumn("t", F.col("j") * DT_H + DT_H / 2)
    peak = 0.208 * (F.col("area_ha") / 100.0) / F.col("tp")
    shape = F.when(F.col("t") <= F.col("tp"), peak * F.col("t") / F.col("tp")).otherwise(F.greatest(peak * (F.col("tb") - F.col("t")) / (F.col("tb") - F.col("tp")), F.lit(0.0)))
    o = o.withColumn("raw", shape)
    volume = F.sum("raw").over(Window.partitionBy("id")) * (DT_H * 3600)
    return o.select("id", "j", (F.col("raw") * F.col("area_ha") * 10.0 / volume).alias("q"))


#: Catchments whose series one task holds.
SERIES = 5_000


def dealt(catchments: DataFrame, series: int = SERIES) -> DataFrame:
    """The catchments, by id in as many parts as keep each at about ``series``: their series are then made, convolved and summed where they lie."""
    parts = catchments.count() // series + 1
    return catchments.repartition(max(parts, catchments.sparkSession.sparkContext.defaultParallelism), "id")


def convolve(excess: DataFrame, uh: DataFrame, steps: int = HORIZON_STEPS) -> DataFrame:
    """id, step, q: each step's excess spread by its catchment's ordinates; what falls past the horizon goes."""
    pairs = excess.where("excess_mm > 0").join(uh.hint("merge"), "id").withColumn("at", F.col("step") + F.col("j")).where(F.col("at") < steps)
    return pairs.groupBy("id", F.col("at").alias("step")).agg(F.sum(F.col("excess_mm") * F.col("q")).alias("q"))


def levels(catchments: DataFrame) -> DataFrame:
    """id, level: the longest way from a headwater, found by peeling; catchments: id, downstream. A way longer than there are catchments is a circle."""
    level = settle(catchments.select("id", "downstream", F.lit(0).alias("level")))
    for _ in range(level.count() + 1):
        fed = level.where(F.col("downstream").isNotNull()).groupBy(F.col("downstream").alias("id")).agg((F.max("level") + 1).alias("need"))
        new = settle(level.join(fed, "id", "left").select("id", "downstream", F.greatest("level", F.coalesce("need", F.lit(0))).alias("level"), F.col("level").alias("old")))
        level = new.drop("old")
        if not new.where("level > old").limit(1).count():
            return level
    raise ValueError("the catchments drain in a circle")


def cascade(catchments: DataFrame, hydrographs: DataFrame, steps: int = HORIZON_STEPS, speed: float = 1.0) -> DataFrame:
    """Routes flow downstream, level by level: each catchment passes on at most its capacity, later by its receiver's travel time.

    catchments: id, downstream, area_ha, imperv, length_m. Returns id, peak_m3s, capacity_m3s, overflow_m3.
    """
    order = levels(catchments)
    c = settle(catchments.join(order.select("id", "level"), "id"))
    top = int(c.agg(F.max("level")).first()[0] or 0)
    receiver = c.select(F.col("id").alias("downstream"), F.rint(F.col("length_m") / speed / 60 / STEP_MIN).cast("int").alias("shift"))
    area = settle(c.select("id", F.col("area_ha").alias("acc_ha"), (F.col("imperv") * F.col("area_ha")).alias("acc_imp")))
    flow = hydrographs.select("id", "step", "q")
    done = None
    for k in range(top + 1):
        here = c.where(F.col("level") == k).join(area, "id").withColumn("capacity", rational_capacity(F.col("acc_imp"), F.col("acc_ha")))
        q = flow.join(here.select("id", "capacity", "downstream"), "id")
        own = q.groupBy("id").agg(F.max("q").alias("peak_m3s"), F.max("capacity").alias("capacity_m3s"), F.sum(F.greatest(F.col("q") - F.col("capacity"), F.lit(0.0)) * 300).alias("overflow_m3"))
        done = own if done is None else done.unionByName(own)
        sent = q.where(F.col("downstream").isNotNull()).join(receiver, "downstream").select(F.col("downstream").alias("id"), (F.col("step") + F.col("shift")).alias("step"), F.least("q", "capacity").alias("q")).where(F.col("step") < steps)
        rest = flow.join(c.where(F.col("level") > k).select("id"), "id", "left_semi")
        flow = settle(rest.unionByName(sent).groupBy("id", "step").agg(F.sum("q").alias("q")))
        given = here.where(F.col("downstream").isNotNull()).groupBy(F.col("downstream").alias("id")).agg(F.sum("acc_ha").alias("a"), F.sum("acc_imp").alias("i"))
        area = settle(area.join(given, "id", "left").select("id", (F.col("acc_ha") + F.coalesce("a", F.lit(0.0))).alias("acc_ha"), (F.col("acc_imp") + F.coalesce("i", F.lit(0.0))).alias("acc_imp")))
    return settle(done)


def classify(routed: DataFrame, catchments: DataFrame, low_share: Column | None = None) -> DataFrame:
    """Adds ponding depth and class from overflow on low ground."""
    low = (low_share if low_share is not None else F.lit(0.1)) * F.col("area_ha") * 10_000.0
    out = routed.join(catchments.drop("overflow_m3"), "id").withColumn("ponding_cm", ponding_cm(F.col("overflow_m3"), low, F.col("area_ha"), F.col("water_share")))
    return out.withColumn("waterlogging", waterlogging(F.col("ponding_cm"), F.col("water_share")))


def strahler(links: DataFrame) -> DataFrame:
    """id, strahler: 1 at headwaters; one more than the largest inflow where two or more inflows share it.

    A link with one inflow has its order, so chains are contracted first (by doubling); the
    rest goes on, from junction to junction, until no order changes.
    """
    inflows = links.where(F.col("downstream").isNotNull()).groupBy(F.col("downstream").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    flow = settle(links.select("id", "downstream").join(inflows, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    junctions = flow.where("n >= 2").select("id")
    # Of each headwater and junction the next junction below; of a link with one inflow the headwater or junction above.
    below = settle(first_below(flow.select("id", "downstream"), junctions).join(flow.where("n <> 1").select("id"), "id", "left_semi"))
    order = settle(below.select("id", F.lit(1).alias("s")))
    while True:
        best = below.where(F.col("receiver").isNotNull()).join(order, "id").groupBy(F.col("receiver").alias("id"), "s").count()
        top = best.groupBy("id").agg(F.max(F.struct("s", "count")).alias("b")).select("id", (F.col("b.s") + (F.col("b.count") > 1).cast("int")).alias("new"))
        nxt = settle(order.join(top, "id", "left").select("id", F.greatest("s", F.coalesce("new", F.lit(1))).alias("s"), F.col("s").alias("old")))
        changed = nxt.where("s <> old").limit(1).count()
        drop(order)
        order = nxt.drop("old")
        order.stored_at = nxt.stored_at
        if not changed:
            break
    # A chain hands its order down: walk up single inflows to where they begin.
    single = flow.where("n = 1").select("id")
    up = flow.where(F.col("downstream").isNotNull()).join(single.withColumnRenamed("id", "downstream"), "downstream").select(F.col("downstream").alias("id"), F.col("id").alias("upstream"))
    turned = flow.select("id").join(up, "id", "left").withColumnRenamed("upstream", "downstream")
    source = first_below(turned, order.select("id")).join(single, "id").select("id", F.col("receiver").alias("from"))
    chained = source.join(order.select(F.col("id").alias("from"), "s"), "from").select("id", "s")
    return order.select("id", F.col("s").alias("strahler")).unionByName(chained.withColumnRenamed("s", "strahler"))


def first_below(flow: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, receiver: the first node strictly downstream that is wanted, null where there is none. Doubling, so few rounds; joins are by sorting, as files of such tables are small and would be broadcast."""
    stop = wanted.select("id", F.lit(True).alias("want"))
    at = settle(flow.select("id", F.col("downstream").alias("at")))
    marked = settle(flow.join(stop.hint("merge"), "id", "left").select(F.col("id").alias("at"), F.when(F.coalesce("want", F.lit(False)), F.col("id")).otherwise(F.col("downstream")).alias("next"), F.coalesce("want", F.lit(False)).alias("halt")))
    for _ in range(64):
        new = settle(at.join(marked.select("at", "next").hint("merge"), "at", "left").select("id", F.col("next").alias("at"), (~F.col("next").eqNullSafe(F.col("at"))).alias("moved")))
        at = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return at.select("id", F.col("at").alias("receiver"))
        jump = marked.select(F.col("at").alias("next"), F.col("next").alias("next2"), F.col("halt").alias("halt2"))
        marked = settle(marked.join(jump.hint("merge"), "next", "left").select("at", F.when(F.col("halt"), F.col("next")).otherwise(F.col("next2")).alias("next"), "halt"))
    raise ValueError("the nodes drain in a circle")


#: From this share of low ground on a catchment keeps water, and from this share of open water on it is a lake (fixed values).
RECEIVER_LOW_SHARE, LAKE_SHARE = 0.2, 0.3


def receivers(flow: DataFrame, keeps: DataFrame) -> DataFrame:
    """id, receiver: the catchment itself if it keeps water, else the first below that does; null where water leaves the area."""
    own = keeps.select("id", F.lit(True).alias("own"))
    return first_below(flow, keeps).join(own.hint("merge"), "id", "left").select("id", F.when(F.col("own"), F.col("id")).otherwise(F.col("receiver")).alias("receiver"))


def arrivals(catchments: DataFrame) -> DataFrame:
    """catchments: id, downstream, low_share, water_share, area_ha, overflow_m3. Per receiver: id, senders, arrive_m3 and pond_cm, its depth on the low ground (0 on lakes)."""
    to = receivers(catchments.select("id", "downstream"), catchments.where(F.col("low_share") >= RECEIVER_LOW_SHARE).select("id"))
    sent = catchments.where(F.col("overflow_m3") > 0).select("id", "overflow_m3").join(to.hint("merge"), "id").where(F.col("receiver").isNotNull())
    arrived = sent.groupBy(F.col("receiver").alias("id")).agg(F.count(F.lit(1)).alias("senders"), F.sum("overflow_m3").alias("arrive_m3"))
    deep = F.col("arrive_m3") / F.greatest(F.col("low_share") * F.col("area_ha") * 10_000.0, F.lit(1.0)) * 100
    return arrived.join(catchments.hint("merge"), "id").select("id", "senders", "arrive_m3", F.when(F.col("water_share") >= LAKE_SHARE, 0.0).otherwise(deep).alias("pond_cm"))
