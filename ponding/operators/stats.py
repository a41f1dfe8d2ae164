"""Validation statistics: rank tests, strata, capture curves, samples, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ponding.operators.grid import settle


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by the rational approximation of Abramowitz and Stegun 26.2.17 (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scores: label (0/1), v and the group columns. Area under the ROC curve with midranks for ties, and the two-sided p.

    p_less and p_greater are one-sided: how likely positives rank that low or that high by chance.

    Values are counted first, so the running sum goes over distinct values, not over rows, and
    within ranges of values, to each of which those below are added.
    """
    by = by or []
    hist = scores.where(F.col("v").isNotNull()).groupBy(*by, "v").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = counted_below(hist, by).withColumn("mid", F.col("below") + (F.col("n") + 1) / 2.0)
    s = ranked.groupBy(*by).agg(F.sum("pos").cast("double").alias("n1"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("n0"), F.sum(F.col("pos") * F.col("mid")).alias("r1"), F.sum(F.pow(F.col("n"), F.lit(3)) - F.col("n")).alias("ties"))
    s = s.where("n1 > 0 and n0 > 0").withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n0")
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    off = F.col("u") - F.col("n1") * F.col("n0") / 2
    z = F.greatest((F.abs(off) - 0.5) / sd, F.lit(0.0))
    tail = lambda x: F.when(x >= 0, normal_tail(x)).otherwise(1 - normal_tail(-x))
    ps = [F.least(2 * normal_tail(z), F.lit(1.0)).alias("p"), tail((-off - 0.5) / sd).alias("p_less"), tail((off - 0.5) / sd).alias("p_greater")]
    return s.select(*by, F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"), (F.col("u") / (F.col("n1") * F.col("n0"))).alias("auc"), *ps)


def counted_below(hist: DataFrame, by: list[str]) -> DataFrame:
    """hist: the group columns, v and n, a row for each distinct value. Adds below: how many rows of the group have a smaller value.

    Ranges of (group, value) are summed by themselves, so a group with most of the values is spread over
    tasks; the sums of a group's ranges, one for each task at most, are added up after.
    """
    parts = settle(hist.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("part", *by).agg(F.sum("n").alias("n")).select("part", *by, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    # Null groups match as well.
    joined = parts.alias("a").join(sums.alias("b"), [F.col("a.part") == F.col("b.part"), *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]]).select("a.*", "b._before")
    return joined.withColumn("below", F.col("_before") + F.coalesce(F.sum("n").over(own), F.lit(0))).drop("_before", "part")


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """The group columns, share and cut: exact quantiles, linear between neighbours, from counted values instead of one sorted buffer."""
    by = by or []
    v = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counted_below(v, by)
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("size"))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in shares]))
    at = sizes.withColumn("share", wanted).withColumn("place", F.col("share") * (F.col("size") - 1))
    pair = [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    holds = lambda k: (F.col("r.below") <= k(F.col("q.place"))) & (k(F.col("q.place")) < F.col("r.below") + F.col("r.n"))
    hit = ranked.alias("r").join((at if by else F.broadcast(at)).alias("q"), [*pair, holds(F.floor) | holds(F.ceil)]).select("q.*", "r.v", "r.n", "r.below")
    lo, hi = F.min("v"), F.max("v")
    return hit.groupBy(*by, "share", "place").agg((lo + (hi - lo) * (F.col("place") - F.floor("place"))).alias("cut")).select(*by, "share", "cut")


def strata(scores: DataFrame, size: str, k: int = 5) -> DataFrame:
    """Rows with the strata they belong to: k equal parts by quantiles of ``size``, both ends included."""
    edges = quantiles(scores, size, [i / k for i in range(k + 1)]).agg(F.sort_array(F.collect_list(F.struct("share", "cut"))).alias("e"))
    spans = edges.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(i.alias("stratum"), F.element_at("e", i).cut.alias("lo"), F.element_at("e", i + 1).cut.alias("hi")))).alias("s")).select("s.*")
    return scores.join(F.broadcast(spans), F.col(size).between(F.col("lo"), F.col("hi")))


def stratified_auc(scores: DataFrame, size: str, k: int = 5) -> DataFrame:
    """Mean over the strata that hold both labels."""
    return auc(strata(scores, size, k), ["stratum"]).agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("strata"))


def capture_curve(spots: DataFrame, background: DataFrame, shares: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5, 0.7)) -> DataFrame:
    """For each share of the background, by lowest v first, the share of spots that lie in it."""
    cuts = quantiles(background, "v", list(shares))
    return spots.crossJoin(F.broadcast(cuts)).groupBy("share").agg(F.avg((F.col("v") <= F.col("cut")).cast("int")).alias("captured"))


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, the same in every engine: those with the smallest md5 of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key).limit(n)


def bootstrap_mean(df: DataFrame, key: str, value: str, draws: int = 1000) -> DataFrame:
    """95 % interval of the mean over draws; each row's weight in a draw is Poisson(1), from a hash of draw and key.

    A task keeps two sums for each draw while it reads its rows once, so nothing grows with rows times draws.
    """
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums = np.zeros((2, draws))
        for b in batches:
            keys, values = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(keys), 1024):
                x = keys[i : i + 1024, None] + steps
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(cuts, (x >> np.uint64(11)) * 2.0**-53, "right").astype(np.float64)
                sums += w.sum(0), values[i : i + 1024] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(sums[0]), pa.array(sums[1])], names=["draw", "w", "s"])

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(key).alias("key"), F.col(value).cast("double").alias("value"))
    means = rows.mapInArrow(weigh, "draw long, w double, s double").groupBy("draw").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ends = quantiles(means, "m", [0.025, 0.975])
    return ends.agg(F.min("cut").alias("low"), F.max("cut").alias("high"))
