"""Rain forecasts as streams: a store whose entries expire, and depths that follow the newest forecast."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ponding.functions import hydro
from ponding.operators import grid

#: How long an answer is kept, in seconds, after success and after failure (fixed values).
KEPT_S = {True: 900, False: 60}
#: How many forecasts are kept (fixed value), and the reach of the smoothing in cells.
MOST, SIGMA = 6, 1.2
ANSWERS = "place string, ts timestamp, what string, available boolean, body string"
SERIES = "city string, issued timestamp, series array<struct<minutes:double,mm_per_h:double>>"


class Expiring(StatefulProcessor):
    """One entry for each place: requests are served from it until it expires, then what the source says replaces it."""

    def __init__(self, kept_s: dict[bool, int]):
        self.kept_ms = {k: int(v * 1000) for k, v in kept_s.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "expires long, available boolean, body string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        out = []
        asked = pd.concat(list(rows)).sort_values("ts", kind="stable")
        entry = self.entry.get() if self.entry.exists() else None
        for ts, available, body in zip(asked["ts"], asked["available"], asked["body"], strict=True):
            now = ts.value // 1_000_000
            if entry is not None and now < entry[0]:
                out.append((key[0], ts, "served", bool(entry[1]), entry[2]))
                continue
            if entry is not None:
                self.handle.deleteTimer(entry[0])
            entry = (now + self.kept_ms[bool(available)], bool(available), body)
            self.handle.registerTimer(entry[0])
            out.append((key[0], ts, "fetched", *entry[1:]))
        self.entry.update(entry)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        entry = self.entry.get() if self.entry.exists() else None
        if entry is not None and entry[0] <= at:
            self.entry.clear()
            yield self.frame([(key[0], pd.Timestamp(at, unit="ms"), "expired", bool(entry[1]), entry[2])])

    def close(self) -> None:
        pass

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["place", "ts", "what", "available", "body"])


def expiring(requests: DataFrame, late: str = "0 seconds", kept_s: dict[bool, int] | None = None) -> DataFrame:
    """requests: a stream of place, ts, and what the source would answer then (available, body).

    place, ts, what (fetched, served from the store, or expired), available, body. Expiry goes by event time,
    so a store does not grow with places that nobody asks for any more. Needs the RocksDB state store.
    """
    src = requests.select("place", "ts", "available", "body").withWatermark("ts", late)
    return src.groupBy("place").transformWithStateInPandas(statefulProcessor=Expiring(kept_s or KEPT_S), outputStructType=ANSWERS, outputMode="append", timeMode="eventTime")


def usable(series: Column) -> Column:
    """Points with both numbers, rain not below 0, in order of minutes."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.filter(series, lambda p: finite(p.minutes) & finite(p.mm_per_h))
    return F.array_sort(F.transform(good, lambda p: F.struct(p.minutes.alias("minutes"), F.greatest(p.mm_per_h, F.lit(0.0)).alias("mm_per_h"))))


def rain_at(series: Column, t: Column) -> Column:
    """Rain at minute t: linear between the points of an ordered series, the first value before them, 0 after them."""
    before = F.size(F.filter(series, lambda p: p.minutes <= t))
    a, b = F.get(series, before - 1), F.get(series, before)
    between = a.mm_per_h + (b.mm_per_h - a.mm_per_h) * (t - a.minutes) / (b.minutes - a.minutes)
    last = F.element_at(series, -1)
    return F.when(before == 0, F.get(series, F.lit(0)).mm_per_h).when(t > last.minutes, F.lit(0.0)).when(before == F.size(series), last.mm_per_h).otherwise(between)


def token(city: Column, series: Column) -> Column:
    """Names a forecast by its content."""
    points = F.transform(series, lambda p: F.format_string("%.1f %.2f", p.minutes, p.mm_per_h))
    return F.substring(F.sha1(F.concat_ws("|", city, points).cast("binary")), 1, 12)


def total_mm(series: Column) -> Column:
    """Trapezoids between the points."""
    pairs = F.zip_with(F.slice(series, F.lit(1), F.size(series) - 1), F.slice(series, F.lit(2), F.size(series) - 1), lambda a, b: (a.mm_per_h + b.mm_per_h) / 2 * (b.minutes - a.minutes))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 60


class Nowcasts:
    """A store of the newest forecasts, their depths on edges at each lead, fed batch by batch.

    cells: city, row, col, impervious, capacity (mm/h), low; bridge: city, eid, row, col (of
    ``network.edge_cells``), which no forecast changes; n: cells along each axis.

    What a batch leaves lies in folders named by its id and is written anew if the batch is
    repeated, tokens after edges, so a repeat or a crash changes nothing. A forecast that an earlier batch
    brought is not computed again. A batch keeps the newest series of each city; series with
    fewer than two usable points are dropped.
    """

    def __init__(self, folder: str, cells: DataFrame, bridge: DataFrame, n: int, most: int = MOST, sigma: float | None = SIGMA):
        self.folder, self.cells, self.bridge, self.n, self.most, self.sigma = folder.rstrip("/"), cells, bridge, n, most, sigma
        self.spark: SparkSession = cells.sparkSession

    def start(self, forecasts: DataFrame, checkpoint: str):
        """forecasts: a stream of city, issued, series."""
        return forecasts.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).start()

    def take(self, batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("city").agg(F.max_by(F.struct("issued", "series"), "issued").alias("f")).select("city", "f.issued", usable(F.col("f.series")).alias("series")).where(F.size("series") >= 2)
        own = newest.withColumn("token", token(F.col("city"), F.col("series")))
        earlier = self._read("tokens")
        if earlier is not None:
            own = own.join(earlier.where(F.col("batch") < batch_id).select("token"), "token", "left_anti")
        own = grid.settle(own)
        try:
            depths = grid.settle(self._depths(own))
            edges = self._edges(own, depths)
            edges.write.mode("overwrite").parquet(f"{self.folder}/edges/batch={batch_id}")
            written = self.spark.read.parquet(f"{self.folder}/edges/batch={batch_id}")
            flooded = written.groupBy("token", "eid").agg(F.max("depth_cm").alias("d")).groupBy("token").agg(F.count_if(F.col("d") >= hydro.FLOODED_CM).alias("flooded_edges"))
            deepest = depths.groupBy("token").agg(F.max("depth_cm").alias("max_depth_cm"))
            peak = F.array_max(F.transform("series", lambda p: p.mm_per_h))
            out = own.select("token", "city", "issued", total_mm(F.col("series")).alias("total_mm"), peak.alias("peak_mm_per_h")).join(deepest, "token", "left").join(flooded, "token", "left")
            out.withColumn("flooded_edges", F.coalesce("flooded_edges", F.lit(0).cast("long"))).write.mode("overwrite").parquet(f"{self.folder}/tokens/batch={batch_id}")
            grid.drop(depths)
        finally:
            grid.drop(own)
        self._forget()

    def _depths(self, own: DataFrame) -> DataFrame:
        t = F.explode(F.sequence(F.lit(0), F.lit((hydro.STEPS - 1) * hydro.STEP_MIN), F.lit(hydro.STEP_MIN)))
        rain = own.select("token", "city", "series", t.alias("t")).select("token", "city", "t", rain_at(F.col("series"), F.col("t")).alias("mm_per_h"))
        steps = self.cells.join(rain, "city").withColumn("net", (F.col("mm_per_h") * F.col("impervious") - F.col("capacity")) * (hydro.STEP_MIN / 60.0))
        deep = grid.balanced(steps, "token", "row", "col").select("token", "lead", "row", "col", hydro.depth_cm(F.col("storage"), F.col("low")).alias("depth_cm"))
        return grid.gaussian(deep, self.n, self.sigma, "depth_cm", ["token", "lead"]) if self.sigma else deep

    def _edges(self, own: DataFrame, depths: DataFrame) -> DataFrame:
        crossed = self.bridge.join(own.select("token", "city"), "city").select("token", "eid", "row", "col")
        return crossed.join(depths, ["token", "row", "col"]).groupBy("token", "eid", "lead").agg(F.max("depth_cm").alias("depth_cm"))

    def _path(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> DataFrame | None:
        where, files = self._path(name)
        return self.spark.read.parquet(f"{self.folder}/{name}") if files.exists(where) else None

    def tokens(self) -> DataFrame:
        """The newest forecasts, at most ``most``: token, city, issued, total_mm, peak_mm_per_h, max_depth_cm, flooded_edges, batch."""
        return self._read("tokens").orderBy(F.desc("batch"), F.desc("issued"), "token").limit(self.most)

    def edges(self) -> DataFrame:
        """token, eid, lead, depth_cm of the forecasts that are kept."""
        return self._read("edges").drop("batch").join(F.broadcast(self.tokens().select("token")), "token", "left_semi")

    def _forget(self) -> None:
        """Deletes batches that hold none of the newest forecasts."""
        oldest = self.tokens().agg(F.min("batch")).first()[0]
        if oldest is None:
            return
        for name in ("tokens", "edges"):
            where, files = self._path(name)
            for f in files.listStatus(where):
                number = f.getPath().getName().partition("=")[2]
                if number and int(number) < oldest:
                    files.delete(f.getPath(), True)
