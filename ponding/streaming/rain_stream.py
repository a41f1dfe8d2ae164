"""Rain readings as a stream: windows with a watermark, storms as sessions, storage kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READING = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def readings(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """gauge, ts, mm_per_h from Parquet files as they arrive."""
    src = spark.readStream.schema(READING).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return src.select(F.col("user_id").alias("gauge"), "ts", F.greatest("value", F.lit(0.0)).alias("mm_per_h"))


def window_sums(stream: DataFrame, width: str = "30 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Sum, peak and number of readings per gauge and window; readings later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy("gauge", w.alias("w")).agg(F.sum("mm_per_h").alias("mm"), F.max("mm_per_h").alias("peak"), F.count(F.lit(1)).alias("readings"))
    return out.select("gauge", F.col("w.start").alias("begin"), "mm", "peak", "readings")


def storms(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Storm events: sessions that end with a dry pause."""
    s = stream.withWatermark("ts", late).groupBy("gauge", F.session_window("ts", gap).alias("w")).agg(F.sum("mm_per_h").alias("mm"), F.count(F.lit(1)).alias("readings"))
    return s.select("gauge", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "mm", "readings")


def latest(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The newest reading of each gauge: only the newest wins, whatever order they arrive in."""
    return stream.groupBy("gauge").agg(F.max_by("mm_per_h", "ts").alias("mm_per_h"), F.max("ts").alias("ts"))


def storage(stream: DataFrame, drain_mm_per_h: float = 5.0) -> DataFrame:
    """Water stored at each gauge after each batch's readings: S = max(0, S + rain - drained since the last reading), kept in state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        stored, last = state.get if state.exists else (0.0, None)
        for ts, mm in zip(rows["ts"], rows["mm_per_h"], strict=True):
            now = ts.timestamp()
            gone = drain_mm_per_h * (now - last) / 3600 if last is not None and now > last else 0.0
            stored, last = max(0.0, stored - gone) + float(mm), now if last is None else max(last, now)
        state.update((stored, last))
        yield pd.DataFrame({"gauge": [key[0]], "storage_mm": [stored], "readings": [len(rows)]})

    return stream.groupBy("gauge").applyInPandasWithState(step, "gauge long, storage_mm double, readings long", "storage double, last double", "update", GroupStateTimeout.NoTimeout)
