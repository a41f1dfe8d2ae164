"""Stores that expire, and depths that follow the newest forecast."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ponding.streaming import forecasts

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_entries_expire(rocks, tmp_path):
    """Served up to 900 s after a success and 60 s after a failure; when time has passed the limits, entries go."""
    spark, folder = rocks, str(tmp_path / "in")
    schema = "place string, ts timestamp, available boolean, body string"

    def ask(*rows):
        spark.createDataFrame([(p, at(s), ok, body) for p, s, ok, body in rows], schema).coalesce(1).write.mode("append").parquet(folder)

    ask(("a", 0, True, "a0"), ("b", 0, False, "refused"), ("a", 500, True, "a500"))
    stream = spark.readStream.schema(schema).parquet(folder)
    query = forecasts.expiring(stream).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()

    def seen():
        query.processAllAvailable()
        return sorted((r.place, int((r.ts.replace(tzinfo=datetime.timezone.utc) - T0).total_seconds()), r.what, r.available, r.body) for r in spark.table("answers").collect())

    first = [("a", 0, "fetched", True, "a0"), ("a", 500, "served", True, "a0"), ("b", 0, "fetched", False, "refused")]
    # b's failure has been forgotten by second 500; a's answer has not.
    assert seen() == sorted([*first, ("b", 60, "expired", False, "refused")])
    ask(("a", 899, True, "a899"), ("b", 700, True, "b700"))
    second = [*first, ("b", 60, "expired", False, "refused"), ("a", 899, "served", True, "a0"), ("b", 700, "fetched", True, "b700")]
    assert seen() == sorted(second)
    ask(("a", 900, True, "a900"), ("c", 901, False, "c901"))
    got = seen()
    assert ("a", 900, "fetched", True, "a900") in got and ("a", 900, "expired", True, "a0") not in got
    ask(("d", 5000, True, "d"))
    assert {("a", 1800, "expired", True, "a900"), ("b", 1600, "expired", True, "b700"), ("c", 961, "expired", False, "c901")} <= set(seen())
    query.stop()


N = 6


def town(spark):
    cells = spark.range(2 * N * N).select(F.when(F.col("id") < N * N, "east").otherwise("west").alias("city"), (F.col("id") % (N * N) / N).cast("int").alias("row"), (F.col("id") % N).cast("int").alias("col"))
    cells = cells.select("*", (0.4 + F.col("row") / 20).alias("impervious"), (F.col("col") * 4.0).alias("capacity"), (F.col("row") / 10.0).alias("low"))
    bridge = spark.createDataFrame([(c, e, r, k) for c in ("east", "west") for e in range(N) for r, k in ((e, 0), (e, 1), (5 - e, 5))], "city string, eid long, row int, col int")
    return cells, bridge


def plain(series, row, col):
    """Depth at the leads by the step-by-step balance."""
    minutes, mm = zip(*sorted(series))
    stored, out = 0.0, {}
    for t in range(0, 181, 5):
        rain = np.interp(t, minutes, mm, right=0.0)
        stored = max(0.0, stored + (rain * (0.4 + row / 20) - col * 4.0) * 5 / 60)
        if t % 15 == 0:
            out[t] = min(max(stored * 0.42 * (0.12 + 2 * (row / 10) ** 1.3), 0), 150)
    return out


def test_newest_forecast_replaces_depths(spark, tmp_path):
    cells, bridge = town(spark)
    store = forecasts.Nowcasts(str(tmp_path / "store"), cells, bridge, N, sigma=None)
    folder, schema = str(tmp_path / "in"), forecasts.SERIES
    rain = lambda peak: [(60.0, peak), (0.0, 10.0), (120.0, -5.0)]

    def send(*rows):
        spark.createDataFrame([(c, at(s), [*p]) for c, s, p in rows], schema).coalesce(1).write.mode("append").parquet(folder)

    send(("east", 0, rain(50.0)), ("east", 10, rain(80.0)), ("west", 0, [(0.0, 5.0), (None, 3.0)]))  # west: one usable point
    query = store.start(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "check"))
    query.processAllAvailable()
    assert [(r.city, r.peak_mm_per_h, r.batch) for r in store.tokens().collect()] == [("east", 80.0, 0)]
    send(("west", 5, rain(30.0)))
    query.processAllAvailable()
    send(("east", 20, rain(80.0)), ("west", 20, rain(90.0)))  # east's is known already
    query.processAllAvailable()
    query.stop()
    kept = {r.token: r for r in store.tokens().collect()}
    assert sorted((r.city, r.peak_mm_per_h, r.batch) for r in kept.values()) == [("east", 80.0, 0), ("west", 30.0, 1), ("west", 90.0, 2)]
    edges = {(r.token, r.eid, r.lead): r.depth_cm for r in store.edges().collect()}
    for token, r in kept.items():
        series = [(m, max(v, 0.0)) for m, v in rain(r.peak_mm_per_h)]
        assert r.total_mm == pytest.approx(float(np.trapezoid([10, r.peak_mm_per_h, 0], [0, 60, 120])) / 60)
        want = {(token, e, t): max(plain(series, a, b)[t] for a, b in ((e, 0), (e, 1), (5 - e, 5))) for e in range(N) for t in range(0, 181, 15)}
        assert {k: v for k, v in edges.items() if k[0] == token} == pytest.approx(want)
        assert r.flooded_edges == len({e for (_, e, _), v in want.items() if v >= 10})
    # A repeated batch changes nothing.
    again = spark.createDataFrame([("east", at(20), rain(80.0)), ("west", at(20), rain(90.0))], schema)
    store.take(again, 2)
    assert {r.token: r for r in store.tokens().collect()} == kept
    assert {(r.token, r.eid, r.lead): r.depth_cm for r in store.edges().collect()} == edges


def test_only_the_newest_are_kept(spark, tmp_path):
    cells, bridge = town(spark)
    store = forecasts.Nowcasts(str(tmp_path / "s"), cells, bridge, N, most=3)
    for k in range(5):
        store.take(spark.createDataFrame([("east", at(k), [(0.0, 10.0 + k), (60.0, 20.0)])], forecasts.SERIES), k)
    kept = store.tokens().collect()
    assert sorted(r.batch for r in kept) == [2, 3, 4]
    assert {r.token for r in store.edges().select("token").distinct().collect()} == {r.token for r in kept}
    assert sorted(p.name for p in (tmp_path / "s" / "edges").iterdir() if p.name.startswith("batch")) == ["batch=2", "batch=3", "batch=4"]
    store.take(spark.createDataFrame([], forecasts.SERIES), 5)  # an empty batch
    assert len(store.tokens().collect()) == 3
