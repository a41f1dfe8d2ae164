"""Steps whose cost must not grow faster than their input."""

from ponding.operators import grid, network, runoff
from ponding.plans import QUERIES
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_of_edges_are_not_shuffled(spark):
    coords = [(77.60, 12.90), (77.65, 12.95), (77.60, 12.90)]
    edges = spark.createDataFrame([(1, coords)], "eid long, coords array<struct<lon: double, lat: double>>")
    points = network.edge_points(edges, 77.60, 12.90, 77.70, 13.00, 60.0, 60)
    assert "Exchange" not in plan(points)
    cells = network.edge_cells(edges, 77.60, 12.90, 77.70, 13.00, 60.0, 60)
    assert {tuple(r) for r in points.collect()} == {tuple(r) for r in cells.collect()} and points.count() > cells.count()


def test_series_are_dealt_out_in_bounded_parts(spark):
    """Catchments are shuffled, their series are not."""
    assert runoff.dealt(spark.range(100), series=5).rdd.getNumPartitions() == 21
    text = plan(QUERIES["runoff_convolution"](spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text


def test_receivers_broadcast_nothing(spark, monkeypatch):
    seen, keep = [], runoff.settle
    monkeypatch.setattr(runoff, "settle", lambda df: (seen.append(plan(df)), keep(df))[1])
    flow = spark.range(1, 64).select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("downstream"))
    got = {r.id: r.receiver for r in runoff.first_below(flow, flow.where("id in (1, 5)").select("id")).collect()}
    assert got[43] == 5 and got[5] == 1 and got[1] is None
    assert seen and not any("Broadcast" in p for p in seen)


def test_neighbours_broadcast_nothing(spark):
    """A settled grid's files are small, its rows are not."""
    cells = grid.settle(grid.cells(spark, 20).select("row", "col", F.lit(1.0).alias("z")))
    assert "Broadcast" not in plan(grid.neighbours(cells))
