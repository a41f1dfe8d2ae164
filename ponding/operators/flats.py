"""Flow across flats: away from higher ground and towards outlets, then the steepest of eight directions.

After depressions are filled, cells on a flat have no lower neighbour. Two distances over the
flat decide: to the nearest cell that drains, counted twice, and from higher ground,
subtracted from its largest value on that flat. Each cell of a flat then has a neighbour with
less, so water crosses the flat and gathers in its middle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.operators.grid import D8, TILE, drop, neighbours, settle

FLAT = "row int, col int, w double, drains boolean, high boolean, towards double, away double, label double"
STATE = ("towards", "away", "label")


def _spread(w: np.ndarray, drains: np.ndarray, high: np.ndarray, own: np.ndarray, state: list[np.ndarray]) -> list[np.ndarray]:
    """Both distances and the least cell of each flat, until nothing sinks; cells outside ``own`` stay."""
    around = lambda v, fill: [np.pad(v, 1, constant_values=fill)[1 + a : 1 + a + v.shape[0], 1 + b : 1 + b + v.shape[1]] for _, a, b in D8]
    level = [x == w for x in around(w, np.nan)]
    flat_near = [same & ~d for same, d in zip(level, around(drains, True))]
    out_near = np.any([same & d for same, d in zip(level, around(drains, False))], axis=0)
    move = own & ~drains
    towards, away, label = state
    towards = np.where(move & out_near, 1.0, towards)
    away = np.where(move & high, 1.0, away)
    while True:
        low = [np.min([np.where(f, x, np.inf) for f, x in zip(flat_near, around(v, np.inf))], axis=0) for v in (towards, away, label)]
        new = [np.where(move, np.minimum(v, x), v) for v, x in zip((towards, away, label), (low[0] + 1, low[1] + 1, low[2]))]
        if all((a == b).all() for a, b in zip(new, (towards, away, label))):
            return new
        towards, away, label = new


def flat_gradient(filled: DataFrame, n: int, value: str = "w", tile: int = TILE) -> DataFrame:
    """row, col, w, drains (whether the cell has a lower neighbour or lies on the border) and mask, which falls along every flat towards its outlets (0 where it drains).

    Tiles settle by themselves, with a rim of their neighbours' cells; distances only sink, so rounds end.
    """
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == n - 1) | (F.col("col") == n - 1)
    w = filled.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("w"))
    about = neighbours(w, "w").groupBy("row", "col").agg(F.min("v2").alias("low"), F.max("v2").alias("top"))
    drains = edge | F.coalesce(F.col("low") < F.col("w"), F.lit(False))
    cells = w.join(about.hint("merge"), ["row", "col"], "left").select("row", "col", "w", drains.alias("drains"), (~drains & (F.col("top") > F.col("w"))).alias("high"))
    inf, name = F.lit(float("inf")), (F.col("row") * F.lit(float(n)) + F.col("col"))
    state = settle(cells.select("row", "col", "w", "drains", "high", F.when(F.col("drains"), 0.0).otherwise(inf).alias("towards"), inf.alias("away"), F.when(F.col("drains"), inf).otherwise(name).alias("label")))
    near = lambda axis: F.array_distinct(F.array(*[F.floor((F.col(axis) + d) / tile).cast("int") for d in (-1, 0, 1)]))

    def settle_tile(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        r, c = ((part[k] - part[k].min()).to_numpy() for k in ("row", "col"))
        shape = (r.max() + 1, c.max() + 1)
        own = ((part["row"] // tile == key[0]) & (part["col"] // tile == key[1])).to_numpy()
        grids = {k: np.full(shape, fill) for k, fill in (("w", np.nan), ("drains", True), ("high", False), *((s, np.inf) for s in STATE))}
        for k, g in grids.items():
            g[r, c] = part[k].to_numpy()
        mine = np.zeros(shape, bool)
        mine[r, c] = own
        if (part["drains"] | ~own).all():
            return part[own].assign(sank=False)
        new = _spread(grids["w"], grids["drains"].astype(bool), grids["high"].astype(bool), mine, [grids[s] for s in STATE])
        out = part[own].copy()
        out["sank"] = False
        for s, g in zip(STATE, new):
            v = g[r, c][own]
            out["sank"] |= v < out[s].to_numpy()
            out[s] = v
        return out

    while True:
        tiles = state.withColumn("i", F.explode(near("row"))).withColumn("j", F.explode(near("col")))
        new = settle(tiles.groupBy("i", "j").applyInPandas(lambda key, part: settle_tile(key, part)[[f.split()[0] for f in FLAT.split(", ")] + ["sank"]], FLAT + ", sank boolean"))
        drop(state)
        state = new.drop("sank")
        state.stored_at = new.stored_at
        if not new.where("sank").limit(1).count():
            break
    tallest = state.where("not drains and away < double('inf')").groupBy("label").agg(F.max("away").alias("tallest"))
    slope = F.when(F.col("drains"), 0.0).otherwise(2 * F.col("towards") + F.coalesce(F.col("tallest") - F.col("away"), F.lit(0.0)))
    return settle(state.join(tallest.hint("merge"), "label", "left").select("row", "col", "w", "drains", slope.alias("mask")))


def flow_across_flats(filled: DataFrame, n: int, value: str = "w") -> DataFrame:
    """row, col, code, row2, col2: the steepest way down, on flats along their gradient (ties: the first in code order). Only border cells may have none."""
    cells = flat_gradient(filled, n, value)
    order = F.array_position(F.array(*[F.lit(c) for c, _, _ in D8]), F.col("code"))
    both = cells.select("row", "col", F.struct("w", "mask", "drains").alias("v"))
    pairs = neighbours(both, "v")
    fall, ease = F.col("v.w") - F.col("v2.w"), F.col("v.mask") - F.col("v2.mask")
    down = F.when(fall > 0, F.struct(F.lit(1).alias("kind"), (fall / F.col("distance")).alias("s"), (-order).alias("o")))
    across = F.when((fall == 0) & ~F.col("v.drains") & (ease > 0), F.struct(F.lit(0).alias("kind"), (ease / F.col("distance")).alias("s"), (-order).alias("o")))
    best = pairs.withColumn("rank", F.coalesce(down, across)).where("rank is not null").groupBy("row", "col").agg(F.max_by(F.struct("code", "row2", "col2"), "rank").alias("b"))
    return cells.select("row", "col").join(best.hint("merge"), ["row", "col"], "left").select("row", "col", F.col("b.code").alias("code"), F.col("b.row2").alias("row2"), F.col("b.col2").alias("col2"))
