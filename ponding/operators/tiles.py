"""Work on tiles of a grid: cells meet by tile, with a rim of their neighbours' cells, and a task sees a few tiles as arrays.

A table of cells is shuffled once for a whole pass over the grid, and a rim of one adds a
sixteenth of its rows to tiles of 64 by 64.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64


def by_tile(df: DataFrame, work: Callable[[tuple, dict[str, np.ndarray], np.ndarray, int, int], pd.DataFrame], schema: str, tile: int = TILE, rim: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """df: row, col (int), columns and ``keys`` that keep layers apart. Calls work(layer, arrays, there, top, left) for each tile.

    Tiles that only a rim reaches are called too. arrays: each column over the tile and its rim (numbers as doubles, NaN where there is no
    cell); there: which cells exist; top, left: row and column of the arrays' first cell.
    """
    names = [c for c in df.columns if c not in ("row", "col", *keys)]
    side = tile + 2 * rim

    def near(axis: str):
        if not rim:
            return F.array(F.floor(F.col(axis) / tile).cast("int"))
        return F.array_distinct(F.array(*[F.floor((F.col(axis) + d) / tile).cast("int") for d in (-rim, 0, rim)]))

    def apply(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[-2]), int(key[-1])
        top, left = i * tile - rim, j * tile - rim
        r, c = part["row"].to_numpy() - top, part["col"].to_numpy() - left
        there = np.zeros((side, side), bool)
        there[r, c] = True
        arrays = {}
        for k in names:
            v = part[k].to_numpy(dtype=float, na_value=np.nan)
            arrays[k] = np.full((side, side), np.nan)
            arrays[k][r, c] = v
        return work(key[:-2], arrays, there, top, left)

    tiles = df.withColumn("tile_i", F.explode(near("row"))).withColumn("tile_j", F.explode(near("col")))
    return tiles.groupBy(*keys, "tile_i", "tile_j").applyInPandas(apply, schema)


def places(cells: DataFrame, n: int) -> DataFrame:
    """Adds row and col to cell, a flat index."""
    return cells.withColumns({"row": F.floor(F.col("cell") / n).cast("int"), "col": F.pmod("cell", F.lit(n)).cast("int")})


def pointers(rec: np.ndarray, there: np.ndarray, top: int, left: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a tile the place of its receiver, itself where it drains into itself or out of the tile; and which drain out."""
    side = rec.shape[1]
    at = np.arange(rec.size)
    to = np.where(there, rec, 0).ravel().astype("i8")
    r, c = to // n - top, to % n - left
    inside = there.ravel() & (r >= 0) & (r < rec.shape[0]) & (c >= 0) & (c < side)
    nxt = np.where(inside, r * side + c, at)
    inside &= there.ravel()[nxt]
    return np.where(inside, nxt, at), there.ravel() & ~inside


def ends(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each place's walk ends, and its steps. Strides are doubled."""
    end, steps = nxt, (nxt != np.arange(len(nxt))).astype("i8")
    for _ in range(len(nxt).bit_length() + 1):
        if (end[end] == end).all():
            break
        steps = steps + steps[end]
        end = end[end]
    if (nxt[end] != end).any():
        raise ValueError("the cells drain in a circle")
    return end, steps


def drained(nxt: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How much drains through each place: from the longest walks on, all of one length at a time."""
    acc, (_, steps) = weight.copy(), ends(nxt)
    order = np.argsort(-steps, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(steps[order])) + 1):
        if steps[part[0]]:
            np.add.at(acc, nxt[part], acc[part])
    return acc
