"""Grids of another resolution, boxes of coarse grids, registries of sources, bounded stores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.operators.tiles import by_tile


def bilinear(df: DataFrame, n: int, m: int, value: str = "v") -> DataFrame:
    """An n-grid at the nodes of an m-grid with the same corners: four neighbours, weighted. Nodes come from the tile of their first neighbour."""
    step = (n - 1) / (m - 1)

    def nodes(_: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        at = np.arange(m)
        first = np.minimum(np.floor(at * step), n - 2).astype("i8")
        i, j = (at[(first > low) & (first < low + len(there) - 1)] for low in (top, left))
        r, c = first[i] - top, first[j] - left
        y, x = (i * step - first[i])[:, None], (j * step - first[j])[None, :]
        total, some, known = np.zeros((len(i), len(j))), np.zeros((len(i), len(j)), bool), np.zeros((len(i), len(j)), bool)
        for a, wy in ((0, 1 - y), (1, y)):
            for b, wx in ((0, 1 - x), (1, x)):
                v = arrays["v"][np.ix_(r + a, c + b)]
                total += np.nan_to_num(v) * (wy * wx)
                some |= ~np.isnan(v)
                known |= there[np.ix_(r + a, c + b)]
        p, q = np.nonzero(known)
        return pd.DataFrame({"row": i[p], "col": j[q], "v": pd.array(np.where(some, total, np.nan)[p, q], "Float64")})

    v = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("v"))
    return by_tile(v, nodes, "row int, col int, v double").withColumnRenamed("v", value)


def cubic(x: np.ndarray) -> np.ndarray:
    """The cubic kernel of four taps with slope -1/2 at 1."""
    d = np.abs(x)
    return np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))


def bicubic(df: DataFrame, factor: int, n: int, *values: str) -> DataFrame:
    """An n-grid (row, col, values) enlarged by a whole factor, one axis after the other, within tiles and their rims; beyond the border the taps that are left count more.

    Pixel i of the larger grid lies at (i + 1/2) / factor - 1/2 of the smaller one.
    """

    def pixels(_: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        size = len(there)
        at, taps = [], []
        for low in (top, left):
            i = np.arange(max((low + 2) * factor, 0), min((low + size - 2) * factor, n * factor))
            at.append(i)
            taps.append(cubic(((i + 0.5) / factor - 0.5)[:, None] - np.arange(low, low + size)[None, :]))
        down, across = taps
        weight = there @ across.T
        reached = (there.astype(int) @ (across != 0).T.astype(int)) > 0
        here = (down != 0).astype(int) @ reached.astype(int) > 0
        p, q = np.nonzero(here)
        out = {"row": at[0][p], "col": at[1][q]}
        for k in values:
            along = np.divide(np.nan_to_num(arrays[k]) @ across.T, weight, out=np.zeros_like(weight), where=reached)
            out[k] = np.divide(down @ along, down @ reached, out=np.full(here.shape, np.nan), where=here)[p, q]
        return pd.DataFrame(out)

    v = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(k).cast("double").alias(k) for k in values])
    return by_tile(v, pixels, ", ".join(["row int, col int", *(f"`{k}` double" for k in values)]), rim=2)


def box_rain(granules: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """granules: begin, lon, lat, mm_per_h. Mean and peak over the box; negative fill values count as missing."""
    inside = granules.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    valid = F.when(F.col("mm_per_h") >= 0, F.col("mm_per_h"))
    return inside.groupBy("begin").agg(F.avg(valid).alias("mean_mm_per_h"), F.max(valid).alias("peak_mm_per_h"))


def registered(files: DataFrame, manifest: DataFrame, prefix: int = 8) -> DataFrame:
    """files: name. Those whose first characters the manifest (id, ...) knows, with its columns. The manifest is a short list."""
    return files.join(F.broadcast(manifest), F.substring("name", 1, prefix) == manifest.id)


def newest(store: DataFrame, keep: int = 6, order: str = "seq") -> DataFrame:
    """The newest entries of a bounded store: each token once, by its last use."""
    last = store.groupBy("token").agg(F.max(order).alias(order))
    return last.orderBy(F.desc(order), "token").limit(keep)
