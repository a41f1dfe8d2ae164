"""Raster operators on long tables (row, col, value): storage balance, filters, terrain, zones."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ponding.functions import hydro
from ponding.operators import spill
from ponding.operators.tiles import TILE, by_tile, drained, ends, places, pointers

#: Direction codes of the eight neighbours and their offsets (fixed values).
D8 = ((64, -1, 0), (128, -1, 1), (1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1))
CHECKPOINT_KEY = "spark.checkpoint.dir"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage in a loop: a table in the folder that the session shares; a private folder only in local mode where it names none."""
    spark = df.sparkSession
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='ponding-')}"
        spark.conf.set(CHECKPOINT_KEY, folder)
    path = f"{folder.rstrip('/')}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`settle` wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def cells(spark: SparkSession, n: int = 240) -> DataFrame:
    """row, col and x, y of the unit square (0: north and west)."""
    both = spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    return both.withColumn("x", F.col("col") / F.lit(n - 1.0)).withColumn("y", F.col("row") / F.lit(n - 1.0))


def storage_balance(grid: DataFrame, rain: Column, impervious: Column, capacity: Column) -> DataFrame:
    """Water stored per cell after each step, S = max(0, S + in - out), kept at the leads.

    With P the running sum of in - out, S = P - min(0, running minimum of P). The steps of a cell
    follow each other where it lies, so nothing is shuffled or sorted.
    grid: row, col and what the three expressions need; they may also use the step's minute t.
    """
    steps = grid.withColumn("t", F.explode(F.array(*[F.lit(k * hydro.STEP_MIN) for k in range(hydro.STEPS)])))
    steps = steps.withColumn("net", ((rain * impervious - capacity) * (hydro.STEP_MIN / 60.0)).cast("double"))
    leads = np.flatnonzero(np.arange(hydro.STEPS) * hydro.STEP_MIN % 15 == 0)
    count = hydro.STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            cells = table.num_rows // count
            rest, table = table.slice(cells * count), table.slice(0, cells * count)
            if cells:
                unknown = table["net"].is_null().to_numpy().reshape(cells, count)
                net = np.where(unknown, 0.0, table["net"].to_numpy().reshape(cells, count))
                p = net.cumsum(axis=1)
                storage = p - np.minimum(0.0, np.minimum.accumulate(p, axis=1))
                kept = (np.arange(cells)[:, None] * count + leads).ravel()
                none = np.logical_and.accumulate(unknown, axis=1)[:, leads].ravel()
                out = table.drop_columns(["net"]).take(pa.array(kept)).append_column("storage", pa.array(storage[:, leads].ravel(), mask=none))
                yield from out.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.drop("net").schema)
    return steps.mapInArrow(run, f"{kinds}, storage double").withColumnRenamed("t", "lead")


def balanced(steps: DataFrame, *cell: str) -> DataFrame:
    """steps: the columns of a cell, minute t and net, what comes in less what goes out. Adds storage, kept at the leads."""
    w = Window.partitionBy(*cell).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("p", F.sum("net").over(w))
    run = run.withColumn("storage", F.col("p") - F.least(F.lit(0.0), F.min("p").over(w)))
    return run.where(F.col("t") % 15 == 0).withColumnRenamed("t", "lead").drop("net", "p")


def gaussian(df: DataFrame, n: int, sigma: float, value: str, keys: list[str]) -> DataFrame:
    """Separable Gaussian with reflected borders, cut off at four sigma: one pass along each axis, within tiles and their rims."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    taps = [w / sum(raw) for w in raw]

    def mirror(first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the values for each place beyond the border lie, and which places have one."""
        at = np.arange(first, first + size)
        at = np.where(at < 0, -at - 1, np.where(at >= n, 2 * n - 1 - at, at))
        known = (at >= 0) & (at < n) & (at >= first) & (at < first + size)
        return np.where(known, at - first, 0), known

    def smooth(layer: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        (r, rk), (c, ck) = mirror(top, len(there)), mirror(left, len(there))
        known = there[np.ix_(r, c)] & rk[:, None] & ck[None, :]
        v = np.where(known, arrays["v"][np.ix_(r, c)], np.nan)
        some, v = ~np.isnan(v), np.nan_to_num(v)
        for axis in (1, 0):
            size = v.shape[axis] - 2 * radius
            cut = lambda a, k: a[:, k : k + size] if axis == 1 else a[k : k + size]  # noqa: B023, E731
            v = sum(cut(v, k) * w for k, w in enumerate(taps))
            some, known = (np.any([cut(a, k) for k in range(len(taps))], axis=0) for a in (some, known))
        i, j = np.nonzero(known)
        row, col, out = i + top + radius, j + left + radius, np.where(some, v, np.nan)[i, j]
        inside = (row >= 0) & (row < n) & (col >= 0) & (col < n)
        return pd.DataFrame({**{k: pd.Series([x] * int(inside.sum()), dtype=object if isinstance(x, str) else None) for k, x in zip(keys, layer)}, "row": row[inside], "col": col[inside], "v": pd.array(out[inside], "Float64")})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    v = df.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("v"))
    out = by_tile(v, smooth, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "row int, col int, v double"]), tile=max(TILE, radius), rim=radius, keys=tuple(keys))
    return out.select(*keys, F.col("row").cast(kinds["row"]).alias("row"), F.col("col").cast(kinds["col"]).alias("col"), F.col("v").alias(value))


def slope(df: DataFrame, cell_m: float, value: str = "z") -> DataFrame:
    """Central differences, one-sided at borders: dz_row, dz_col and the slope in degrees."""
    out = df
    for axis, other in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(other).orderBy(axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        step = F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)
        out = out.withColumn(f"dz_{axis}", step / cell_m)
    return out.withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.col("dz_row") * F.col("dz_row") + F.col("dz_col") * F.col("dz_col")))))


def dilate(mask: DataFrame, n: int) -> DataFrame:
    """Cells of the mask and their four neighbours."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    near = mask.select("row", "col", F.explode(offsets).alias("o")).select((F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    return near.where(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)).distinct()


def neighbours(df: DataFrame, value: str = "z") -> DataFrame:
    """Each cell with each neighbour's value: row, col, value, code, distance, v2, row2, col2."""
    offsets = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(math.sqrt(abs(a) + abs(b))).alias("distance")) for c, a, b in D8])
    own = df.select("row", "col", value, F.explode(offsets).alias("o")).select("row", "col", value, "o.code", "o.distance", (F.col("row") + F.col("o.a")).alias("row2"), (F.col("col") + F.col("o.b")).alias("col2"))
    return own.join(df.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col(value).alias("v2")).hint("merge"), ["row2", "col2"])


def flow_direction(df: DataFrame, value: str = "z") -> DataFrame:
    """The steepest of the eight directions downhill (ties: the first in code order given); null in a pit. Cells meet their neighbours by tile."""
    inside = slice(1, -1)

    def steepest(_: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        z = arrays["z"]
        best, code, dr, dc = np.zeros((len(z) - 2,) * 2), *(np.zeros((len(z) - 2,) * 2, "i4") for _ in range(3))
        for k, a, b in D8:
            drop = (z[inside, inside] - z[1 + a : len(z) - 1 + a, 1 + b : len(z) - 1 + b]) / math.sqrt(abs(a) + abs(b))
            steeper = drop > best
            best[steeper], code[steeper], dr[steeper], dc[steeper] = drop[steeper], k, a, b
        r, c = np.nonzero(there[inside, inside])
        return pd.DataFrame({"row": r + top + 1, "col": c + left + 1, "code": code[r, c], "dr": dr[r, c], "dc": dc[r, c]})

    z = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("z"))
    found = by_tile(z, steepest, "row int, col int, code int, dr int, dc int")
    kinds = {f.name: f.dataType for f in df.schema if f.name in ("row", "col")}
    own = {k: F.col(k).cast(t) for k, t in kinds.items()}
    down = F.col("code") != 0
    return found.select(own["row"].alias("row"), own["col"].alias("col"), F.when(down, F.col("code")).alias("code"), F.when(down, own["row"] + F.col("dr")).alias("row2"), F.when(down, own["col"] + F.col("dc")).alias("col2"))


def receivers(directions: DataFrame, n: int) -> DataFrame:
    """cell and rec, its receiver (itself where it has none), as flat indices."""
    at = lambda r, c: (F.col(r) * n + F.col(c)).cast("long")
    return directions.select(at("row", "col").alias("cell"), F.coalesce(at("row2", "col2"), at("row", "col")).alias("rec"))


def jump(flow: DataFrame, stop: DataFrame, rounds: int = 64, n: int | None = None, tile: int = TILE) -> DataFrame:
    """cell, target: the first cell of ``stop`` downstream (itself included), or where its walk ends. Doubles the stride each round.

    With n, the cells along a row of the grid, walks are first followed to the border of
    their tile, and only border cells take part in the rounds.
    """
    halted = flow.join(stop.select("cell", F.lit(True).alias("halt")), "cell", "left")
    begin = halted.select("cell", F.when(F.col("halt"), F.col("cell")).otherwise(F.col("rec")).alias("target"))
    if n is not None:
        return _jump_tiles(begin, rounds, n, tile)
    to = settle(begin.withColumn("ended", F.col("target") == F.col("cell")))
    for _ in range(rounds):
        nxt = to.select(F.col("cell").alias("target"), F.col("target").alias("next"), F.col("ended").alias("over"))
        new = settle(to.join(nxt.hint("merge"), "target").select("cell", F.col("next").alias("target"), F.col("over").alias("ended"), (F.col("next") != F.col("target")).alias("moved")))
        drop(to)
        to = new.drop("moved")
        to.stored_at = new.stored_at
        if not new.where("moved").limit(1).count():
            # In a circle whose length is a power of two nothing moves either.
            if to.where("not ended").limit(1).count():
                break
            out = to.select("cell", "target")
            out.stored_at = to.stored_at
            return out
    raise ValueError("the cells drain in a circle")


def _border(tile: int) -> Column:
    return (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)


def _jump_tiles(begin: DataFrame, rounds: int, n: int, tile: int) -> DataFrame:
    """begin: cell and target, its next cell. Walks within tiles, then from border cell to border cell, then both put together."""

    def walk(_: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        nxt, out = pointers(arrays["target"], there, top, left, n)
        end, _ = ends(nxt)
        at = np.flatnonzero(there.ravel())
        r, c = np.divmod(at, tile)
        end = end[at]
        own = (end // tile + top) * n + end % tile + left
        target = np.where(out[end], np.where(there, arrays["target"], 0).ravel()[end].astype("i8"), own)
        return pd.DataFrame({"cell": (r + top) * n + c + left, "target": target, "done": ~out[end]})

    near = settle(by_tile(places(begin, n).drop("cell"), walk, "cell long, target long, done boolean", tile=tile, rim=0))
    gates = settle(places(near, n).where(_border(tile)).select("cell", "target", "done"))
    last = jump(gates.select("cell", F.when(F.col("done"), F.col("cell")).otherwise(F.col("target")).alias("rec")), gates.where("false").select("cell"), rounds)
    final = last.join(gates.select(F.col("cell").alias("target"), F.col("target").alias("final")).hint("merge"), "target").select(F.col("cell").alias("target"), "final")
    rest = near.where("not done").join(final.hint("merge"), "target").select("cell", F.col("final").alias("target"))
    out = settle(near.where("done").select("cell", "target").unionByName(rest))
    drop(near, gates, last)
    return out


def accumulate(flow: DataFrame, weight: Column | None = None, n: int | None = None, tile: int = TILE) -> DataFrame:
    """cell, acc: how much drains through each cell, itself included. Paths are doubled, so rounds grow with the log of the longest path.

    With n, the cells along a row of the grid, tiles add up by themselves and only what
    crosses their borders takes part in the rounds.
    """
    one = weight if weight is not None else F.lit(1.0)
    if n is not None:
        return _accumulate_tiles(flow.select("cell", "rec", one.cast("double").alias("w")), n, tile)
    acc = settle(flow.select("cell", one.alias("acc"), F.when(F.col("rec") != F.col("cell"), F.col("rec")).alias("ptr")))
    for _ in range(64):
        if not acc.where(F.col("ptr").isNotNull()).limit(1).count():
            out = acc.select("cell", "acc")
            out.stored_at = acc.stored_at
            return out
        given = acc.where(F.col("ptr").isNotNull()).groupBy(F.col("ptr").alias("cell")).agg(F.sum("acc").alias("more"))
        ahead = acc.select(F.col("cell").alias("ptr"), F.col("ptr").alias("ptr2"))
        new = settle(acc.join(ahead.hint("merge"), "ptr", "left").join(given.hint("merge"), "cell", "left").select("cell", (F.col("acc") + F.coalesce("more", F.lit(0.0))).alias("acc"), F.col("ptr2").alias("ptr")))
        drop(acc)
        acc = new
    raise ValueError("the cells drain in a circle")


def _accumulate_tiles(flow: DataFrame, n: int, tile: int) -> DataFrame:
    """flow: cell, rec, w. What leaves each tile, then what enters each border cell, then the tiles once more with that."""

    def across(_: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        nxt, out = pointers(arrays["rec"], there, top, left, n)
        acc = drained(nxt, np.where(there, arrays["w"], 0.0).ravel())
        rec = np.where(there, arrays["rec"], 0).ravel().astype("i8")
        name = lambda at: (at // tile + top) * n + at % tile + left
        left_by = np.flatnonzero(out)
        edge = np.zeros((tile, tile), bool)
        edge[[0, -1]] = edge[:, [0, -1]] = True
        gate = np.flatnonzero(edge.ravel() & there.ravel())
        end = ends(nxt)[0][gate]
        return pd.DataFrame({"cell": np.r_[rec[left_by], name(gate)], "rec": np.r_[np.full(len(left_by), -1), np.where(out[end], rec[end], name(gate))], "w": np.r_[acc[left_by], np.zeros(len(gate))]})

    def within(_: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        nxt, _ = pointers(arrays["rec"], there, top, left, n)
        acc = drained(nxt, np.where(there, arrays["w"], 0.0).ravel())
        r, c = np.nonzero(there)
        return pd.DataFrame({"cell": (r + top) * n + c + left, "acc": acc[there.ravel()]})

    gates = by_tile(places(flow, n).drop("cell"), across, "cell long, rec long, w double", tile=tile, rim=0)
    # A border cell's own row names where it drains to; rows with -1 bring what enters it. What leaves the grid enters no cell.
    entered = settle(gates.groupBy("cell").agg(F.max("rec").alias("rec"), F.sum("w").alias("w")).where("rec >= 0"))
    known = entered.select(F.col("cell").alias("rec"), F.lit(True).alias("known"))
    led = entered.join(known.hint("merge"), "rec", "left").select("cell", F.when(F.col("known"), F.col("rec")).otherwise(F.col("cell")).alias("rec"), "w")
    more = accumulate(led, F.col("w")).withColumnRenamed("acc", "more").where("more <> 0")
    full = flow.join(more.hint("merge"), "cell", "left").select("cell", "rec", (F.col("w") + F.coalesce("more", F.lit(0.0))).alias("w"))
    out = settle(by_tile(places(full, n).drop("cell"), within, "cell long, acc double", tile=tile, rim=0))
    drop(entered)
    return out


#: So many tiles along a side make a group of tiles, so many of these a group of groups.
GROUP = 8
EDGE = "a long, b long, w double"


def fill_depressions(df: DataFrame, n: int, value: str = "z", tile: int = TILE) -> DataFrame:
    """The lowest level at which each cell drains to the border: the least, over all ways there, of the highest cell on the way.

    Each tile is reduced to edges between its border cells that join them at the same levels, groups of tiles to edges between
    the border cells of the group, and so on up to one graph of few cells; then levels come down the same way. The grid is
    shuffled twice, whatever its size. Cells that never drain have 1e9, cells without a height are walls.
    """
    cells = settle(df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("z")))

    def on_rim(row, col, size: int):
        return (row % size == 0) | (row % size == size - 1) | (col % size == 0) | (col % size == size - 1)

    def edge_of_grid(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return (row == 0) | (col == 0) | (row == n - 1) | (col == n - 1)

    def reduce_tile(_: tuple, arrays: dict, there: np.ndarray, top: int, left: int) -> pd.DataFrame:
        z, known = arrays["z"], there & ~np.isnan(arrays["z"])
        r, c = (v.ravel() for v in np.indices(z.shape))
        own = (r > 0) & (c > 0) & (r <= tile) & (c <= tile)
        row, col = r + top, c + left
        name = np.r_[row * n + col, -1]
        a, b, w = spill.pairs(z, known)
        inner, across = own[a] & own[b], own[a] != own[b]
        # The pair is seen from both tiles: the one with the smaller cell tells of it.
        across &= own[np.where(name[a] < name[b], a, b)]
        drains = np.flatnonzero(own & known.ravel() & edge_of_grid(row, col))
        kept = own & known.ravel() & on_rim(row, col, tile)
        # Basins stand for their cells; kept cells are places of their own, which meet their basins at their heights.
        base, out, z = spill.basins(z, known & own.reshape(z.shape)), z.size, z.ravel()
        k = np.flatnonzero(kept)
        edges = spill.lowest(np.r_[base[a[inner]], base[drains]], np.r_[base[b[inner]], np.full(len(drains), out)], np.r_[w[inner], z[drains]])
        x, y, level = spill.meeting(np.r_[edges[0], base[k]], np.r_[edges[1], out + 1 + k], np.r_[edges[2], z[k]], np.r_[np.zeros(out, bool), True, kept])
        name = np.r_[name, name[:-1]]
        return pd.DataFrame({"a": name[np.r_[x, a[across]]], "b": name[np.r_[y, b[across]]], "w": np.r_[level, w[across]]})

    def numbered(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells of edges, the outside first, and the edges by number."""
        name, at = np.unique(np.r_[-1, part["a"], part["b"]], return_inverse=True)
        return name, *np.split(at[1:], 2)

    def grouped(edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
        """Edges within a group, by group, and those across groups."""
        place = lambda c: [F.floor(F.floor(F.col(c) / n) / size), F.floor(F.pmod(c, F.lit(n)) / size)]
        (i, j), (k, m) = ([*map(lambda x: x.cast("int"), place(c))] for c in ("a", "b"))
        outside = F.least("a", "b") < 0
        there = edges.withColumns({"i": F.when(F.col("a") < 0, k).otherwise(i), "j": F.when(F.col("a") < 0, m).otherwise(j), "within": outside | ((i == k) & (j == m))})
        return there.where("within").drop("within"), there.where("not within").select("a", "b", "w")

    def reduce_group(size: int):
        def work(part: pd.DataFrame) -> pd.DataFrame:
            name, a, b = numbered(part)
            x, y, level = spill.meeting(a, b, part["w"].to_numpy(), (name < 0) | on_rim(name // n, name % n, size))
            return pd.DataFrame({"a": name[x], "b": name[y], "w": level})

        return work

    def level_group(part: pd.DataFrame) -> pd.DataFrame:
        name, a, b = numbered(part)
        level = spill.levels(a, b, part["w"].to_numpy(), len(name), 0)
        met = np.isfinite(level)
        return pd.DataFrame({"cell": name[met], "w": level[met]})

    def level_tile(key: tuple, part: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        top, left = key[0] * tile, key[1] * tile
        row, col, height = (part[k].to_numpy() for k in ("row", "col", "z"))
        z = np.full((tile, tile), np.nan)
        z[row - top, col - left] = height
        a, b, w = spill.pairs(z, ~np.isnan(z))
        drains = edge_of_grid(row, col) & ~np.isnan(height)
        at = np.r_[((row - top) * tile + col - left)[drains], (met["row"] - top) * tile + met["col"] - left].astype("i8")
        base, out = spill.basins(z, ~np.isnan(z)), z.size
        edges = spill.lowest(np.r_[base[a], base[at]], np.r_[base[b], np.full(len(at), out)], np.r_[w, height[drains], met["w"]])
        level = np.maximum(z.ravel(), spill.levels(*edges, out + 1, out)[base])
        new = level[(row - top) * tile + col - left]
        new = np.where(np.isnan(height), np.nan, np.where(drains, height, np.minimum(new, 1e9)))
        return pd.DataFrame({"row": row, "col": col, "z": height, "w": new})

    graphs, size, met = [], tile, None
    while size < n:
        if graphs:
            inside, rest = grouped(graphs[-1], size)
            edges = inside.groupBy("i", "j").applyInPandas(reduce_group(size), EDGE).unionByName(rest)
        else:
            edges = by_tile(cells, reduce_tile, EDGE, tile=tile)
        graphs.append(settle(edges))
        size *= GROUP
    for edges in reversed(graphs):
        known = edges
        if met is not None:
            known = known.unionByName(met.where(on_rim(F.floor(F.col("cell") / n), F.pmod("cell", F.lit(n)), size)).select(F.col("cell").alias("a"), F.lit(-1).cast("long").alias("b"), "w"))
        new = settle(grouped(known, size)[0].groupBy("i", "j").applyInPandas(level_group, "cell long, w double"))
        drop(edges, met)
        met, size = new, size // GROUP
    near = lambda c: F.floor(F.col(c) / tile).cast("int")
    met = places(met if met is not None else cells.where("false").select(F.lit(0).cast("long").alias("cell"), F.col("z").alias("w")), n)
    by = lambda t: t.groupBy(near("row").alias("i"), near("col").alias("j"))
    return settle(by(cells).cogroup(by(met.select("row", "col", "w"))).applyInPandas(level_tile, "row int, col int, z double, w double"))


def fill_nearest(df: DataFrame, value: str = "z") -> DataFrame:
    """Empty cells take the value of the nearest filled one (ties: the smaller row, then column); all stay empty where none is filled.

    First the nearest filled cell of each column by two windows, then along each row the
    column whose cell is nearest: exact, whatever the shape of the gaps.
    """
    filled = F.when(F.col(value).isNotNull(), F.struct(F.col("row").alias("r"), F.col(value).alias("v")))
    w = Window.partitionBy("col").orderBy("row")
    above, below = F.last(filled, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(filled, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = df.select("row", "col", above.alias("a"), below.alias("b"))
    best = F.when(F.col("b").isNull() | (F.col("row") - F.col("a.r") <= F.col("b.r") - F.col("row")), F.col("a")).otherwise(F.col("b"))
    columns = both.withColumn("best", best).select("row", "col", F.col("best.r").alias("src"), F.col("best.v").cast("double").alias("v"))

    def along(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("col")
        have = batch[batch["src"].notna()]
        if len(have):
            at, src, v = have["col"].to_numpy(), have["src"].to_numpy().astype(np.int64), have["v"].to_numpy()
            up = (batch["row"].iloc[0] - src) ** 2
            order = np.lexsort((at, src))  # the first of equal distances is the smaller row, then column
            at, v, up = at[order], v[order], up[order]
            col = batch["col"].to_numpy()
            batch["v"] = np.concatenate([v[((col[i : i + 256, None] - at) ** 2 + up).argmin(1)] for i in range(0, len(col), 256)])
        return batch[["row", "col", "v"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in ("row", "col")}
    found = columns.groupBy("row").applyInPandas(along, f"row {kinds['row']}, col {kinds['col']}, v double")
    return found.select("row", "col", F.col("v").cast(df.schema[value].dataType).alias(value))


def zonal(df: DataFrame, zone: str, *values: str) -> DataFrame:
    """Cells, sums and means by zone; an empty value counts as 0 in both."""
    aggs = [F.count(F.lit(1)).alias("cells")]
    for v in values:
        aggs += [F.sum(F.coalesce(v, F.lit(0.0))).alias(f"sum_{v}"), (F.sum(F.coalesce(v, F.lit(0.0))) / F.count(F.lit(1))).alias(f"mean_{v}")]
    return df.groupBy(zone).agg(*aggs)


def regrid(df: DataFrame, n: int, m: int, value: str) -> DataFrame:
    """Average the cells of an n-grid whose centres fall into each cell of an m-grid."""
    at = lambda c: F.floor((F.col(c) + 0.5) * m / n).cast("int").alias(c)
    return df.select(at("row"), at("col"), value).groupBy("row", "col").agg(F.avg(value).alias(value))
