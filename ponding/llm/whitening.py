"""Whitening of embeddings by a one-sided Jacobi SVD.

Every entry c becomes the whole number x = floor(64 c) + 1000000, so counts and sums are
exact. The rows, centred by the exact mean, are compressed blockwise by QR: each task keeps
one triangle R, and triangles meet in a tree, so nothing that grows
with the rows reaches one task or the driver. Plane rotations then make R's columns
orthogonal; the accumulated rotations are the components, the columns' norms over sqrt(n)
their standard deviations, without ever forming R'R.

Defined results: a row goes if its vector is null or empty, holds a null or a non-finite entry, has another
length than most vectors (of equally frequent lengths the longest counts), or an entry whose
x has over 62 bits. Repeated rows and null ids are rows like any other. Components without
variance (to rounding) are left out; an empty table, or equal vectors only, give no rows.
A deviation beyond 63 bits is null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.llm.common import discard, materialize, table
from ponding.llm.tree import fold, of_task

SCALE, SHIFT, LARGE = 64, 1_000_000, 2**62
#: Rows that numpy handles at a time.
ROWS = 4096
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_rows(batch: pa.RecordBatch, dim: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and x-vectors (rows by dim) of the usable rows; one pair for each length, or for ``dim`` alone."""
    vectors = batch.column(1)
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(all="ignore"):
        flat = np.floor(pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        wrong = np.r_[0, np.cumsum(~(np.abs(flat) < LARGE))]
    end = np.cumsum(length)
    usable = (length > 0) & (wrong[end] == wrong[end - length])
    for d in np.unique(length[usable]) if dim is None else [dim]:
        own = np.flatnonzero(usable & (length == d))
        for k in range(0, len(own), ROWS):
            at = own[k : k + ROWS]
            yield batch.column(0).take(pa.array(at)), flat[(end - length)[at][:, None] + np.arange(d)].astype(np.int64) + SHIFT


def exact_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """The sum as int64 where it fits for sure, else as Python integers."""
    largest = int(np.abs(x).max(initial=0)) if x.dtype != object else LARGE
    return x.sum(axis) if largest * max(1, x.shape[axis]) < LARGE else x.astype(object).sum(axis)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    return n * x - np.array(sums, np.int64) if largest < LARGE else n * x.astype(object) - np.array(sums, object)


def squared_lengths(d: np.ndarray) -> pa.Array:
    largest = int(np.abs(d).max(initial=0))
    if largest**2 * d.shape[1] < LARGE:
        return pa.array((d.astype(np.int64) ** 2).sum(1))
    return pa.array([v if v < 2**63 else None for v in (sum(int(c) ** 2 for c in row) for row in d)], pa.int64())


def triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def jacobi(r: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of r, by rotating pairs of its columns until all are orthogonal.

    A sweep meets every pair once, in rounds of disjoint pairs that rotate together.
    """
    dim, eps = r.shape[1], np.finfo(float).eps
    even = dim + dim % 2
    a, v = np.zeros((even, r.shape[0])), np.eye(even)  # by columns of r
    a[:dim] = r.T
    none = (dim * eps * np.linalg.norm(r)) ** 2
    order = np.arange(even)
    for _ in range(sweeps):
        turned = 0
        for _ in range(even - 1):
            p, q = order[: even // 2], order[: even // 2 - 1 : -1]
            x, y = a[p], a[q]
            alpha, beta, gamma = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            do = (np.minimum(alpha, beta) > none) & (np.abs(gamma) > eps * np.sqrt(alpha * beta) * np.sqrt(dim))
            if do.any():
                turned += 1
                p, q, gamma = p[do], q[do], gamma[do]
                zeta = (beta[do] - alpha[do]) / (2 * gamma)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                for m in (a, v):
                    x, y = m[p], m[q]
                    m[p], m[q] = c * x - s * y, s * x + c * y
            order = np.r_[order[0], order[-1], order[1:-1]]
        if not turned:
            break
    else:
        raise ArithmeticError("the rotations did not come to rest")
    norms = np.sqrt((a * a).sum(1))[:dim]
    by = np.argsort(-norms, kind="stable")
    return norms[by], v[by][:, :dim].T


def moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred second moment of some rows."""
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def joined(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n, mean, second = parts[0]
    for m, other, more in parts[1:]:
        step = other - mean
        second = second + more + np.outer(step, step) * (n * m / (n + m))
        n, mean = n + m, mean + step * (m / (n + m))
    return n, mean, second


def whiten(df: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    width, empty = max(1, src.rdd.getNumPartitions()), src.sparkSession.createDataFrame([], WHITENED)
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, x in (y for b in batches for y in whole_rows(b)):
            n, sums = found.get(x.shape[1], (0, 0))
            found[x.shape[1]] = [n + len(x), exact_sum(x, 0).astype(object) + sums]
        columns = [list(found), [n for n, _ in found.values()], [[decimal.Decimal(int(s)) for s in sums] for _, sums in found.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "n", "sums"])

    counted = materialize(src.mapInArrow(count, "dim int, n long, sums array<decimal(38,0)>"), "sums")
    top = counted.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        discard(counted)
        return empty
    dim, n = top.dim, top.n
    of = counted.where(F.col("dim") == dim).select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    sums = [int(r.s) for r in sorted(of, key=lambda r: r.at)]
    discard(counted)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for ids, x in (y for b in batches for y in whole_rows(b, dim)):
            d = deviations(x, n, sums)
            yield ids, d, d.astype(np.float64) / n

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, _, y in centred(batches):
            r = triangle([y] if r is None else [r, y])
        return of_task(None if r is None else r.tobytes())

    def triangles(parts: list[bytes]) -> bytes:
        return triangle([np.frombuffer(p).reshape(-1, dim) for p in parts]).tobytes()

    r = np.frombuffer(fold(src.mapInArrow(compress, "part int, data binary"), triangles, width)).reshape(-1, dim)
    norms, vectors = jacobi(r)
    variances = norms**2 / n
    k = min(components, int((norms > dim * np.finfo(float).eps * norms[0]).sum()) if norms[0] else 0)
    if not k:
        return empty
    explained, turn = variances[:k] / variances.sum(), vectors[:, :k] / np.sqrt(variances[:k])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, y in centred(batches):
            own = moments(y @ turn)
            total = own if total is None else joined([total, own])
        return of_task(None if total is None else packed(total))

    def packed(m: tuple[int, np.ndarray, np.ndarray]) -> bytes:
        return np.r_[float(m[0]), m[1], m[2].ravel()].tobytes()

    def unpacked(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        flat = np.frombuffer(data)
        return int(flat[0]), flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    _, _, second = unpacked(fold(src.mapInArrow(measure, "part int, data binary"), lambda parts: packed(joined([unpacked(p) for p in parts])), width))
    error = float(np.abs(second / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, d, y in centred(batches):
            m, each = len(y), pa.array(np.repeat(np.arange(len(y)), k))
            columns = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), squared_lengths(d).take(each), pa.array((y @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return src.mapInArrow(project, WHITENED)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=32)
