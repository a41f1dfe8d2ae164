"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Row numbers come from the data, not from the file layout: rows are counted by
(id, text_crc32, size), each such key gets a gapless range of numbers, and a keyed
permutation of 0..N-1 turns a number into a position. ``shard = position mod shards``
and ``slot = position div shards``, so either is computable from a row number, N and
the key alone, and counts of shards differ by one at most.

Nulls: a null id is a value like any other and sorts first; a null text has size 8
(no bytes) and the CRC-32 of no bytes, 0. Repeated rows are interchangeable: a key
seen c times gets c numbers. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
M1, M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


def round_keys(key: int) -> list[int]:
    return [int(_mix(np.array([(key * ROUNDS + r + 1) * 0x9E3779B97F4A7C15 % 2**64], np.uint64))[0]) for r in range(ROUNDS)]


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1: a Feistel network over the smallest 4**k >= n, walked until it is back inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    shift, mask, keys = np.uint64(half), np.uint64((1 << half) - 1), [np.uint64(k) for k in round_keys(key)]
    x = numbers.astype(np.uint64)
    out = np.arange(len(x))
    result = np.empty(len(x), np.int64)
    while len(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        x = (left << shift) | right
        inside = x < np.uint64(n)
        result[out[inside]] = x[inside].astype(np.int64)
        x, out = x[~inside], out[~inside]
    return result


def unpermute(positions: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse of :func:`permute`: which row number is at a position."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    shift, mask, keys = np.uint64(half), np.uint64((1 << half) - 1), [np.uint64(k) for k in round_keys(key)]
    x = positions.astype(np.uint64)
    out = np.arange(len(x))
    result = np.empty(len(x), np.int64)
    while len(x):
        left, right = x >> shift, x & mask
        for k in reversed(keys):
            left, right = right ^ (_mix(left + k) & mask), left
        x = (left << shift) | right
        inside = x < np.uint64(n)
        result[out[inside]] = x[inside].astype(np.int64)
        x, out = x[~inside], out[~inside]
    return result


def number_rows(keys: DataFrame, buckets: int) -> DataFrame:
    """keys: distinct rows with a count ``copies``. Adds ``first``: where the key's range of row numbers begins.

    Hash buckets keep every window small; only one count per bucket is put in one order.
    """
    names = [c for c in keys.columns if c != "copies"]
    k = keys.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    sums = k.groupBy("bucket").agg(F.sum("copies").alias("rows"))
    before = sums.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("before"))
    inside = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in names])
    k = k.withColumn("inside", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    return k.join(F.broadcast(before), "bucket").withColumn("first", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")


def shard(df: DataFrame, shards: int, key: int = 17, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, row_number, position, shard, slot.

    Only ids, sizes and checksums are shuffled. ``buckets``: by default as many as keep each
    near 200,000 rows, 1,024 at least; one count of each is ordered in one place and broadcast.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    n = int(rows.count())
    numbered = number_rows(keys, buckets or max(1024, n // 200_000))
    # A key with many copies is unrolled in two steps, so that no array is long.
    block = 1 << 16
    pieces = numbered.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / block)))).withColumn("from", F.col("at") * block)
    one = pieces.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("copies"), F.col("from") + block) - 1)))
    one = one.select("doc_id", "size", "text_crc32", (F.col("first") + F.col("i")).alias("row_number"))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = permute(b.column("row_number").to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=[*b.schema.names, "position", "shard", "slot"])

    return one.mapInArrow(positions, "doc_id long, size long, text_crc32 long, row_number long, position long, shard int, slot long")


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
