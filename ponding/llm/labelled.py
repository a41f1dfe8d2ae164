"""Labelled rows for the two classifiers: a bounded sample to learn from, never the held-out part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ponding.llm.common import materialize

#: Texts of more bytes are scored like all others but not learnt from.
LONGEST_LEARNT = 200_000
#: Bytes of all texts that are learnt from.
MOST_BYTES = 32_000_000


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; 0 for a null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int, most_bytes: int = MOST_BYTES, longest: int = LONGEST_LEARNT) -> DataFrame:
    """(doc_id, text, y) of labelled documents outside the held-out part, in the order of a hash of the doc_id: at most
    ``limit`` rows, one per doc_id, with at most ``most_bytes`` bytes of text in all, from texts of up to ``longest`` bytes.

    A document with labels of both kinds is left out; of rows that share a doc_id the smallest
    text stands. At most ``limit`` ids are broadcast, and as many sizes go to the driver. Null
    ids, texts and labels, and empty tables, give no rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (remainder(modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").select("doc_id", "y")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    size = F.octet_length("text").cast("long")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (size <= longest)).join(F.broadcast(known), "doc_id")
    rows = materialize(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "labelled")
    place = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id"))
    total = 0
    for h, i, n in sorted(rows.select(F.xxhash64("doc_id"), "doc_id", size).toLocalIterator()):
        total += n
        if total > most_bytes:
            return rows.where(place < F.struct(F.lit(h).alias("h"), F.lit(i).alias("doc_id")))
    return rows
