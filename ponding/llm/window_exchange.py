"""Bring equal windows of all documents together: sketch, filter, deal out, judge in shards, return runs.

Both the word and the byte deduplication go this way. A first pass sketches the anchors;
a second sends only segments whose anchor the sketch estimates repeated, each distinct one
once per chunk of a task, compressed and by shard. What a chunk can tell alone (a copy in
the same chunk) is not sent. An anchor with more than a 4,096th of all segments is dealt
by single windows instead, so that no shard grows with one hot passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ponding.llm.anchors import Segments, segments, split_single
from ponding.llm.common import total_bytes
from ponding.llm.sketch import Sketch, build, expand, noise, squeeze, width_for
from ponding.llm.words import SPACE, Powers, Rolling, U, byte_values, mix, ranges, same_bytes, separators, slices, words_of

SLICE_BYTES, CHUNK_BYTES, SHARD_BYTES = 1_000_000, 24_000_000, 2_000_000
NULL_ID = np.int64(2**63 - 1)


@dataclass(frozen=True)
class Grain:
    """words or bytes; the window's length; the anchor's length in n-grams of the same unit."""

    words: bool
    width: int
    gram: int

    def bytes_per_anchor(self) -> float:
        return (6.0 if self.words else 1.0) * (self.width - self.gram + 2) / 2


KEEP, VALUES = separators(SPACE), byte_values()


def sequence(grain: Grain, data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[Rolling, np.ndarray]:
    """The rolling hash of a slice's units and where each document's begin."""
    if not grain.words:
        return Rolling(VALUES[data], powers), offsets
    _, _, hashes, first = words_of(data, offsets, KEEP, VALUES, powers)
    return Rolling(hashes, powers), first


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy(), batch.column("tag").to_numpy()


class Chunk:
    """Segments gathered from slices until they are worth sending; with ``copies``, also those that equal one of a smaller document."""

    def __init__(self, grain: Grain, buckets: int, copies: bool = False):
        self.grain, self.buckets, self.copies = grain, buckets, copies
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.loads: list[np.ndarray] = []
        self.bytes = 0

    def add(self, s: Segments, single: np.ndarray, rolling: Rolling, data: np.ndarray, first: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
        g = self.grain
        content = mix(rolling.spans(s.start, s.start + s.count + g.width - 1) + mix(s.key + (s.anchor - s.start).astype(U)))
        if g.words:
            load, size = rolling.windows(g.width)[ranges(s.start, s.count)], s.count
            left = np.zeros(len(s.start), np.uint8)
        else:
            size = s.count + g.width
            load = data[np.maximum(ranges(s.start - 1, size), 0)]
            left = (s.start > first[s.doc]).astype(np.uint8)
        self.parts.append((s.start - first[s.doc], s.count, s.anchor - s.start, s.key, ids[s.doc], tags[s.doc], content, size, left, single))
        self.loads.append(load)
        self.bytes += load.nbytes + 70 * len(s.start)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob): segments for shard ``bucket``, or below 0 runs of windows known to be repeated."""
        if not self.parts:
            return
        start, count, off, key, doc, tag, content, size, left, single = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        load = np.concatenate(self.loads)
        at = np.cumsum(size) - size
        self.parts, self.loads, self.bytes = [], [], 0
        while True:
            order = np.lexsort((start, tag, doc, content))
            cut = np.r_[True, content[order][1:] != content[order][:-1]]
            if self.grain.words:
                break
            # Segments of one hash are compared with the first of them; one that differs gets a hash of its own.
            more = np.flatnonzero(~cut)
            head = order[np.flatnonzero(cut)[np.cumsum(cut) - 1][more]]
            more = order[more]
            alike = size[more] == size[head]
            alike[alike] = same_bytes(load, at[more[alike]] + 1, at[head[alike]] + 1, size[more[alike]] - 1)
            if alike.all():
                break
            content[more[~alike]] = mix(content[more[~alike]] + more[~alike].astype(U) + U(1))
        if self.copies:
            cut[1:] |= doc[order][1:] != doc[order][:-1]
        group = np.cumsum(cut) - 1
        heads = np.flatnonzero(cut)
        sizes = np.diff(np.r_[heads, len(order)])
        if self.grain.words:
            known, sent = (sizes > 1)[group], cut
            refs = (sizes == 1).astype(np.int64)
        else:
            known = doc[order] > doc[order[heads]][group]
            sent = ~known
            refs = np.bincount(group[sent], minlength=len(heads))
        yield from self._known(order[known], doc, tag, start, count)
        rep = order[heads]
        bucket = np.where(single[rep], mix(content[rep]), mix(key[rep])) % U(self.buckets)
        by = np.argsort(bucket, kind="stable")
        rep, refs, bucket, sizes = rep[by], refs[by], bucket[by], sizes[by]
        members = order[sent] if not self.grain.words else order[heads]
        mstart = np.flatnonzero(np.r_[True, group[sent][1:] != group[sent][:-1]]) if not self.grain.words else np.arange(len(heads))
        flat = members[ranges(mstart[by], refs)]
        rcut = np.r_[0, np.cumsum(refs)]
        load = load[ranges(at[rep], size[rep])]
        lcut = np.r_[0, np.cumsum(size[rep])]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rep)]):
            r, f = rep[i:j], flat[rcut[i] : rcut[j]]
            yield int(bucket[i]), squeeze(key[r] if self.grain.words else key[:0], off[r].astype(np.uint16), count[r].astype(np.uint16), left[r], np.minimum(sizes[i:j], 2).astype(np.uint8), doc[r], refs[i:j].astype(np.uint32), tag[f], start[f], load[lcut[i] : lcut[j]])

    def _known(self, which: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, bytes]]:
        if not len(which):
            return
        which = which[np.lexsort((start[which], tag[which], doc[which]))]
        d, t, s, n = doc[which], tag[which], start[which], count[which]
        cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + n[:-1])])
        total = np.add.reduceat(n, cut)
        d, t, s = d[cut], t[cut], s[cut]
        spread = int(mix(np.array([d[0] ^ t[0] ^ len(d)]).astype(U))[0])
        for k, i in enumerate(range(0, len(d), 100_000)):
            yield -1 - (spread + k) % self.buckets, squeeze(d[i : i + 100_000], t[i : i + 100_000], s[i : i + 100_000], total[i : i + 100_000])


@dataclass
class Shard:
    """Distinct segments of one shard from all chunks; refs: the rows (tag, start) that await a verdict.

    key: the anchors' hashes, of word segments only; byte segments have the anchor's bytes.
    """

    key: np.ndarray
    off: np.ndarray
    count: np.ndarray
    left: np.ndarray
    weight: np.ndarray
    doc: np.ndarray
    refs: np.ndarray
    tag: np.ndarray
    start: np.ndarray
    load: np.ndarray


def read_shard(blobs: list[bytes], words: bool) -> Shard:
    types = (np.uint64, np.uint16, np.uint16, np.uint8, np.uint8, np.int64, np.uint32, np.int64, np.int64, np.uint64 if words else np.uint8)
    parts = [np.concatenate(x) for x in zip(*(expand(b, *types) for b in blobs), strict=True)]
    for k in (1, 2, 6):
        parts[k] = parts[k].astype(np.int64)
    return Shard(*parts)


RUNS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
RUNS_DDL = "doc_id long, tag long, start long, n long"


def run_batch(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(doc, pa.int64(), mask=doc == NULL_ID)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (tag, start, n))], schema=RUNS)


def deal(docs: DataFrame, grain: Grain, copies: bool = False) -> DataFrame:
    """docs: doc_id, text, tag. Rows (bucket, blob) for :func:`read_shard`, not yet shuffled; ``copies`` of bytes: see :class:`Chunk`."""
    n_bytes = total_bytes(docs)
    expected = n_bytes / grain.bytes_per_anchor()
    buckets = max(32, n_bytes // SHARD_BYTES)
    width = width_for(expected, 2.5)
    # However full the sketch is, no more than some 4,096 anchors a row can be heavy.
    heavy = max(256, int(expected / 4096 + 2 * noise(expected, width)))

    def found(batch: pa.RecordBatch, powers: Powers) -> Iterator[tuple]:
        for part, data, offsets in slices(batch, SLICE_BYTES):
            rolling, first = sequence(grain, data, offsets, powers)
            yield part, data, rolling, first, segments(rolling, first, grain.width, grain.gram)

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        powers = Powers()
        for *_, s in found(batch, powers):
            yield s.key

    shared = build(docs.select("text"), keys, width)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(*shared.value)
        powers, chunk = Powers(), Chunk(grain, buckets, copies)

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(chunk.flush())
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 64]], pa.int64()), pa.array([r[1] for r in rows[i : i + 64]], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for part, data, rolling, first, s in found(batch, powers):
                s = s.take(np.flatnonzero(sketch.estimate(s.key) > 1))
                if len(s.start):
                    s, single = split_single(s, sketch.estimate_large(s.key) >= heavy)
                    chunk.add(s, single, rolling, data, first, *_ids(part))
                if chunk.bytes >= CHUNK_BYTES:
                    yield from out()
        yield from out()

    return docs.mapInArrow(candidates, "bucket long, blob binary")


def judge(dealt: DataFrame, words: bool, verdict: Callable[[Shard], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Runs of windows (doc_id, tag, start, n) that ``verdict`` finds in each shard, and those known before."""

    def shard(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x.as_py() for b in batches for x in b.column("blob")]
        if key[0].as_py() < 0:
            for b in blobs:
                yield run_batch(*expand(b, np.int64, np.int64, np.int64, np.int64))
        else:
            yield run_batch(*verdict(read_shard(blobs, words)))

    return dealt.groupBy("bucket").applyInArrow(shard, RUNS_DDL)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the way through a shuffle."""
    codec = pa.Codec("zstd", compression_level=1)
    for b in batches:
        at = b.schema.names.index("text")
        raw = [t.as_py() for t in b.column(at).cast(pa.binary())]
        blobs = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in raw]
        yield b.set_column(at, "text", pa.array(blobs, pa.binary()))


def unpacked(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """What :func:`with_runs` returns, with the texts' bytes."""
    codec = pa.Codec("zstd")
    for b in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
        at = b.schema.names.index("text")
        blobs = [t.as_py() for t in b.column(at)]
        raw = [None if t is None else codec.decompress(memoryview(t)[8:], int.from_bytes(t[:8], "little"), asbytes=True) for t in blobs]
        yield b.set_column(at, "text", pa.array(raw, pa.large_binary()))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The documents with ``runs``, a list of (start, n), null where there are none; read their texts by :func:`unpacked`.

    Rows are told apart by doc_id and text. Spark may split the join where a key has many rows.
    """
    by = runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs")).withColumnsRenamed({"doc_id": "r_id", "tag": "r_tag"})
    packed = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in docs.schema])
    docs = docs.mapInArrow(_packed, packed)
    return docs.join(by, docs.doc_id.eqNullSafe(by.r_id) & (docs.tag == by.r_tag), "left").drop("r_id", "r_tag")


def window_spans(runs: pa.ListArray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row the starts and ends of what its runs of windows cover."""
    flat = runs.flatten()
    start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
    at = np.r_[0, np.cumsum(runs.value_lengths().fill_null(0).to_numpy())]
    for i, j in zip(at, at[1:]):
        yield start[i:j], start[i:j] + n[i:j] + width - 1
