"""Of the keys of many sets, how often each occurs in all of them, exactly and at any size.

A sketch that every task holds is full from some size on and then tells nothing apart. Here
the keys are dealt out instead: a block of sets sends each part of the keys its own ones, by
their leading bits, sorted and shortened to a few bits more than their number needs. The part
counts them and answers each block, and what the parts answer is put together by block. Keys
that fall together when shortened, about one in a hundred, count as one, so a count is never
below the true one, and it is the same in every set. Nothing is in one place but a block or a
part, and both have about the same size whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ponding.llm.sketch import expand, planes, squeeze, whole
from ponding.llm.words import U, ranges

#: Keys of a block, keys of a part, parts at least, bits of a key beyond those that the number of keys needs.
BLOCK, PER_PART, PARTS, SPARE = 1_500_000, 1 << 21, 64, 6
ROWS = ["block", "part", "data"]
SCHEMA = "block long, part long, data binary"

#: Sets: an id and a number for each, all their keys (uniform 64-bit hashes, distinct and rising within a set), and where each begins (len+1).
Sets = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def layout(expected: float) -> tuple[int, int]:
    """Bits of a key that name its part, and those that tell keys of a part apart."""
    outer = max(PARTS, 1 << int(expected / PER_PART).bit_length()).bit_length() - 1
    return outer, min(32, (int(expected) >> outer).bit_length() + SPARE)


def _rows(block: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([p for p, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=ROWS)


def send(kept: list[Sets], block: int, outer: int, inner: int) -> pa.RecordBatch:
    """A row for each part that a block of sets has keys of, and one (its part below 0) that names the sets."""
    ids, n, keys = (np.concatenate([s[k] for s in kept]) for k in range(3))
    size = np.concatenate([np.diff(s[3]) for s in kept])
    code = keys >> U(64 - outer - inner)
    order = np.argsort(code)
    code, owner = code[order], np.repeat(np.arange(len(ids), dtype=np.uint32), size)[order]
    cuts = np.searchsorted(code, np.arange((1 << outer) + 1, dtype=U) << U(inner))
    low = (code & U((1 << inner) - 1)).astype(np.uint32)
    rows = [(-1 - block % (1 << outer), squeeze(ids.astype(np.int64), n.astype(np.int64), size.astype(np.int64)))]
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        i, j = cuts[p], cuts[p + 1]
        rows.append((p, squeeze(planes(np.diff(low[i:j], prepend=np.uint32(0))), planes(owner[i:j]))))
    return _rows(block, rows)


def answer(sent: list[tuple[int, bytes]], ranked: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """To each block of a part: how many keys each of its sets has there, and their ranks, set by set in order of the keys."""
    got = []
    for block, data in sent:
        steps, owner = expand(data, np.uint8, np.uint8)
        got.append((block, np.cumsum(whole(steps, np.uint32), dtype=np.uint32), whole(owner, np.uint32)))
    every = np.sort(np.concatenate([low for _, low, _ in got]))
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    rank = ranked(np.diff(np.r_[first, len(every)])).astype(np.uint8)
    known = every[first]
    for block, low, owner in got:
        yield block, squeeze(planes(np.bincount(owner).astype(np.uint32)), rank[np.searchsorted(known, low)][np.argsort(owner, kind="stable")])


def ranks(df: DataFrame, sets_of: Callable[[Iterator[pa.RecordBatch]], Iterable[Sets]], expected: float, ranked: Callable[[np.ndarray], np.ndarray], finish: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """``finish(ids, numbers, ranks, first)`` of every block of the sets that ``sets_of`` finds in the rows; ``ranked`` makes small whole numbers of counts.

    ``expected`` keys, about: with many more, parts are larger and more keys fall together, no more.
    """
    outer, inner = layout(expected)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, n = TaskContext.get().partitionId() << 32, [], 0
        for found in sets_of(batches):
            if len(found[0]):
                kept.append(found)
                n += len(found[2])
            if n >= BLOCK:
                yield send(kept, block, outer, inner)
                block, kept, n = block + 1, [], 0
        if kept:
            yield send(kept, block, outer, inner)

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        if part < 0:
            yield from (b.select(ROWS) for b in batches)
            return
        sent = [x for b in batches for x in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True)]
        out = list(answer(sent, ranked))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([part] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())], names=ROWS)

    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, *answers = pa.Table.from_batches(batches).sort_by("part").column("data").to_pylist()
        ids, numbers, size = expand(head, np.int64, np.int64, np.int64)
        first = np.r_[0, np.cumsum(size)]
        at, out = first[:-1].copy(), np.zeros(first[-1], np.uint8)
        # Parts rise with the keys, so a set's ranks follow each other part by part.
        for data in answers:
            counts, found = expand(data, np.uint8, np.uint8)
            counts = whole(counts, np.uint32).astype(np.int64)
            out[ranges(at[: len(counts)], counts)] = found
            at[: len(counts)] += counts
        yield finish(ids, numbers, out, first)

    sent = df.mapInArrow(blocks, SCHEMA)
    return sent.groupBy("part").applyInArrow(count, SCHEMA).groupBy("block").applyInArrow(gather, schema)
