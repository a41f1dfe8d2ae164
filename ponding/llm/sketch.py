"""A count-min sketch of 64-bit keys, built per partition, merged by blocks of counters in a shuffle.

Estimates never fall below the true count: fine counters stop at 3 (enough to tell 1 from
more), coarse ones, sums of 64 fine ones, have 32 bits. The width follows the input up to a
bound, so what is broadcast is at most ``most`` counters a row; past it the sketch passes
more keys on, and the exact stages behind it still see all they need. Large counts stay
meaningful at any size: what other keys add to them is :func:`noise` on average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.llm.words import U, mix

DEPTH, BLOCK, COARSE = 2, 1 << 16, 64
MOST = 1 << 27
FLUSH = 1_500_000
CODEC = "zstd"


def width_for(keys: float, per_key: float = 1.5, most: int = MOST) -> int:
    """Counters in a row: ``per_key`` for each key expected."""
    return int(min(most, max(BLOCK, -(-int(per_key * keys) // BLOCK) * BLOCK)))


def noise(keys: float, width: int) -> float:
    """What a coarse counter holds on average of other keys."""
    return keys * COARSE / width


def places(keys: np.ndarray, width: int, row: int) -> np.ndarray:
    return ((mix(keys + U(0x51ED2701 * (row + 1))) >> U(32)) * U(width)) >> U(32)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; :func:`expand` needs their types."""
    raw = b"".join([np.array([len(a) for a in arrays], np.uint32).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(raw).to_bytes(4, "little") + pa.Codec(CODEC, compression_level=1).compress(raw, asbytes=True)


def expand(value: bytes, *types: type) -> list[np.ndarray]:
    raw = pa.Codec(CODEC).decompress(memoryview(value)[4:], int.from_bytes(value[:4], "little"), asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.uint32, len(types)), 4 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """All lowest bytes, then the next, and so on: high bytes are alike, and compress well side by side."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.ravel()


def whole(parts: np.ndarray, kind: type) -> np.ndarray:
    """What :func:`planes` took apart."""
    return np.ascontiguousarray(parts.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _blocks(keys: np.ndarray, width: int) -> pa.RecordBatch:
    parts, blobs = [], []
    for row in range(DEPTH):
        at = np.sort(places(keys, width, row).astype(np.uint32))
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(at)]).astype(np.uint32)
        at = at[first]
        cuts = np.flatnonzero(np.r_[True, (at[1:] >> 16) != (at[:-1] >> 16)]) if len(at) else []
        for i, j in zip(cuts, [*cuts[1:], len(at)]):
            parts.append(row * (width // BLOCK) + int(at[i] >> 16))
            blobs.append(squeeze(np.diff(at[i:j] & 0xFFFF, prepend=0).astype(np.uint16), counts[i:j]))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, np.int64)
    for b in batches:
        for blob in b.column("counts"):
            steps, counts = expand(blob.as_py(), np.uint16, np.uint32)
            total[np.cumsum(steps.astype(np.int64))] += counts
    fine = np.minimum(total, 3).astype(np.uint8).reshape(-1, 4)
    packed = fine[:, 0] | fine[:, 1] << 2 | fine[:, 2] << 4 | fine[:, 3] << 6
    coarse = np.minimum(total.reshape(-1, COARSE).sum(1), 2**32 - 1).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed.tobytes()]), pa.array([coarse.tobytes()])], names=["part", "fine", "coarse"])


class Sketch:
    def __init__(self, width: int, fine: list[bytearray], coarse: list[bytearray]):
        self.width, self.fine, self.coarse = width, fine, coarse

    def _rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for row in range(DEPTH):
            yield row, np.frombuffer(self.fine[row], np.uint8), np.frombuffer(self.coarse[row], np.uint32)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        """At least the count of each key, up to 3."""
        out = np.full(len(keys), 3, np.uint8)
        for row, fine, _ in self._rows():
            at = places(keys, self.width, row)
            np.minimum(out, (fine[at >> U(2)] >> ((at & U(3)) << U(1)).astype(np.uint8)) & 3, out=out)
        return out

    def estimate_large(self, keys: np.ndarray) -> np.ndarray:
        """At least the count of each key, up to 2^32 - 1; rough for small counts."""
        out = np.full(len(keys), 2**32 - 1, np.uint32)
        for row, _, coarse in self._rows():
            np.minimum(out, coarse[places(keys, self.width, row) // U(COARSE)], out=out)
        return out


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], width: int):
    """A broadcast of the arguments of a :class:`Sketch` of all keys that ``keys_of`` finds in the rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            for keys in keys_of(b):
                kept.append(keys)
                n += len(keys)
                if n >= FLUSH:
                    yield _blocks(np.concatenate(kept), width)
                    kept, n = [], 0
        if n:
            yield _blocks(np.concatenate(kept), width)

    merged = df.mapInArrow(partial, "part int, counts binary").groupBy("part").applyInArrow(_merge, "part int, fine binary, coarse binary")
    per_row = width // BLOCK
    fine, coarse = ([bytearray(n) for _ in range(DEPTH)] for n in (width // 4, 4 * width // COARSE))
    # Bounded by ``most``, whatever the input; one partition of blocks at a time passes through.
    for part, a, b in merged.toLocalIterator():
        row, k = divmod(part, per_row)
        fine[row][k * len(a) : (k + 1) * len(a)] = a
        coarse[row][k * len(b) : (k + 1) * len(b)] = b
    return df.sparkSession.sparkContext.broadcast((width, fine, coarse))
