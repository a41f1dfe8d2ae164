"""Words and their hashes from Arrow text columns, many documents at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, LOWER_A_Z = 0x9E3779B97F4A7C15, {c: c + 32 for c in range(65, 91)}
SPACE = frozenset([32, *range(9, 14)])
# What the words of the decontamination contract leave out, after lower-casing A-Z.
NOT_ALNUM = frozenset([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def byte_values(lower: bool = False, seed: int = 1) -> np.ndarray:
    """A fixed random 64-bit value for each byte; A-Z like a-z if asked for."""
    table = mix(np.arange(1, 257, dtype=U) * U(BASE) + U(seed))
    if lower:
        for a, b in LOWER_A_Z.items():
            table[a] = table[b]
    return table


def separators(out: frozenset[int], lower: bool = False) -> np.ndarray:
    """True for the bytes of words."""
    keep = np.ones(256, bool)
    keep[list(out)] = False
    if lower:
        for a, b in LOWER_A_Z.items():
            keep[a] = keep[b]
    return keep


class Rolling:
    """Hashes of any stretch of a sequence in constant time, from prefix sums."""

    def __init__(self, values: np.ndarray, powers: Powers):
        n = len(values)
        up, self.down = powers.to(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """One hash for each start that has ``width`` values after it."""
        k = len(self.sums) - width
        if k <= 0:
            return np.zeros(0, U)
        return mix((self.sums[width:] - self.sums[:k]) * self.down[:k] + U(width))


def slices(batch: pa.RecordBatch, most: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``most`` bytes; with each its bytes and len+1 offsets. A null is empty."""
    col = batch.column(text)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses a document. ``keep``: bool, or a class per byte (0: no word) whose change also ends a word; bytes of ``single`` are words by themselves."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = keep[data]
    inside = kind != 0
    cut = np.empty(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    cut[offsets] = True
    if single is not None:
        alone = single[data]
        cut[:-1] |= alone
        cut[1:] |= alone
    return np.flatnonzero(cut[:-1] & inside), np.flatnonzero(cut[1:] & inside) + 1


def words_of(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, and for each document where its words begin (len+1)."""
    starts, ends = word_spans(data, offsets, keep)
    hashes = Rolling(values[data], powers).spans(starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def same_bytes(load: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Whether load[a : a + n] equals load[b : b + n], for many at a time."""
    out = np.ones(len(a), bool)
    total = np.cumsum(n)
    cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(most, total[-1] if len(a) else 0, most)), len(a)])
    for i, j in zip(cuts[:-1], cuts[1:]):
        differ = load[ranges(a[i:j], n[i:j])] != load[ranges(b[i:j], n[i:j])]
        out[np.repeat(np.arange(i, j), n[i:j])[differ]] = False
    return out


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions 0..length-1 inside any of the spans."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(ends, length), -1)
    return np.cumsum(change[:-1]) > 0
