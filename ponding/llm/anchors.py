"""Windows of a sequence, dealt out by the anchors they contain.

The anchor of a window is the leftmost of its n-grams with the smallest hash. It depends
on the window's content alone, so equal windows, wherever they stand, have equal anchors
and meet in one shard; and neighbouring windows mostly share an anchor, so that about one
n-gram in fifteen speaks for them all. A window occurs at most as often as its anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ponding.llm.words import U, Rolling, ranges


@dataclass
class Segments:
    """Runs of windows with one anchor: where each begins, how many windows, the anchor's place and hash, the document."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    doc: np.ndarray

    def take(self, which: np.ndarray) -> Segments:
        return Segments(self.start[which], self.count[which], self.anchor[which], self.key[which], self.doc[which])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def segments(rolling: Rolling, first: np.ndarray, width: int, gram: int) -> Segments:
    """All segments of the documents whose values begin at ``first`` (len+1)."""
    n = len(rolling.sums) - 1
    none = np.zeros(0, np.int64)
    if n < width:
        return Segments(none, none, none, np.zeros(0, U), none)
    grams = rolling.windows(gram)
    bits = max(20, n.bit_length())
    low = U((1 << bits) - 1)
    best = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), width - gram + 1)
    change = np.zeros(n + 1, np.int32)
    inner = first[1:-1]
    np.add.at(change, np.maximum(inner - width + 1, 0), 1)
    np.add.at(change, inner, -1)
    at = np.flatnonzero(np.cumsum(change[: n - width + 1]) == 0)
    anchor = (best[at] & low).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(at) else none
    start, anchor = at[cut], anchor[cut]
    return Segments(start, np.diff(np.r_[cut, len(at)]), anchor, grams[anchor], np.searchsorted(first, start, "right") - 1)


def split_single(s: Segments, which: np.ndarray) -> tuple[Segments, np.ndarray]:
    """The segments with those of ``which`` cut into single windows; True for the latter."""
    whole, cut = s.take(~which), s.take(which)
    one = Segments(ranges(cut.start, cut.count), np.ones(int(cut.count.sum()), np.int64), np.repeat(cut.anchor, cut.count), np.repeat(cut.key, cut.count), np.repeat(cut.doc, cut.count))
    both = Segments(*(np.concatenate([getattr(whole, f), getattr(one, f)]) for f in ("start", "count", "anchor", "key", "doc")))
    return both, np.r_[np.zeros(len(whole.start), bool), np.ones(len(one.start), bool)]


def runs(mask: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True; none crosses an edge (edges: starts of groups)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    inner = edges[(edges > 0) & (edges < len(mask))]
    begin[inner] = mask[inner]
    end[inner - 1] = mask[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1 - starts
