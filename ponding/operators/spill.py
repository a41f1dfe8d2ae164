"""Where places meet as water rises: sets of places joined along edges, the lowest first. An edge's level is the higher of its two ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ponding.operators.tiles import ends


def basins(z: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The lowest cell that each one runs down to, from lowest neighbour to lowest neighbour, as flat places. A cell meets it at its own height."""
    order = np.argsort(np.where(there, z, np.inf), axis=None, kind="stable")
    rank = np.empty(z.size, "i8")
    rank[order] = np.arange(z.size)
    low = np.pad(np.where(there, rank.reshape(z.shape), z.size), 1, constant_values=z.size)
    low = np.minimum(np.minimum(low[:-2], low[1:-1]), low[2:])
    low = np.minimum(np.minimum(low[:, :-2], low[:, 1:-1]), low[:, 2:]).ravel()
    return ends(np.where(there.ravel(), order[np.minimum(low, z.size - 1)], np.arange(z.size)))[0]


def lowest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lowest edge of each two places."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((w, b, a))
    order = order[(a != b)[order]]
    a, b, w = a[order], b[order], w[order]
    first = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)][: len(a)]
    return a[first], b[first], w[first]


def pairs(z: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges between cells and their eight neighbours, as flat places, with their levels."""
    at = np.arange(z.size).reshape(z.shape)
    found = [(at[:, :-1], at[:, 1:]), (at[:-1], at[1:]), (at[:-1, :-1], at[1:, 1:]), (at[:-1, 1:], at[1:, :-1])]
    a, b = (np.concatenate([f[k].ravel() for f in found]) for k in (0, 1))
    both = there.ravel()[a] & there.ravel()[b]
    a, b = a[both], b[both]
    return a, b, np.maximum(z.ravel()[a], z.ravel()[b])


def _joined(a: np.ndarray, b: np.ndarray, w: np.ndarray, count: int) -> Iterator[tuple[int, int, int]]:
    """The two sets that each edge joins, the lowest edge first: the set that takes in the other, the other, and the edge."""
    root, size = list(range(count)), [1] * count
    order = np.argsort(w, kind="stable")
    for edge, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            if size[x] < size[y]:
                x, y = y, x
            root[y] = x
            size[x] += size[y]
            yield x, y, edge


def meeting(a: np.ndarray, b: np.ndarray, w: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between kept places alone, fewer than those, that join them at the same levels as all edges do."""
    one, out = np.where(kept, np.arange(len(kept)), -1).tolist(), []
    for x, y, edge in _joined(a, b, w, len(kept)):
        if one[x] >= 0 and one[y] >= 0:
            out.append((one[x], one[y], edge))
        elif one[x] < 0:
            one[x] = one[y]
    left, right, edge = np.array(out, "i8").reshape(-1, 3).T
    return left, right, w[edge]


def levels(a: np.ndarray, b: np.ndarray, w: np.ndarray, count: int, outside: int) -> np.ndarray:
    """The level at which each place meets the place ``outside``; infinite where it never does."""
    level, dry = np.full(count, np.inf), [[k] for k in range(count)]
    level[outside], dry[outside] = -np.inf, None
    for x, y, edge in _joined(a, b, w, count):
        if dry[x] is None or dry[y] is None:
            level[dry[x] or dry[y]] = w[edge]
            dry[x] = None
        else:
            dry[x] += dry[y]
        dry[y] = []
    return level
