"""An R-tree packed by sort-tile-recursion, searched best first for inner products.

A node's minimum bounding box gives, per coordinate, the interval of its vectors; weighed by the
query's coordinates these add up to an interval that holds every inner product below the node.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np

LEAF, FAN = 128, 8
EXACT = 2.0**53  # integers below are exact as doubles
LONG = 2**63 - 1


def tiles(vectors: np.ndarray, leaf: int = LEAF, at: int = 0) -> Iterator[np.ndarray]:
    """Sort-tile-recursion: the rows of each leaf. Rows are sorted by a coordinate and cut into
    slabs, each slab by the next coordinate, and so on down to leaves."""
    n, d = vectors.shape
    order = np.argsort(vectors[:, at], kind="stable") if d else np.arange(n)
    leaves = -(-n // leaf)
    if at + 1 >= d or leaves <= 2:
        yield from (order[i : i + leaf] for i in range(0, n, leaf))
        return
    # Two slabs or more per coordinate, as many as leave equal work to the coordinates to come.
    slabs = max(2, round(leaves ** (1 / (d - at))))
    size = -(-leaves // slabs) * leaf
    for i in range(0, n, size):
        slab = order[i : i + size]
        yield from (slab[t] for t in tiles(vectors[slab], leaf, at + 1))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products a @ b.T of integers held as doubles; Python integers where doubles end."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return a @ b.T
    return as_integers(a) @ as_integers(b).T


def as_integers(a: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in a.ravel()], object).reshape(a.shape)


class Tree:
    """Vectors of one label in leaf order, `starts` being the first row of each leaf."""

    def __init__(self, vectors: np.ndarray, starts: np.ndarray, ids: list[tuple[int, int]], label: int):
        self.vectors, self.ids, self.label = vectors, ids, label
        self.starts = [*starts.tolist(), len(vectors)]
        self.low = [np.minimum.reduceat(vectors, starts, axis=0)]
        self.high = [np.maximum.reduceat(vectors, starts, axis=0)]
        while len(self.low[-1]) > 1:
            cuts = np.arange(0, len(self.low[-1]), FAN)
            self.low.append(np.minimum.reduceat(self.low[-1], cuts, axis=0))
            self.high.append(np.maximum.reduceat(self.high[-1], cuts, axis=0))

    def intervals(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the least and the largest inner product of each query with each box."""
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)
        return [(dot(above, lo) + dot(below, hi), dot(above, hi) + dot(below, lo)) for lo, hi in zip(self.low, self.high)]

    def search(
        self, found: list, k: int, query: np.ndarray, intervals: list[tuple[np.ndarray, np.ndarray]], scores: dict[int, np.ndarray],
        window: tuple[int, int] | None = None, but: int = -1,
    ) -> None:
        """Brings `found`, the k best rows as (-score, id, row), up to date with this tree.

        The box with the highest bound comes first. Boxes outside the window go, and those whose
        bound is strictly below the k-th score: an equal bound may hold a smaller id. `scores`
        keeps the leaves' scores for other windows of the query; `but` is a row to leave out.
        """
        low, high = window if window else (-LONG - 1, LONG)
        top = len(intervals) - 1
        queue = [(-intervals[top][1][j], top, j) for j in range(len(intervals[top][1]))]
        heapq.heapify(queue)
        while queue:
            bound, level, j = heapq.heappop(queue)
            least = max(low, -found[-1][0]) if len(found) == k else low
            if -bound < least:
                return
            if intervals[level][0][j] > high:
                continue
            if level:
                floor, ceiling = intervals[level - 1]
                for c in range(j * FAN, min(j * FAN + FAN, len(ceiling))):
                    if ceiling[c] >= least and floor[c] <= high:
                        heapq.heappush(queue, (-ceiling[c], level - 1, c))
                continue
            a, b = self.starts[j], self.starts[j + 1]
            if j not in scores:
                scores[j] = np.clip(dot(query[None], self.vectors[a:b])[0], -LONG - 1, LONG)
            leaf = scores[j]
            for i in np.flatnonzero((leaf >= least) & (leaf <= high)).tolist():
                id_, row = self.ids[a + i]
                entry = (-int(leaf[i]), id_, row)
                if row != but and (len(found) < k or entry < found[-1]):
                    insort(found, entry)
                    del found[k:]
