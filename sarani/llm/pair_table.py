"""Merging of neighbouring symbols for many short words at once.

Every word is a row of symbols, and every pair of neighbours has the place of its merge rule. A
step merges the best pair of each row, the leftmost of equal ones, as merging the words one
by one would.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WIDTHS = (6, 9, 12, 16, 24, 32, 48, 64)  # words of about one length share a table
NO_PAIR = np.iinfo(np.int32).max
_RIGHT_BITS = 21  # holds every code point above the ids of a vocabulary


class PairTable:
    """Rules that turn a pair of symbols (numbers) into one, with a rank each: low ranks first."""

    def __init__(self, rules: dict[tuple[int, int], tuple[int, int]]):
        rows = sorted((left << _RIGHT_BITS | right, symbol, rank) for (left, right), (symbol, rank) in rules.items())
        # The last entry stands for all pairs without a rule.
        self.keys = np.array([*(r[0] for r in rows), 2**62], np.int64)
        self.symbol = np.array([*(r[1] for r in rows), -1], np.int64)
        self.rank = np.array([*(r[2] for r in rows), NO_PAIR], np.int32)

    def _entries(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair; a symbol below zero pairs with none."""
        keys = np.where((left >= 0) & (right >= 0), left << _RIGHT_BITS | right, 2**62)
        at = np.searchsorted(self.keys, keys)
        last = len(self.keys) - 1
        return np.where(self.keys[np.minimum(at, last)] == keys, at, last)

    def merge(self, symbols: np.ndarray, finish: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Merges rows of symbols, filled up with -1; `finish(numbers of rows, their symbols)` takes
        those that are done."""
        places, width = np.arange(len(symbols)), symbols.shape[1]
        entry = np.full(symbols.shape, len(self.keys) - 1)
        entry[:, :-1] = self._entries(symbols[:, :-1], symbols[:, 1:])
        while len(places):
            ranks = self.rank[entry]
            best = ranks.argmin(axis=1)
            rows = np.arange(len(best))
            done = ranks[rows, best] == NO_PAIR
            if done.any():
                finish(places[done], symbols[done])
                go = ~done
                symbols, entry, best, places = symbols[go], entry[go], best[go], places[go]
                rows = np.arange(len(best))
                if not len(places):
                    return
            symbols[rows, best] = self.symbol[entry[rows, best]]
            stay = np.ones(symbols.shape, bool)
            stay[rows, best + 1] = False
            width = symbols.shape[1] - 1
            symbols, entry = symbols[stay].reshape(-1, width), entry[stay].reshape(-1, width)
            after = np.where(best + 1 < width, symbols[rows, np.minimum(best + 1, width - 1)], -1)
            entry[rows, best] = self._entries(symbols[rows, best], after)
            inner = np.flatnonzero(best > 0)
            entry[inner, best[inner] - 1] = self._entries(symbols[inner, best[inner] - 1], symbols[inner, best[inner]])


def by_width(lengths: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """Width and numbers of the words that share a table; words of no or more than `most` symbols are in none."""
    widths = [w for w in WIDTHS if w < most] + [most]
    found = [(w, np.flatnonzero((lengths > low) & (lengths <= w))) for low, w in zip([0, *widths], widths)]
    return [(w, own) for w, own in found if len(own)]


def padded(data: bytes, lengths: np.ndarray, width: int, symbol_of: np.ndarray) -> np.ndarray:
    """Rows of symbols of words whose bytes stand one after the other."""
    inside = np.arange(width) < lengths[:, None]
    out = np.full(inside.shape, -1, np.int64)
    out[inside] = symbol_of[np.frombuffer(data, np.uint8)]
    return out
