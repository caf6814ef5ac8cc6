"""Rolling hashes of byte ranges and words over a chunk of texts, all positions at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers have inverses modulo 2^64
BLANKS = b" \t\n\v\f\r"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _table(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[which]))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            both.append(np.multiply.accumulate(factors))
        held = _POWERS[which] = (both[0], both[1])
    return held


class Ranges:
    """Hashes of ranges of `data` (bytes, or 64-bit numbers) in constant time each."""

    def __init__(self, data: np.ndarray, which: int = 0):
        values = _table(which)[data] if data.dtype == np.uint8 else mix(data + np.uint64(_BASES[which]))
        power, self.inverse = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * power[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Words:
    """The words of several texts: where they lie in `data`, and each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than texts: text i has the words first[i] ... first[i + 1] - 1

    def hashes(self, which: int = 0) -> np.ndarray:
        return Ranges(self.data, which).hash(self.starts, self.ends)

    def texts(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def cut_words(texts: list[bytes], separators: bytes = BLANKS) -> Words:
    """Words are runs of bytes other than the separators."""
    data = np.frombuffer(b"".join(t + separators[:1] for t in texts), np.uint8)
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    edge = np.diff(np.concatenate([[False], is_word[data], [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words and the text of each; a shorter text is one run."""
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs) + first[:-1][text]
    length = np.minimum(counts, size)[text]
    h = length.astype(np.uint64)
    for i in range(size):
        inside = length > i
        part = hashes[np.minimum(at + i, max(len(hashes) - 1, 0))] if len(hashes) else hashes
        h = h * np.uint64(0x9DDFEA08EB382D69) + np.where(inside, part, np.uint64(0))
    return mix(h), text
