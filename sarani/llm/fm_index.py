"""A compressed FM-index over number sequences: backward search on a wavelet matrix.

All searches of a shard advance together, one symbol per step, as array operations.
"""

from __future__ import annotations

import numpy as np

from sarani.llm.prefix_free import suffix_ranks


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling of what is still equal."""
    return np.argsort(suffix_ranks(symbols, np.full(len(symbols), len(symbols))))


class WaveletMatrix:
    """Rank queries on a sequence: one packed bit row per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.rows, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            packed = np.zeros(-(-(len(bit) + 1) // 64) * 8, np.uint8)
            raw = np.packbits(bit.astype(bool), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            self.rows.append((words, before))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.base = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (words, before) in enumerate(self.rows):
            inside = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[at >> 6] + np.bitwise_count(words[at >> 6] & inside)
            at = np.where((symbol >> (self.levels - 1 - i)) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbol, at) - self.base[symbol]


class Shard:
    """An index over sequences with an owner each, who is a number."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray):
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        known, compact = np.unique(np.concatenate(sequences), return_inverse=True)
        # Each sequence ends with a mark of its own, smaller than every symbol.
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.lengths = lengths
        text = np.empty(int((lengths + 1).sum()), np.int64)
        ends = self.starts + lengths
        text[ends] = np.arange(len(sequences))
        is_symbol = np.ones(len(text), bool)
        is_symbol[ends] = False
        text[is_symbol] = compact.reshape(-1) + len(sequences)
        self.text = text
        order = suffix_order(text)
        size = len(sequences) + len(known)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.wavelet = WaveletMatrix(text[order - 1], size)
        _, self.owner = np.unique(owners, return_inverse=True)
        of_text = np.repeat(self.owner, lengths + 1)[order].astype(np.int32)
        self.least = [of_text]  # least owner of 2^k suffixes from each place on
        while 2 << (len(self.least) - 1) <= len(text):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def extend(self, symbol, low, high):
        """The suffix ranges after one more symbol in front."""
        both = np.tile(self.counts[symbol], 2) + self.wavelet.rank(np.tile(symbol, 2), np.concatenate([low, high]))
        return both[: len(symbol)], both[len(symbol) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner in each range that isn't empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.least[k]
            found[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return found

    def matches_of_smaller(
        self, anchors: np.ndarray, anchor_length: int, window: int, later: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, whether it is searched as a later copy, start and end of maximal runs whose
        every window a smaller owner has too.

        Every sequence is searched, and those of `later` once more as copies in the hands of someone
        larger than their owner, who is smaller then himself. Only windows that hold the anchor
        (at `anchors` in each sequence) count. Matching statistics are read from the right: a
        search goes left as long as a smaller owner has the string; the next one starts where a
        further window could begin. All searches advance together.
        """
        n = len(self.lengths)
        which = np.concatenate([np.arange(n), np.zeros(0, np.int64) if later is None else later])
        copy = np.arange(len(which)) >= n
        starts, lengths, anchors = self.starts[which], self.lengths[which], anchors[which]
        owner = self.owner[which] + copy
        phase, end = np.zeros(len(which), np.int64), anchors + anchor_length
        place, left = end.copy(), np.zeros(len(which), np.int64)
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.text), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(lengths >= window)
        while len(live):
            symbol = self.text[starts[live] + np.maximum(place[live] - 1, 0)]
            new_low, new_high = self.extend(symbol, low[live], high[live])
            good = (new_low < new_high) & (place[live] > left[live])
            where = np.flatnonzero(good)
            good[where] = self.least_owner(new_low[where], new_high[where]) < owner[live[where]]
            ahead = live[good]
            low[ahead], high[ahead] = new_low[good], new_high[good]
            place[ahead] -= 1
            stopped = live[~good | (place[live] <= left[live])]
            if not len(stopped):
                continue
            first = phase[stopped] == 0
            begun, done = stopped[first], stopped[~first]
            left[begun], end[begun], phase[begun] = place[begun], lengths[begun], 1
            matched = end[done] - place[done] >= window
            hits = done[matched]
            found.append((hits, place[hits].copy(), end[hits].copy()))
            end[done] = np.where(matched, np.where(place[done] <= left[done], -1, place[done] + window - 1), end[done] - 1)
            place[stopped], low[stopped], high[stopped] = end[stopped], 0, len(self.text)
            over = np.zeros(len(which), bool)
            over[stopped] = end[stopped] < np.maximum(left[stopped] + window, anchors[stopped] + anchor_length)
            live = live[~over[live]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit, begin, stop = (np.concatenate(x) for x in zip(*found))
        return which[hit], copy[hit], begin, stop
