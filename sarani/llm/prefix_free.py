"""Prefix-free parsing of byte strings, and their suffixes in corpus order.

A text is cut where the rolling hash of TRIGGER bytes is a multiple of a number. A phrase
runs from one trigger to the end of the next, so no phrase is a proper prefix of another.
The suffix order of a repetitive collection then follows from two small suffix arrays: that
of the dictionary of different phrases and that of the parse, the sequence of phrases.
"""

from __future__ import annotations

import numpy as np

from sarani.llm.rolling import Ranges

TRIGGER = 16
RATE = 48  # a trigger stands at one of so many bytes on average


def triggers(hashes: Ranges, n: int) -> np.ndarray:
    """The places of n bytes where a trigger starts."""
    if n < TRIGGER:
        return np.zeros(0, np.int64)
    at = np.arange(n - TRIGGER + 1)
    return np.flatnonzero(hashes.hash(at, at + TRIGGER) % np.uint64(RATE) == 0)


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.int64)


def _ranks(keys: np.ndarray, go_on: np.ndarray, step: int, ends: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by prefix doubling, from keys of their first `step` symbols.

    A rank is the number of smaller suffixes. Only suffixes that are still equal to another and
    not at their end (`go_on`) are sorted again with the rank of what follows.
    """
    n = len(keys)
    rank = np.empty(n, np.int64)
    live, old = np.arange(n), np.zeros(n, np.int64)
    while len(live):
        order = np.argsort(keys)
        live, old, keys, go_on = live[order], old[order], keys[order], go_on[order]
        at = np.arange(len(live))
        opens = np.concatenate([[True], keys[1:] != keys[:-1]])  # of those equal so far
        group = np.concatenate([[True], old[1:] != old[:-1]])  # of those equal before
        first = at[opens][np.cumsum(opens) - 1]
        rank[live] = old + first - at[group][np.cumsum(group) - 1]
        tied = np.diff(np.append(np.flatnonzero(opens), len(live)))[np.cumsum(opens) - 1] > 1
        live = live[tied & go_on]
        ahead = live + step
        inside = ahead < ends[live]
        follows = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        old, step = rank[live], step * 2
        keys, go_on = old * (n + 1) + follows, inside
    return rank


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of several sequences in one array.

    `ends` holds for each place the end of its sequence; a suffix ends there, and an end is
    smaller than any symbol. Equal suffixes have equal ranks.
    """
    return _ranks(symbols, np.ones(len(symbols), bool), 1, ends)


def byte_suffix_ranks(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`suffix_ranks` of bytes, begun with seven bytes at a time in one number."""
    n, first = len(letters), 7
    packed, at = np.zeros(n, np.int64), np.arange(n)
    for k in range(first):
        ahead = at + k
        packed = packed * 257 + np.where(ahead < ends, letters[np.minimum(ahead, max(n - 1, 0))].astype(np.int64) + 1, 0)
    return _ranks(packed, at + first <= ends, first, ends)


def corpus_order(texts: list[bytes], least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, dictionary rank and parse rank of all suffixes of `least` bytes or more.

    A suffix begins in a phrase: the rest of the phrase is a suffix of the dictionary, and what
    follows is a suffix of the parse. Sorted by the two ranks, suffixes are in the order of
    their bytes.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    finish = np.cumsum(lengths)
    start = finish - lengths
    found = triggers(Ranges(data, 1), len(data))
    owner = np.searchsorted(finish, found, side="right")
    inside = (found + TRIGGER <= finish[owner]) & (found > start[owner])
    found, owner = found[inside], owner[inside]
    # A phrase: from a trigger (or the start of the text) to the end of the next (or of the text).
    some = np.flatnonzero(lengths)
    phrase_start = np.concatenate([start[some], found])
    phrase_owner = np.concatenate([some, owner])
    order = np.argsort(phrase_start, kind="stable")
    phrase_start, phrase_owner = phrase_start[order], phrase_owner[order]
    last = np.concatenate([phrase_owner[1:] != phrase_owner[:-1], [True]])[: len(phrase_owner)]
    phrase_end = np.where(last, finish[phrase_owner], np.concatenate([phrase_start[1:], [0]])[: len(last)] + TRIGGER)

    one, two = Ranges(data, 0).hash(phrase_start, phrase_end), Ranges(data, 1).hash(phrase_start, phrase_end)
    key = np.empty(len(one), [("one", np.uint64), ("two", np.uint64)])
    key["one"], key["two"] = one, two
    _, sample, phrase = np.unique(key, return_index=True, return_inverse=True)
    phrase = phrase.reshape(-1)
    size = (phrase_end - phrase_start)[sample]
    base = np.cumsum(size) - size  # the dictionary: one copy of each phrase
    letters = data[np.arange(int(size.sum())) + np.repeat(phrase_start[sample] - base, size)]
    suffix = byte_suffix_ranks(letters, np.repeat(base + size, size))
    word_rank = _dense(suffix[base])[phrase]  # phrases by their bytes

    parse_end = np.flatnonzero(last)[np.cumsum(last) - last] + 1
    parse = suffix_ranks(word_rank, parse_end)
    count = np.maximum(lengths - least + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = start[text] + offset
    which = np.searchsorted(phrase_start, at, side="right") - 1
    in_dictionary = suffix[base[phrase[which]] + at - phrase_start[which]]
    rest = np.where(last[which], 0, parse[np.minimum(which + 1, max(len(parse) - 1, 0))] + 1)
    return text, offset, in_dictionary, rest


def repeated_windows(texts: list[bytes], window: int, times: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of windows that stand at another place too.

    Equal windows are neighbours in corpus order; each neighbour is compared with the next. A
    text that stands `times` times counts so often, so its windows stand elsewhere if that is more than once.
    """
    text, offset, dictionary, parse = corpus_order(texts, window)
    if not len(text):
        return text, offset
    order = np.argsort(dictionary * (int(parse.max()) + 1) + parse)
    text, offset = text[order], offset[order]
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = (np.cumsum(lengths) - lengths)[text] + offset
    begins = np.ones(len(at), bool)
    begins[1:] = False
    for which in (0, 1):
        found = Ranges(data, which).hash(at, at + window)
        begins[1:] |= found[1:] != found[:-1]
    counts = np.ones(len(texts), np.int64) if times is None else np.array(times, np.int64)
    opens = np.flatnonzero(begins)
    total = np.add.reduceat(counts[text], opens)
    hit = np.repeat(total > 1, np.diff(np.append(opens, len(at))))
    return text[hit], offset[hit]
