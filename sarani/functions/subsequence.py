"""Longest common subsequences of word lists, bit-parallel, as native expressions.

A row of the table is held as bits: bit j of row i is clear when the subsequence of the first
i words with the first j + 1 words of the other list is longer than with the first j. A row
follows from the one before by an addition and some logic, 62 words at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sarani.functions.once import let

BITS = 62  # of a block: a sum of two blocks and a carry still fits a long
_FULL = (1 << BITS) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _powers() -> Column:
    return F.array(*[_long(1 << i) for i in range(BITS)])


def _blocks(n: Column) -> Column:
    """0, 1, ... for as many blocks as n words fill, one at least."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(n / BITS).cast("int") - 1, F.lit(0)))


def _masks(words: Column, distinct: Column) -> Column:
    """Per distinct word its places in `words`, as bits in blocks."""

    def mask(word):
        def block(b):
            bits = F.transform(F.slice(words, b * BITS + 1, BITS), lambda w, i: F.when(w == word, F.get(_powers(), i)).otherwise(_long(0)))
            return F.aggregate(bits, _long(0), lambda a, x: a + x)

        return F.transform(_blocks(F.size(words)), block)

    return F.transform(distinct, mask)


def _next_row(row: Column, mask: Column) -> Column:
    """The row after a word whose places are `mask`: (row + hits | row - hits) over all blocks."""
    start = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(state, b):
        def summed(x, hits):
            total = x + hits + state["carry"]
            return let(total, lambda t: F.struct(
                F.shiftright(t, BITS).alias("carry"),
                F.concat(state["out"], F.array(t.bitwiseAND(_long(_FULL)).bitwiseOR(x - hits))).alias("out"),
            ))

        return let(F.get(row, b), lambda x: let(x.bitwiseAND(F.get(mask, b)), lambda hits: summed(x, hits)))

    return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), start, step)["out"]


def _clear_below(row: Column, n: Column) -> Column:
    """How many of the first n bits are clear."""

    def counted(total, b):
        inside = F.least(F.greatest(n - b * BITS, F.lit(0)), F.lit(BITS))
        # 2^62 - 1 has all bits of a block.
        below = F.when(inside < BITS, F.get(_powers(), inside) - _long(1)).otherwise(_long(_FULL))
        return total + inside - F.bit_count(F.get(row, b).bitwiseAND(below))

    return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), F.lit(0), counted)


def _first_row(other: Column) -> Column:
    return F.transform(_blocks(F.size(other)), lambda _: _long(_FULL))


def _mask_of(word: Column, distinct: Column, masks: Column) -> Column:
    """The places of a word in the other list; null if it has none."""
    return F.get(masks, F.array_position(distinct, word).cast("int") - 1)


def common_length(words: Column, other: Column) -> Column:
    """Length of the longest common subsequence of two word lists."""

    def length(distinct, masks):
        def step(row, word):
            return let(_mask_of(word, distinct, masks), lambda mask: F.when(mask.isNull(), row).otherwise(_next_row(row, mask)))

        return F.aggregate(words, _first_row(other), step, lambda row: _clear_below(row, F.size(other)))

    return let(F.array_distinct(other), lambda d: let(_masks(other, d), lambda m: length(d, m)))


def common_places(words: Column, other: Column) -> Column:
    """Places (from 1) in `words` of one longest common subsequence with `other`.

    It is that which the walk through the table from its end finds: a match is taken; else the
    walk goes back in `other` if that keeps more, else in `words`.
    """

    def rows(distinct, masks):
        def step(state, word):
            last = F.element_at(state, -1)
            return F.concat(state, F.array(let(_mask_of(word, distinct, masks), lambda mask: F.when(mask.isNull(), last).otherwise(_next_row(last, mask)))))

        return F.aggregate(words, F.array(_first_row(other)), step)

    def walk(table):
        start = F.struct(F.size(words).alias("i"), F.size(other).alias("j"), F.array().cast("array<int>").alias("places"))

        def step(state, _):
            i, j = state["i"], state["j"]
            moved = lambda i, j, places: F.struct(i.alias("i"), j.alias("j"), places.alias("places"))
            back = _clear_below(F.get(table, i), j - 1) > _clear_below(F.get(table, i - 1), j)
            return (
                F.when((i == 0) | (j == 0), state)
                .when(F.get(words, i - 1) == F.get(other, j - 1), moved(i - 1, j - 1, F.concat(state["places"], F.array(i))))
                .when(back, moved(i, j - 1, state["places"]))
                .otherwise(moved(i - 1, j, state["places"]))
            )

        return F.aggregate(F.sequence(F.lit(1), F.size(words) + F.size(other)), start, step)["places"]

    found = let(F.array_distinct(other), lambda d: let(_masks(other, d), lambda m: let(rows(d, m), walk)))
    none = F.array().cast("array<int>")
    return F.when((F.size(words) > 0) & (F.size(other) > 0) & F.arrays_overlap(words, other), found).otherwise(none)
