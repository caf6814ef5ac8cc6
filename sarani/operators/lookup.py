"""Look-ups of words in a table of (source, target), whatever its size and theirs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sarani.session import BROADCAST_ROWS, is_small, materialise

# A table up to this size travels inside the expression; up to the broadcast size, to every task.
RECORD_ROWS = 20_000
RECORD_BYTES = 1 << 20
# A word is hot if it is more than one of so many words; so there are at most so many hot words.
HOT_PARTS = 10_000


# Up to so many words a bit mask travels inside the expression, to tell most other words from them.
MASK_WORDS = 100_000


def _slot(word: Column, slots: int) -> Column:
    """The slot of a word; `slots` is a power of two."""
    return F.hash(word).bitwiseAND(F.lit(slots - 1))


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


class RecordTable:
    """A small table as an array of slots by hash in the expression, searched inside a record."""

    def __init__(self, table: DataFrame):
        rows = table.where("source IS NOT NULL").select("source", "target", F.hash("source").alias("hash")).collect()
        slots = [[] for _ in range(1 << (2 * len(rows)).bit_length())]
        for r in rows:
            slots[r.hash & len(slots) - 1].append({"s": r.source, "t": r.target})
        self.n, self.slots = len(slots), _literal(slots, f"array<array<struct<s: string, t: {dict(table.dtypes)['target']}>>>")

    def find(self, word: Column) -> Column:
        """A list with the target of a word; empty if there is none. `word` is evaluated more than once."""
        return F.transform(F.filter(F.get(self.slots, _slot(word, self.n)), lambda e: e["s"] == word), lambda e: e["t"])


def _mask(words: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for every source of `words`, and for few others; always, if they are many."""
    hashes = [r[0] for r in words.limit(MASK_WORDS + 1).select(F.hash("source")).collect()]
    if len(hashes) > MASK_WORDS:
        return lambda w: F.lit(True)
    size = 1 << max(5, (16 * len(hashes)).bit_length())
    mask = [0] * (size >> 5)
    for h in hashes:
        mask[(h & size - 1) >> 5] |= 1 << (h & 31)
    bits = _literal([m - (m >> 31 << 32) for m in mask], "array<int>")
    return lambda w: F.getbit(F.get(bits, F.shiftright(_slot(w, size), 5)), _slot(w, 32)) == 1


def fits_record(table: DataFrame, most: int = RECORD_ROWS) -> bool:
    return is_small(table, min(most, RECORD_ROWS), RECORD_BYTES)


def look_up(words: DataFrame, table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `words` with the `target` of their `source`, null if there is none.

    `table` has a row per source. One that is small, of `most` rows at the most, is broadcast. Of a larger one only the sources
    that occur are kept, with how often they do; the counts are made where the words are. These
    are broadcast if they are few. Else the hot ones, whose number is bounded, are broadcast,
    and the other words are shuffled: none of them is more than a small part of all.
    """
    if is_small(table, most):
        return words.join(F.broadcast(table), "source", "left")
    counts = words.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    found = materialise(counts.join(table, "source"), "looked-up")
    if is_small(found, most):
        return words.join(F.broadcast(found.drop("n")), "source", "left")
    return split_join(words, found)


def split_join(words: DataFrame, found: DataFrame) -> DataFrame:
    """`words` left joined with `found` (source, target, n): hot sources by broadcast, the rest by shuffle."""
    hot, cold = by_heat(found)
    near = words.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "source", "left")
    done = near.where("hot").drop("hot")
    rest = near.where("hot IS NULL").drop("hot", "target")
    return done.unionByName(rest.join(cold, "source", "left"))


def record_lookup(
    df: DataFrame, sources: Column, table: DataFrame, key: str, most: int = BROADCAST_ROWS
) -> tuple[DataFrame, Callable[[Column], Column]]:
    """`df` and a function that lists the target of one of the record's `sources`; empty if there is none.

    `table` has a row per source. Of a large one only the sources that occur are kept, with the number
    of records that have them. If these are few (`most` at the most), they travel inside the
    expression. Else the hot ones do, whose number is bounded, and the others meet the records' other
    sources in a shuffle, once per record, where none of them is more than a small part of all; the
    targets found come back to their record, as the column `_cold`, by the unique `key`. The list of
    words itself is not moved.
    """
    if fits_record(table, most):
        return df, RecordTable(table).find
    counts = df.select(F.explode(F.array_distinct(sources)).alias("source")).where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    found = materialise(counts.join(table, "source"), "looked-up")
    if fits_record(found.drop("n"), most):
        return df, RecordTable(found).find
    hot, cold = by_heat(found)
    near, maybe = RecordTable(hot), _mask(cold)
    wanted = F.filter(F.array_distinct(sources), lambda w: w.isNotNull() & maybe(w) & (F.size(near.find(w)) == 0))
    entries = df.select(F.col(key).alias("_key"), F.explode(wanted).alias("source")).join(cold, "source")
    listed = entries.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("_e"))
    steps = F.filter(F.array(*[F.lit(1 << i) for i in reversed(range(31))]), lambda s: s <= F.size("_e"))
    listed = listed.select("_key", F.struct(F.col("_e.source").alias("s"), F.col("_e.target").alias("t"), steps.alias("steps")).alias("_cold"))
    # Each field once per record, not once per word: the join keeps them from being worked out in lambdas.
    df = df.join(listed, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")

    def find(word):
        own = F.col("_cold")
        below = lambda at, step: F.when(F.get(own["s"], at + step - 1) < word, at + step).otherwise(at)
        place = F.filter(F.array(F.aggregate(own["steps"], F.lit(0), below)), lambda at: F.get(own["s"], at) == word)
        far = F.concat(near.find(word), F.transform(place, lambda at: F.get(own["t"], at)))
        return F.when(own.isNull() | ~maybe(word), near.find(word)).otherwise(far)

    return df, find


def by_heat(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hot and the other rows of `found` (source, target, n), without n."""
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_PARTS > total
    return found.where(hot).select("source", "target"), found.where(~hot).select("source", "target")
