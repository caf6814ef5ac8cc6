"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

1. Seeds of a test item are its word n-grams, contiguous and with a gap in the middle (an edited
   word), that few items share. Rarity is judged among the items: a frequency in the documents
   would count the copies that are looked for. An item without a rare n-gram takes its rarest.
2. The seeds set bits in a filter of fixed size; one pass over the documents gives the places
   whose n-gram passes it, which then join the seeds.
3. Seeds of one item on near diagonals of a document form a passage if they cover a third of
   what the item's seeds can cover: an alignment that reaches the threshold matches half of the
   item at least, while a phrase that happens to stand in both covers little.
4. Each passage is aligned with its item; the local alignment score, as a share of the
   score of an exact copy, decides. Edits, insertions and lost words cost a little each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sarani.llm.common import as_bytes, broadcast_if, chunks, keyed_texts
from sarani.llm.rolling import Words, cut_words, mix, shingles
from sarani.session import materialise

GRAM = 3
GAPPED = (0, 1, 3, 4)  # words of a seed that leaves one out
RARE_ITEMS = 8  # most items that share a rare n-gram
COVER = 3  # one of so many coverable words is covered in a passage
FILTER_BITS = 1 << 23
MATCH, MISMATCH, GAP = 2, -1, -1
CHUNK = 1 << 19
# Words are runs of letters, digits and bytes above ASCII, A-Z in lower case.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())


def words_of(texts: list[bytes]) -> Words:
    return cut_words([t.lower() for t in texts], SEPARATORS)


def grams_of(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in the text of every run of exactly `size` words."""
    found, text = shingles(hashes, first, size)
    long_enough = np.diff(first)[text] >= size
    found, text = found[long_enough], text[long_enough]
    runs = np.bincount(text, minlength=len(first) - 1)
    return found, text, np.arange(len(text)) - (np.cumsum(runs) - runs)[text]


def gapped_grams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of every run of five words, without regard to the middle one."""
    size = GAPPED[-1] + 1
    runs = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(text)) - (np.cumsum(runs) - runs)[text]
    start = first[:-1][text] + at
    h = np.full(len(text), 0xD1B54A32D192ED03, np.uint64)
    for i in GAPPED:
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) + hashes[start + i]) if len(text) else h
    return h, text, at


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where it ends in the passage."""
    at = np.arange(len(passage) + 1, dtype=np.int32)
    row = np.zeros(len(passage) + 1, np.int32)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - GAP * at) + GAP * at  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _item_words(items: DataFrame, gram: int) -> DataFrame:
    """item_id, words (hashes), size: its n-gram length; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            words = words_of(as_bytes(chunk.column("text")))
            hashes = words.hashes().view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), lists], ["item_id", "words"])

    cut = items.mapInArrow(run, "item_id long, words array<long>").where("size(words) > 0 AND item_id IS NOT NULL")
    return cut.withColumn("size", F.least(F.size("words"), F.lit(gram)))


def _item_grams(items: DataFrame) -> DataFrame:
    """item_id, item_words, gram, at, covers (the places of its words): every n-gram of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words, size in zip(*(batch.column(c).to_pylist() for c in ("item_id", "words", "size"))):
                hashes, first = np.array(words, np.int64).view(np.uint64), np.array([0, len(words)])
                plain, gapped = grams_of(hashes, first, size), gapped_grams(hashes, first)
                found = np.concatenate([plain[0], gapped[0]])
                at = np.concatenate([plain[2], gapped[2]]).astype(np.int64)
                covers = [list(range(a, a + size)) for a in plain[2].tolist()] + [[a + i for i in GAPPED] for a in gapped[2].tolist()]
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([item] * len(found), pa.int64()), "item_words": pa.array([len(words)] * len(found), pa.int64()),
                    "gram": found.view(np.int64), "at": at, "covers": pa.array(covers, pa.list_(pa.int32())),
                })

    return items.mapInArrow(run, "item_id long, item_words long, gram long, at long, covers array<int>")


def _seeds(items: DataFrame) -> DataFrame:
    """The rare ones of `_item_grams`, with `coverable`: how many words of the item its seeds cover."""
    grams = materialise(_item_grams(items), "leak-grams")
    shared = grams.groupBy("gram").agg(F.countDistinct("item_id").alias("items"))
    shared = materialise(grams.join(shared, "gram"), "leak-shared")
    most = shared.groupBy("item_id").agg(F.greatest(F.min("items"), F.lit(RARE_ITEMS)).alias("most"))
    rare = shared.join(most, "item_id").where("items <= most").drop("items", "most")
    coverable = rare.groupBy("item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("coverable"))
    return rare.join(coverable, "item_id")


def _places(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, gram, place of document n-grams that pass the filter of the items' n-grams."""
    slots = grams.select(F.pmod("gram", F.lit(FILTER_BITS)).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(FILTER_BITS, bool)
    bits[slots] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for chunk in chunks(batches, "text", CHUNK):
            words = words_of(as_bytes(chunk.column("text")))
            hashes, ids = words.hashes(), chunk.column("doc_id")
            for found, text, at in [*(grams_of(hashes, words.first, size) for size in sizes), gapped_grams(hashes, words.first)]:
                hit = known[found.view(np.int64) % FILTER_BITS]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text[hit])), pa.array(found[hit].view(np.int64)), pa.array(at[hit].astype(np.int64))], ["doc_id", "gram", "place"]
                )

    return docs.mapInArrow(run, "doc_id long, gram long, place long")


def _passages(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """item_id, doc_id, low and the words of every passage."""
    listed = windows.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "low", "high")).alias("windows"))
    listed = materialise(listed, "leak-windows")
    joined = docs.join(broadcast_if(listed, 48, "windows"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            words = words_of(as_bytes(chunk.column("text")))
            hashes = words.hashes().view(np.int64)
            rows = {"item_id": [], "doc_id": [], "low": [], "passage": []}
            for i, (doc, held) in enumerate(zip(chunk.column("doc_id").to_pylist(), chunk.column("windows").to_pylist())):
                own = hashes[words.first[i] : words.first[i + 1]]
                for w in held:
                    low = max(w["low"], 0)
                    for name, value in zip(rows, (w["item_id"], doc, low, own[low : max(w["high"], 0)])):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[n], pa.list_(pa.int64()) if n == "passage" else pa.int64()) for n in rows], list(rows)
            )

    return joined.mapInArrow(run, "item_id long, doc_id long, low long, passage array<long>")


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", gram: int = GRAM, least: float = 0.5,
) -> DataFrame:
    """doc_id, item_id, score, end_word, seeds: the documents that hold a copy of a test item.

    One row per document and item, with the best passage: score is its alignment score over
    that of an exact copy (at least `least`, 1 for an exact copy), end_word the word after its
    end, seeds how many places of the document hold a seed of the item. Items with fewer than
    `gram` words use all their words as the seed. Copies with every third word or fewer replaced,
    or every fourth or fewer lost or added to, keep seeds enough; a copy whose edits leave no three
    words together, nor two pairs around a replaced one, is not found. Texts that are null, empty or without words match nothing; rows with
    a null id give no row; repeated rows give the rows of one; equal scores keep the earliest
    passage. Repeated ids must repeat the text. Other columns are not read.
    """
    texts = keyed_texts(docs, key, text).where("doc_id IS NOT NULL")
    cut = materialise(_item_words(keyed_texts(items, item_key, item_text), gram).dropDuplicates(["item_id"]), "leak-items")
    grams = materialise(_seeds(cut), "leak-seeds")
    sizes = sorted(r[0] for r in cut.select("size").distinct().collect())
    places = materialise(_places(texts, grams, sizes), "leak-places")
    found = places.join(broadcast_if(grams, 96), "gram")
    diagonal = F.col("place") - F.col("at")
    # Diagonals are dealt into overlapping parts of the item's length, so that a copy whose
    # diagonals spread over half of it lies in one part.
    part = F.floor(2 * diagonal / F.col("item_words"))
    dealt = found.withColumn("diagonal", diagonal).withColumn("part", F.explode(F.array(part, part + 1)))
    grouped = dealt.groupBy("doc_id", "item_id", "part", "item_words", "coverable").agg(
        F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.flatten(F.collect_set("covers")).alias("covers"),
    )
    half = F.ceil(F.col("item_words") / 2)
    covered = F.size(F.array_distinct("covers"))
    windows = materialise(grouped.where(COVER * covered >= F.col("coverable")).select(
        "doc_id", "item_id", (F.col("first") - half).alias("low"), (F.col("last") + F.col("item_words") + half).alias("high"),
    ).distinct(), "leak-windows")
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ends, scores = [], [], []
            for i, (words, passage, low) in enumerate(zip(batch.column("words"), batch.column("passage"), batch.column("low").to_pylist())):
                item, own = words.values.to_numpy(), passage.values.to_numpy()
                # Only an item word that the passage has can match, so the score is at most their share.
                if np.count_nonzero(np.isin(item, own)) / len(item) < least:
                    continue
                best, end = align(item, own)
                places.append(i)
                scores.append(best / (MATCH * len(item)))
                ends.append(low + end)
            rows = {c: batch.column(c).take(pa.array(places, pa.int64())) for c in ("doc_id", "item_id")}
            yield pa.RecordBatch.from_pydict(rows | {"score": pa.array(scores, pa.float64()), "end_word": pa.array(ends, pa.int64())})

    # Written in between, so that no task holds two Python workers.
    passages = materialise(_passages(texts, windows), "leak-passages").join(broadcast_if(cut, 16, "words"), "item_id")
    scored = passages.select("doc_id", "item_id", "words", "passage", "low").mapInArrow(score, "doc_id long, item_id long, score double, end_word long")
    best = materialise(scored.where(F.col("score") >= least).groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.min_by("end_word", F.struct(-F.col("score"), F.col("end_word"))).alias("end_word")
    ), "leak-best")
    pair = ["doc_id", "item_id"]
    return best.join(found.join(broadcast_if(best.select(*pair), 24), pair, "left_semi").groupBy(*pair).agg(F.countDistinct("place").alias("seeds")), pair)
