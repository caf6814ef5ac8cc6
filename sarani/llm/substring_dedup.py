"""Removal of word runs that an earlier document has, with FM-indexes per shard.

1. Every window of words has a minimizer, its word n-gram of the smallest hash. Windows in a
   row with one minimizer are a segment; equal windows always lie in segments of one
   minimizer. Only minimizers of at least two documents go on.
2. Equal segments are one content, owned by the smallest document that has it.
3. The contents of one minimizer are put into a shard. The shard is indexed, and its documents
   stream through it: backward search gives the matching statistics against smaller
   documents, and intervals of at least a window are reported. A content that later documents
   have too streams through once more on their behalf; then its owner is a smaller document.
4. A minimizer with more contents than a shard takes is resolved exactly by window hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sarani.llm.common import as_bytes, broadcast_if, chunks, keyed_texts
from sarani.llm.fm_index import Shard
from sarani.llm.rolling import Ranges, Words, cut_words, mix
from sarani.session import materialise

GRAM = 8
SHARD_WORDS = 300_000  # a shard is closed once it has so many words
MOST_CONTENTS = 10_000  # contents of one minimizer that a shard takes
CHUNK = 2 << 20
_PLACE_BITS = 28


def segments_of(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first word in the text, number of words, place of the minimizer in it, minimizer."""
    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = Ranges(hashes).hash(np.arange(n - gram + 1), np.arange(gram, n + 1))
    # High bits order the n-grams, low bits hold the place: the leftmost of equal ones wins.
    key = (mix(grams) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width, reach = window - gram + 1, 1
    while reach * 2 <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    place = (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    text = words.texts()
    starts = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    place = place[starts]
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(starts) != 1)]))
    last = np.concatenate([opens[1:], [len(starts)]]) - 1
    first, spot = starts[opens], place[opens]
    owner = text[first]
    return owner, first - words.first[owner], starts[last] + window - first, spot - first, grams[spot]


def _segments(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, start, n, anchor, minimizer, k1, k2 (content hash) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            words = cut_words(as_bytes(chunk.column("text")))
            hashes = words.hashes()
            text, start, n, anchor, minimizer = segments_of(words, hashes, window, gram)
            at = words.first[text] + start
            k1, k2 = Ranges(hashes, 0).hash(at, at + n), Ranges(hashes, 1).hash(at, at + n)
            yield pa.RecordBatch.from_arrays([
                chunk.column("doc_id").take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                pa.array(anchor.astype(np.int32)), pa.array(minimizer.view(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
            ], ["doc_id", "start", "n", "anchor", "minimizer", "k1", "k2"])

    return texts.mapInArrow(run, "doc_id long, start int, n int, anchor int, minimizer long, k1 long, k2 long")


def _with_words(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted segments (doc_id, start, n and others) with their word hashes."""
    names = [c for c in wanted.columns if c != "doc_id"]
    listed = materialise(wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("wanted")), "sub-wanted")
    joined = texts.join(broadcast_if(listed, 64, "wanted"), "doc_id")
    kinds = dict(wanted.dtypes)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            words = cut_words(as_bytes(chunk.column("text")))
            hashes = words.hashes().view(np.int64)
            rows = {"doc_id": [], **{c: [] for c in names}, "words": []}
            for i, (doc, held) in enumerate(zip(chunk.column("doc_id").to_pylist(), chunk.column("wanted").to_pylist())):
                for w in held:
                    rows["doc_id"].append(doc)
                    for c in names:
                        rows[c].append(w[c])
                    at = words.first[i] + w["start"]
                    rows["words"].append(hashes[at : at + w["n"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.list_(pa.int64()) if c == "words" else arrow[kinds[c]]) for c, v in rows.items()], list(rows)
            )

    return joined.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {kinds[c]}" for c in names) + ", words array<long>")


def _search(contents: DataFrame, window: int, gram: int, shard_words: int) -> DataFrame:
    """k1, k2, later, low, high: runs of a content that smaller documents than its owner have,
    or than its later documents, by shards."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, anchors, owners, copied, sequences = zip(*rows)
        shard = Shard(list(sequences), np.array(owners))
        which, later, low, high = shard.matches_of_smaller(np.array(anchors, np.int64), gram, window, np.flatnonzero(copied))
        return pa.RecordBatch.from_pydict({
            "k1": np.array(k1, np.int64)[which], "k2": np.array(k2, np.int64)[which], "later": later, "low": low.astype(np.int32), "high": high.astype(np.int32),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, group = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("minimizer", "k1", "k2", "anchor", "doc_id", "copied")]
            for minimizer, *rest, words in zip(*columns, batch.column("words")):
                if minimizer != group and size >= shard_words:
                    yield search(rows)
                    rows, size = [], 0
                group = minimizer
                rows.append((*rest, words.values.to_numpy()))
                size += len(rows[-1][-1])
        if rows:
            yield search(rows)

    ordered = contents.repartition("minimizer").sortWithinPartitions("minimizer")
    columns = ordered.select("minimizer", "k1", "k2", "anchor", "doc_id", "copied", "words")
    return columns.mapInArrow(run, "k1 long, k2 long, later boolean, low int, high int")


def _by_windows(contents: DataFrame, window: int) -> DataFrame:
    """k1, k2, later, low, high as `_search` gives them, from the hashes of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, doc, words in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "doc_id")), batch.column("words")):
                hashes = words.values.to_numpy().view(np.uint64)
                low = np.arange(len(hashes) - window + 1)
                n = len(low)
                yield pa.RecordBatch.from_pydict({
                    "k1": np.full(n, k1), "k2": np.full(n, k2), "doc_id": np.full(n, doc), "low": low.astype(np.int32),
                    "w1": Ranges(hashes, 0).hash(low, low + window).view(np.int64), "w2": Ranges(hashes, 1).hash(low, low + window).view(np.int64),
                })

    windows = materialise(contents.mapInArrow(run, "k1 long, k2 long, doc_id long, low int, w1 long, w2 long"), "sub-windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"))
    own = windows.join(least, ["w1", "w2"]).where("owner < doc_id").select("k1", "k2", F.lit(False).alias("later"), "low", (F.col("low") + window).alias("high"))
    later = contents.where("copied").select("k1", "k2", F.lit(True).alias("later"), F.lit(0).alias("low"), F.size("words").alias("high"))
    return own.unionByName(later)


def repeated_runs(texts: DataFrame, window: int, gram: int, shard_words: int, most_contents: int) -> DataFrame:
    """doc_id, low, high: word runs whose every window starts in a smaller document too."""
    segments = _segments(texts, window, gram)
    several = segments.groupBy("minimizer").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("minimizer")
    several = materialise(several, "sub-several")
    some = broadcast_if(several, 32)
    segments = materialise(segments.join(some, "minimizer", "left_semi"), "sub-segments")
    contents = segments.groupBy("minimizer", "k1", "k2").agg(
        F.min(F.struct("doc_id", "start", "n", "anchor")).alias("own"), (F.max("doc_id") > F.min("doc_id")).alias("copied")
    )
    contents = materialise(contents.select("minimizer", "k1", "k2", "copied", "own.*"), "sub-contents")
    sizes = contents.groupBy("minimizer").agg(F.count(F.lit(1)).alias("contents"))
    worded = materialise(_with_words(texts, contents.join(sizes, "minimizer").where("contents > 1 OR copied")), "sub-words")
    found = _search(worded.where(F.col("contents") <= most_contents), window, gram, shard_words).unionByName(
        _by_windows(worded.where(F.col("contents") > most_contents), window)
    )
    runs = materialise(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("later", "low", "high")).alias("runs")), "sub-runs")
    owners = contents.select("minimizer", "k1", "k2", F.col("doc_id").alias("owner"))
    owned = segments.join(owners, ["minimizer", "k1", "k2"]).join(broadcast_if(runs, 40, "runs"), ["k1", "k2"])
    own_runs = F.filter("runs", lambda r: r["later"] == (F.col("doc_id") > F.col("owner")))
    cut = owned.select("doc_id", "start", F.inline(own_runs))
    return cut.select("doc_id", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


def remove_repeated_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM,
    shard_words: int = SHARD_WORDS, most_contents: int = MOST_CONTENTS, with_text: bool = True,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, as asked for, kept_text and spans.

    Words are runs of other characters than blanks and controls from tab to carriage return.
    A word goes if a window of `window` words covers it whose words also stand in a row in a
    document with a smaller id; all windows are judged on the input. kept_text joins the
    other words by one blank; spans are the removed word ranges. Null and empty texts have no
    words. Rows with a null id are compared with nothing and stay whole. Repeated ids must
    repeat the text and count as one document. Other columns are not read.
    """
    texts = keyed_texts(docs, key, text)
    runs = repeated_runs(texts.where("doc_id IS NOT NULL"), window, gram, shard_words, most_contents)
    listed = materialise(runs.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("gone")), "sub-gone")
    joined = texts.join(broadcast_if(listed, 24, "gone"), "doc_id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<struct<low:int,high:int>>" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            out = {"doc_id": chunk.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": [], "spans": []}
            for body, gone in zip(as_bytes(chunk.column("text")), chunk.column("gone").to_pylist()):
                words = body.split()
                out["n_words"].append(len(words))
                spans = merged((g["low"], g["high"]) for g in gone or ())
                for low, high in reversed(spans):
                    del words[low:high]
                kept = b" ".join(words)
                out["n_removed"].append(sum(high - low for low, high in spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept_text"].append(kept.decode())
                    out["spans"].append([{"low": low, "high": high} for low, high in spans])
            if not with_text:
                del out["kept_text"], out["spans"]
            else:
                out["spans"] = pa.array(out["spans"], pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))
            yield pa.RecordBatch.from_pydict(out)

    return joined.mapInArrow(run, schema)


def merged(ranges) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out
