"""Removal of byte runs that stand elsewhere too, by prefix-free parsing.

1. Every window of bytes is named by its leftmost n-gram of the smallest rolling hash. Windows in
   a row with one such place are a segment. Equal windows have equal names, so they lie in
   segments of one name; names with a single segment go no further.
2. Equal segments are one content that counts how often it stands. The contents of one name go
   to one shard: there triggers of a rolling hash cut them into phrases, the suffix arrays of the
   dictionary of phrases and of the parse give all suffixes in corpus order, and neighbours
   that share a window's length are added up. Windows that stand more than once are removed.
3. A name with more contents than a shard takes is resolved by window hashes, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sarani.llm.common import as_bytes, broadcast_if, chunks, keyed_texts
from sarani.llm.prefix_free import TRIGGER, repeated_windows
from sarani.llm.rolling import Ranges, mix
from sarani.llm.substring_dedup import merged
from sarani.session import materialise

SHARD_BYTES = 400_000  # a shard is closed once it has so many bytes
MOST_CONTENTS = 5_000  # contents of one name that a shard takes
CHUNK = 1 << 20
_PLACE_BITS = 28


def leftmost_least(keys: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` places the least key in it; the keys hold their place in the low bits."""
    reach = 1
    while reach * 2 <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    return np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :]) if reach < width else keys


def segments_of(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Text, first byte in the text, number of bytes, name and two content hashes of each segment."""
    gram = window // 6
    data = np.frombuffer(b"".join(texts), np.uint8)
    finish = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    if len(data) < window:
        return none
    one, two = Ranges(data, 0), Ranges(data, 1)
    at = np.arange(len(data) - gram + 1)
    names = one.hash(at, at + gram)
    bits = np.uint64(_PLACE_BITS)
    place = leftmost_least((mix(names) >> bits << bits) | at.astype(np.uint64), window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    text = np.searchsorted(finish, at[: len(place)], side="right")
    starts = np.flatnonzero(at[: len(place)] + window <= finish[text])
    if not len(starts):
        return none
    place, text = place[starts].astype(np.int64), text[starts]
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(starts) != 1) | (np.diff(text) != 0)]))
    last = np.append(opens[1:], len(starts)) - 1
    low, high, text = starts[opens], starts[last] + window, text[opens]
    begin = np.concatenate([[0], finish[:-1]])[text]
    return text, low - begin, high - low, names[place[opens]], one.hash(low, high), two.hash(low, high)


def _segments(texts: DataFrame, window: int) -> DataFrame:
    """row, start, n, name, k1, k2 of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            text, start, n, *keys = segments_of(as_bytes(chunk.column("text")), window)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("row").take(pa.array(text)), pa.array(start), pa.array(n.astype(np.int32)), *[pa.array(k.view(np.int64)) for k in keys]],
                ["row", "start", "n", "name", "k1", "k2"],
            )

    return texts.select("row", "text").mapInArrow(run, "row long, start long, n int, name long, k1 long, k2 long")


def _with_bytes(texts: DataFrame, contents: DataFrame) -> DataFrame:
    """name, k1, k2, times, contents and the bytes of each content, cut from its first place."""
    names = ["name", "k1", "k2", "times", "contents", "start", "n"]
    listed = materialise(contents.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("wanted")), "suffix-wanted")
    joined = texts.select("row", "text").join(broadcast_if(listed, 72, "wanted"), "row")
    out = names[:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            rows = {c: [] for c in [*out, "bytes"]}
            size = 0
            for body, held in zip(as_bytes(chunk.column("text")), chunk.column("wanted").to_pylist()):
                for w in held:
                    for c in out:
                        rows[c].append(w[c])
                    rows["bytes"].append(body[w["start"] : w["start"] + w["n"]])
                    size += w["n"]
                    if size >= 4 * CHUNK:
                        yield _bytes_batch(rows)
                        rows, size = {c: [] for c in rows}, 0
            yield _bytes_batch(rows)

    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in out) + ", bytes binary")


def _bytes_batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "bytes" else pa.int64()) for c, v in rows.items()], list(rows))


def _runs(text: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, low and high of the runs that windows in a row cover."""
    order = np.lexsort((first, text))
    text, first = text[order], first[order]
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(first) > window)])[: len(text)])
    last = (np.append(opens[1:], len(text)) - 1)[: len(opens)]
    return text[opens], first[opens], first[last] + window


def _in_shards(contents: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """k1, k2, low, high: runs of a content whose windows stand more than once."""

    def search(keys: list[tuple[int, int]], times: list[int], texts: list[bytes]) -> pa.RecordBatch:
        text, low, high = _runs(*repeated_windows(texts, window, times), window)
        k = np.array(keys, np.int64).reshape(-1, 2)[text]
        return pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["k1", "k2", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, texts, size, group = [], [], [], 0, None
        for batch in batches:
            for name, k1, k2, n, data in zip(*(batch.column(c).to_pylist() for c in ("name", "k1", "k2", "times", "bytes"))):
                if name != group and size >= shard_bytes:
                    yield search(keys, times, texts)
                    keys, times, texts, size = [], [], [], 0
                group = name
                keys.append((k1, k2))
                times.append(n)
                texts.append(data)
                size += len(data)
        if texts:
            yield search(keys, times, texts)

    ordered = contents.repartition("name").sortWithinPartitions("name")
    return ordered.select("name", "k1", "k2", "times", "bytes").mapInArrow(run, "k1 long, k2 long, low int, high int")


def _by_windows(contents: DataFrame, window: int) -> DataFrame:
    """k1, k2, low, high as `_in_shards` gives them, a run per window, from the hashes of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, times, data in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "times", "bytes"))):
                values = np.frombuffer(data, np.uint8)
                first = np.arange(len(values) - window + 1)
                yield pa.RecordBatch.from_pydict({
                    "k1": np.full(len(first), k1), "k2": np.full(len(first), k2), "times": np.full(len(first), times), "low": first.astype(np.int32),
                    "w1": Ranges(values, 0).hash(first, first + window).view(np.int64), "w2": Ranges(values, 1).hash(first, first + window).view(np.int64),
                })

    windows = materialise(contents.mapInArrow(run, "k1 long, k2 long, times long, low int, w1 long, w2 long"), "suffix-windows")
    several = windows.groupBy("w1", "w2").agg(F.sum("times").alias("all")).where("all > 1").select("w1", "w2")
    return windows.join(several, ["w1", "w2"], "left_semi").select("k1", "k2", "low", (F.col("low") + window).alias("high"))


def repeated_spans(texts: DataFrame, window: int, shard_bytes: int, most_contents: int) -> DataFrame:
    """row, low, high: byte runs whose every window stands elsewhere too."""
    segments = materialise(_segments(texts, window), "suffix-segments")
    several = materialise(segments.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("name"), "suffix-several")
    segments = segments.join(broadcast_if(several, 32), "name", "left_semi")
    contents = segments.groupBy("name", "k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "start", "n")).alias("own"))
    contents = materialise(contents.select("name", "k1", "k2", "times", "own.*"), "suffix-contents")
    sizes = contents.groupBy("name").agg(F.count(F.lit(1)).alias("contents"))
    worded = materialise(_with_bytes(texts, contents.join(sizes, "name")), "suffix-bytes")
    found = _in_shards(worded.where(F.col("contents") <= most_contents), window, shard_bytes).unionByName(
        _by_windows(worded.where(F.col("contents") > most_contents), window)
    )
    runs = materialise(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "suffix-runs")
    cut = segments.join(broadcast_if(runs, 32, "runs"), ["k1", "k2"]).select("row", "start", F.inline("runs"))
    return cut.select("row", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


def _by_row(spans: DataFrame) -> DataFrame:
    """row and its spans in order, overlapping and touching ones as one."""

    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gone in batch.column("gone"):
                low, high = (gone.values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                opens = np.concatenate([[True], low[1:] > high[:-1]])
                last = np.concatenate([opens[1:], [True]])
                out.append([{"low": a, "high": b} for a, b in zip(low[opens].tolist(), high[last].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], ["row", "gone"])

    listed = spans.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("gone"))
    return listed.mapInArrow(run, "row long, gone array<struct<low:long,high:long>>")


def remove_repeated_bytes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 400,
    shard_bytes: int = SHARD_BYTES, most_contents: int = MOST_CONTENTS, with_text: bool = True,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, as asked for, kept and spans.

    A byte of a text in UTF-8 goes if a string of `window` bytes covers it that starts at
    another place too, in the same or another document; all strings are judged on the input.
    kept holds the other bytes (binary: a cut may fall into a character), spans the removed
    ranges. Null and empty texts have no bytes. Every row is a text of its own, whatever its id: rows
    that repeat are copies of each other, and null or repeated ids are compared like others.
    Other columns are not read. An empty table gives no rows.
    """
    if window < 5 * TRIGGER:
        raise ValueError(f"a window has at least {5 * TRIGGER} bytes")
    # Written with a number per row, which every later reading then finds unchanged.
    texts = materialise(keyed_texts(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "suffix-texts")
    spans = repeated_spans(texts, window, shard_bytes, most_contents)
    listed = materialise(_by_row(spans), "suffix-gone")
    joined = texts.join(broadcast_if(listed, 24, "gone"), "row", "left").select("doc_id", "text", "gone")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<low:long,high:long>>" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for body, gone in zip(as_bytes(chunk.column("text")), chunk.column("gone").to_pylist()):
                ranges = merged((g["low"], g["high"]) for g in gone or ())
                edges = [0, *[x for r in ranges for x in r], len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for c, v in zip(out, (len(body), len(body) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept, [{"low": a, "high": b} for a, b in ranges])):
                    out[c].append(v)
            if with_text:
                out["kept"] = pa.array(out["kept"], pa.binary())
                out["spans"] = pa.array(out["spans"], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
            else:
                del out["kept"], out["spans"]
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), **out})

    return joined.mapInArrow(run, schema)
