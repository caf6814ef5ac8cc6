"""Near-duplicate components with banded MinHash and odd sketches.

1. Each document's set of word shingles gives MinHash samples; groups of rows form band
   keys, and all samples are folded into a parity bitmap, the odd sketch.
2. Documents with equal sets are one class, so copies cost nothing further on.
3. In each band bucket every class is paired with the bucket's centre, not with all others.
   Pairs whose sketches differ in few bits are confirmed on the full sets.
4. Confirmed links form components. In buckets that hold several components after that,
   members that share too few shingles with all others are dropped; the rest gets another
   round with the member that shares most as the centre.
5. What is left is joined by rare shingles: two sets that reach the threshold share one of
   their rarest shingles, as many as the threshold lets differ and one more. Pairs across
   components that pass the sizes and the sketches are confirmed on the full sets.

So a group of copies of any size costs one pair per member and band, buckets carry ids and
sketches only, and no link between components is left untested if its classes share a band.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sarani.llm.common import as_bytes, broadcast_if, chunks, keyed_texts
from sarani.llm.components import components
from sarani.llm.rolling import cut_words, mix, shingles
from sarani.session import materialise

SKETCH_WORDS = 8  # of 64 bits
WIDE_SAMPLES, WIDE_WORDS = 1000, 64  # of the sketches that decide which sets are fetched
PREFIX = 64  # shingles of a prefix that rows carry whole
CHUNK = 1 << 19


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seeds[:n] | np.uint64(1), seeds[n:]


def bands_and_rows(percent: int, miss: float = 1e-6, rows: int = 5) -> tuple[int, int]:
    """Bands of `rows` samples so that a pair at the threshold shares none with chance `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)), rows


def most_bits(percent: int, samples: int, words: int = SKETCH_WORDS) -> int:
    """The largest XOR count of two sketches for which a link is still possible.

    Six standard deviations below the threshold, with two deviations of the bit count.
    """
    j = percent / 100
    low = max(0.0, j - 6 * math.sqrt(j * (1 - j) / samples))
    bits = 64 * words
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - low)))
    return math.ceil(expected + 2 * math.sqrt(expected))


def document_shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case."""
    words = cut_words([t.lower() for t in texts])
    found, text = shingles(words.hashes(), words.first, size)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    return [np.unique(found[a:b]) for a, b in zip(bounds, bounds[1:])]


def minima(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """MinHash samples of sets that aren't empty, a row per set."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    found = np.empty((len(sets), samples), np.uint64)
    for i, (a, b) in enumerate(zip(*_permutations(samples))):
        found[:, i] = np.minimum.reduceat(flat * a + b, starts)
    return found


def odd_sketches(samples: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps of rows of samples: the XOR of two has few bits where the samples agree."""
    n = samples.shape[1]
    bit = mix(samples + np.arange(n, dtype=np.uint64)) % np.uint64(64 * words)
    sketch = np.zeros((len(samples), words), np.uint64)
    row = np.arange(len(samples))
    for i in range(n):
        sketch[row, bit[:, i] >> np.uint64(6)] ^= np.uint64(1) << (bit[:, i] & np.uint64(63))
    return sketch


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of sets that aren't empty."""
    samples = minima(sets, bands * rows)
    keys = np.full((len(sets), bands), 0, np.uint64)
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9DDFEA08EB382D69) + samples[:, i::rows])
    return mix(keys + np.arange(bands, dtype=np.uint64)), odd_sketches(samples, SKETCH_WORDS)


def _signed(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), set_hash, keys, sketch; the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            sets = document_shingles(as_bytes(chunk.column("text")), size)
            full = [s for s in sets if len(s)]
            keys, sketch = signatures(full, bands, rows) if full else (np.zeros((0, bands), np.uint64), np.zeros((0, SKETCH_WORDS), np.uint64))
            place = iter(range(len(full)))
            where = [next(place) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "set_hash": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "keys": pa.array([None if i is None else keys[i].view(np.int64) for i in where], pa.list_(pa.int64())),
                "sketch": pa.array([None if i is None else sketch[i].view(np.int64) for i in where], pa.list_(pa.int64())),
            })

    return texts.mapInArrow(run, "doc_id long, n long, set_hash binary, keys array<long>, sketch array<long>")


def _sets(texts: DataFrame, size: int, wide: bool = False) -> DataFrame:
    """doc_id, set and, as asked for, its wide odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            sets = document_shingles(as_bytes(chunk.column("text")), size)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            out = [chunk.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if wide:
                full = [s for s in sets if len(s)]
                found = iter(odd_sketches(minima(full, WIDE_SAMPLES), WIDE_WORDS).view(np.int64) if full else ())
                out.append(pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "set", "sketch"][: len(out)])

    return texts.mapInArrow(run, "doc_id long, set array<long>" + ", sketch array<long>" * wide)


def _sets_of(ids: DataFrame, texts: DataFrame, size: int, wide: bool = False) -> DataFrame:
    """doc_id and set of the documents with the ids; rows that repeat an id count once."""
    wanted = broadcast_if(materialise(ids.distinct(), "near-wanted"), 24)
    return _sets(texts.join(wanted, "doc_id", "left_semi"), size, wide).dropDuplicates(["doc_id"])


def _bits_apart(a: str, b: str) -> Column:
    apart = [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_WORDS)]
    return sum(apart[1:], apart[0])


def _wide_bits_apart(a: str, b: str) -> Column:
    both = F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(both, F.lit(0), lambda n, x: n + x)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    joined = (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    )
    shared = F.size(F.array_intersect("set_a", "set_b")).alias("shared")
    sized = joined.select("a", "b", shared, (F.size("set_a") + F.size("set_b")).alias("both"))
    return sized.where(100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).select("a", "b")


def near_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-6,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked when their sets of `size`-word shingles (words between blanks, A-Z
    in lower case) reach the similarity `percent`; a component's id is its smallest doc_id,
    and that document is kept. A text with fewer words is one shingle; one without words, or
    a null text, has an empty set and is linked with nothing. Ids are expected to differ and
    not to be null: rows with a null id are components of their own with a null id, rows that
    repeat an id must repeat the text. Other columns are not read. A pair at the threshold
    is missed with chance `miss`; links found are exact.
    """
    bands, rows = bands_and_rows(percent, miss)
    far = most_bits(percent, bands * rows)
    texts = keyed_texts(docs, key, text)
    signed = materialise(_signed(texts, size, bands, rows), "near-signed")
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    classes = materialise(classes, "near-classes")
    reps = materialise(
        signed.dropDuplicates(["doc_id"]).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "keys", "sketch"), "near-reps"
    )
    sketches = reps.select("doc_id", "sketch")
    filed = reps.select("doc_id", F.explode("keys").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    filed = materialise(filed.join(shared.select("bucket"), "bucket", "left_semi"), "near-filed")

    centres = filed.groupBy("bucket").agg(F.min("doc_id").alias("centre"))
    tested = _with_centres(filed, centres, sketches, far)
    met = _sets_of(tested.select(F.explode(F.array("a", "b")).alias("doc_id")), texts, size)
    edges = materialise(confirmed(tested, met, percent), "near-links")
    labels = materialise(_labels(reps, edges), "near-labels")
    open_rows = materialise(_open(filed, labels), "near-open")
    sets = materialise(_sets_of(open_rows.select("doc_id"), texts, size, wide=True), "near-sets")
    able = materialise(_able(open_rows, sets, percent), "near-able")
    # The member that shares most of its shingles links most of the edited copies around it.
    centres = able.groupBy("bucket").agg(F.min_by("doc_id", F.struct(F.col("n") - F.col("shared"), "doc_id")).alias("centre"))
    pairs = _with_centres(able, centres, sketches, far).join(tested, ["a", "b"], "left_anti")
    pairs = materialise(pairs, "near-pairs")
    edges = edges.unionByName(materialise(confirmed(pairs, sets, percent), "near-links"))
    labels = materialise(_labels(reps, edges), "near-labels")
    met = materialise(_across(able.drop("component").join(labels, "doc_id"), sets, percent), "near-met")
    rest = materialise(confirmed(met, sets, percent), "near-links")
    labels = _labels(reps, edges.unionByName(rest))
    found = classes.join(labels, F.col("rep") == F.col("doc_id")).select("set_hash", "component")
    component = F.coalesce("component", "doc_id")
    return signed.select("doc_id", "n", "set_hash").join(found, "set_hash", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _with_centres(rows: DataFrame, centres: DataFrame, sketches: DataFrame, far: int) -> DataFrame:
    """Pairs of each member of a bucket with its centre, close by sketch."""
    pairs = rows.select("doc_id", "bucket").join(centres, "bucket").where("doc_id <> centre")
    pairs = pairs.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    return materialise(_close(pairs, sketches, far), "near-pairs")


def _labels(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id and component of every class."""
    return reps.select("doc_id").join(components(edges).withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component")
    )


def _open(filed: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with their components."""
    rows = filed.select("doc_id", "bucket").join(labels, "doc_id")
    several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return rows.join(several.select("bucket"), "bucket", "left_semi")


def _close(pairs: DataFrame, sketches: DataFrame, far: int) -> DataFrame:
    """The pairs whose sketches differ in at most `far` bits."""
    left = sketches.select(F.col("doc_id").alias("a"), F.struct("sketch").alias("x"))
    right = sketches.select(F.col("doc_id").alias("b"), F.struct("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_bits_apart("x", "y") <= far).select("a", "b")


def _able(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows that can still have a link in their bucket, with n and shared.

    A shingle that no other document of the open buckets has is in no intersection. So at
    most `shared` shingles can be, and the similarity to any member is at most shared over
    (smallest set of the bucket + lone ones). This drops edited copies of a hot text one by one,
    without comparing them with each other.
    """
    lone = sets.select("doc_id", F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("doc_id"))
    lone = lone.where("c = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lone"))
    sizes = sets.select("doc_id", F.size("set").alias("n")).join(lone, "doc_id", "left")
    sizes = materialise(sizes.select("doc_id", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("shared")), "near-sizes")
    rows = rows.join(sizes, "doc_id")
    least = rows.groupBy("bucket").agg(F.min("n").alias("least"))
    able = rows.join(least, "bucket").where(100 * F.col("shared") >= percent * (F.col("least") + F.col("n") - F.col("shared")))
    able = materialise(able.drop("least"), "near-able")
    return able.join(_several(able), "bucket", "left_semi")


def _several(rows: DataFrame) -> DataFrame:
    """The buckets whose rows lie in more than one component."""
    return rows.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("bucket")


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, shared, prefix: the shingles, rarest first, that one of any linked set must be.

    A linked set holds `percent` of a set's shingles, so it can lack only the others: of these
    and one more at least one is shared. Shingles that one set alone has take up places but
    link nothing; `shared` counts the others.
    """
    opened = sets.select("doc_id", F.size("set").alias("n"), F.explode("set").alias("s"))
    common = opened.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = opened.join(common, "s").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("held"))
    places = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1 - (F.col("n") - F.size("held"))
    first = F.slice("held", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))
    return listed.select("doc_id", "n", F.size("held").alias("shared"), F.transform(first, lambda x: x["s"]).alias("prefix"))


def _across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that share a rare shingle and may be linked by size and sketch.

    The wide odd sketches, of fixed size whatever the set, let few pairs but links pass, and no
    link with less than six standard deviations. A pair leaves the join with the first of the
    rare shingles that both have, or with each of them where a set has very many.
    """
    wanted = materialise(rows.join(_several(rows), "bucket", "left_semi").select("doc_id", "component").distinct(), "near-wanted")
    own = sets.join(broadcast_if(wanted.select("doc_id"), 24), "doc_id", "left_semi")
    rare = _rarest(own.drop("sketch"), percent).join(wanted, "doc_id").join(own.select("doc_id", "sketch"), "doc_id")
    few = F.when(F.size("prefix") <= PREFIX, F.col("prefix"))
    rare = materialise(rare.select("doc_id", "n", "shared", "component", "sketch", few.alias("few"), F.explode("prefix").alias("s")), "near-rare")
    x, y = rare.alias("x"), rare.alias("y")
    shared = F.least("x.shared", "y.shared")
    fits = 100 * shared >= percent * (F.col("x.n") + F.col("y.n") - shared)
    once = F.coalesce(F.get(F.array_intersect("x.few", "y.few"), F.lit(0)) == F.col("x.s"), F.lit(True))
    near = _wide_bits_apart("x", "y") <= most_bits(percent, WIDE_SAMPLES, WIDE_WORDS)
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & fits & once & near)
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
