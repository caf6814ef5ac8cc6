"""Language identification with bit-sliced Bloom filters of character n-grams.

A filter has one slot row of language bits: bit l of a slot belongs to the Bloom filter of
language l. The bitwise AND of an n-gram's slots gives all languages that contain it, in one
look-up. A text adds up these bits per language; the counts are corrected for the filter's
false positives, and the language with the highest corrected count is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sarani.llm.common import chunks

SAMPLE_ROWS = 5_000  # about so many labelled rows of a language are used to fit, at most
SLOTS = 1 << 20
PROBES = 2
SIZES = (3, 4)
LEAST_SHARE = 0.25  # a language contains an n-gram if its rate is at least this part of the highest rate
LEAST_COUNT = 3
UNKNOWN = "und"
CHUNK = 1 << 19
_WORD_BITS = 62  # language bits in one integer


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text: lower case, anything but letters is one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[np.minimum(codes, 0x10FFFF)]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    found = []
    for n in SIZES:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
            found.append(_mix(h))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def slots_of(hashes: np.ndarray, slots: int, probes: int = PROBES) -> list[np.ndarray]:
    """The slots of each hash, one array per probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) % np.uint64(slots)).astype(np.int64) for i in range(probes)]


@dataclass(frozen=True)
class LanguageFilter:
    """The learned languages in order, and the filter: slots x words of language bits."""

    languages: tuple[str, ...]
    bits: np.ndarray

    def false_rates(self) -> np.ndarray:
        """For each language, how often an n-gram that it lacks passes its filter."""
        return np.array([np.mean((self.bits[:, i // _WORD_BITS] >> (i % _WORD_BITS)) & 1) ** PROBES for i in range(len(self.languages))])

    def scores(self, text: str, false_rates: np.ndarray) -> np.ndarray | None:
        """Corrected share of n-grams that each language contains; None without letters."""
        hashes = grams(text)
        if not len(hashes) or not self.languages:
            return None
        masks = np.bitwise_and.reduce([self.bits[s] for s in slots_of(hashes, len(self.bits))])
        counts = np.array([np.count_nonzero((masks[:, i // _WORD_BITS] >> (i % _WORD_BITS)) & 1) for i in range(len(self.languages))])
        n = len(hashes)
        return np.clip((counts - n * false_rates) / (n * np.maximum(1 - false_rates, 1e-9)), 0, 1)


def fit_languages(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS, slots: int = SLOTS,
) -> LanguageFilter:
    """A filter from rows with a non-null language and text.

    `sample_rows` bounds the rows used per language: of a language with more rows a share is taken,
    chosen by a hash of key and text; of one with fewer, all rows. So no language is left out for
    being rare. Repeated rows count as often as they stand, ids may be null. What the driver gets
    is bounded by `slots` and the number of languages. Without rows the filter knows no language.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(counted))
    words = -(-len(languages) // _WORD_BITS) or 1
    bits = np.zeros((slots, words), np.int64)
    if not languages:
        return LanguageFilter((), bits)
    shares = F.create_map(*[F.lit(x) for name, n in counted.items() for x in (name, min(1.0, sample_rows / n))])
    draw = F.shiftrightunsigned(F.xxhash64("k", "text"), 11) / F.lit(float(1 << 53))  # from 0 to 1
    chosen = rows.where(draw < shares[F.col("lang")])
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK):
            by_lang: dict[int, list[np.ndarray]] = {}
            for body, name in zip(chunk.column("text").to_pylist(), chunk.column("lang").to_pylist()):
                by_lang.setdefault(number[name], []).append(grams(body))
            for i, parts in by_lang.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang_no", "gram", "n"])

    seen = chosen.select("text", "lang").mapInArrow(count, "lang_no int, gram long, n long").groupBy("gram", "lang_no").agg(F.sum("n").alias("n"))
    totals = {r.lang_no: r.n for r in seen.groupBy("lang_no").agg(F.sum("n").alias("n")).collect()}
    rates = F.create_map(*[F.lit(x) for i, n in totals.items() for x in (i, float(max(n, 1)))]) if totals else F.lit(None)
    shares = seen.withColumn("rate", F.col("n") / rates[F.col("lang_no")])
    held = (
        shares.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang_no", "n", "rate")).alias("langs"))
        .select("gram", F.explode(F.filter("langs", lambda x: (x.n >= LEAST_COUNT) & (x.rate >= LEAST_SHARE * F.col("top")))).alias("x"))
        .select("gram", (F.col("x.lang_no") / _WORD_BITS).cast("int").alias("word"), F.expr(f"shiftleft(1L, x.lang_no % {_WORD_BITS})").alias("bit"))
        .groupBy("gram", "word").agg(F.bit_or("bit").alias("bits"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
            for where in slots_of(hashes, slots):
                yield pa.RecordBatch.from_arrays([pa.array(where), batch.column("word"), batch.column("bits")], ["slot", "word", "bits"])

    filled = held.mapInArrow(place, "slot long, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits[filled.column("slot").to_numpy(), filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return LanguageFilter(languages, bits)


def identify_language(
    docs: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, lang_pred, score and the columns `carry`: one row per input row; only the text decides.

    `und` with score 0 for a null text, one without a letter, or a model without languages.
    Equal scores go to the first language in order. Other columns are not read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by slots and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        false_rates = known.false_rates()
        for batch in chunks(batches, "text", CHUNK):
            names, scores = [], []
            for body in batch.column("text").to_pylist():
                found = None if body is None else known.scores(body, false_rates)
                best = 0 if found is None else int(np.argmax(found))
                names.append(UNKNOWN if found is None else known.languages[best])
                scores.append(0.0 if found is None else float(found[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *[batch.column(c) for c in carried]],
                ["doc_id", "lang_pred", "score", *carried],
            )

    # A text column that is carried goes to Python once.
    carried = ["text" if c == text and kinds[c] == "string" else f"carried_{i}" for i, c in enumerate(carry)]
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        *[F.col(c).alias(name) for c, name in zip(carry, carried) if name != "text"],
    )
    fields = ["doc_id long", "lang_pred string", "score double", *[f"{name} {kinds[c]}" for c, name in zip(carry, carried)]]
    found = rows.mapInArrow(run, ", ".join(fields))
    return found.select("doc_id", "lang_pred", "score", *[F.col(name).alias(c) for c, name in zip(carry, carried)])


def held_out(key: str = "doc_id") -> Column:
    """True for a quarter of the keys, kept from training; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
