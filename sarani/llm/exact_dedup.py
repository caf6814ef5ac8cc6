"""Exact deduplication: groups by a 128-bit content hash, with bytes compared inside groups.

The texts are aggregated by (hash, bytes), so two texts share a class only if all their
bytes are equal; a hash with two classes is a collision and is resolved by bytes. Copies
are combined before the shuffle: a text that a third of all rows hold costs each map task
one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sarani.llm.common import as_bytes, chunks, keyed_texts
from sarani.session import materialise

CHUNK = 1 << 20

Hash = Callable[[bytes], bytes]


def content_hash(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def normalised(texts: DataFrame, hash_of: Hash, columns: tuple[str, ...]) -> DataFrame:
    """doc_id and the wanted ones of `hash`, `sha256`, `norm` (text with A-Z in lower case)."""
    kinds = {"hash": "binary", "sha256": "string", "norm": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            norm = [t.lower() for t in as_bytes(batch.column("text"))]
            made = {
                "hash": lambda norm=norm: pa.array([hash_of(t) for t in norm], pa.binary()),
                "sha256": lambda norm=norm: pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string()),
                "norm": lambda norm=norm: pa.array(norm, pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[made[c]() for c in columns]], ["doc_id", *columns]
            )

    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", hash_of: Hash = content_hash,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when their bytes are, after lower-casing A-Z. `keep` names the stable id
    that stays: "smallest" or "largest". Null texts are empty texts; empty texts form a
    group. Rows that repeat an id with the same text count in group_size and share one mark.
    A null id loses to any other id. Other columns are not read. An empty table gives no rows.
    """
    chosen = {"smallest": F.min, "largest": F.max}[keep]("doc_id").alias("keep_id")
    texts = keyed_texts(docs, key, text)
    marks = materialise(normalised(texts, hash_of, ("hash", "sha256")), "exact-marks")
    classes = materialise(
        normalised(texts, hash_of, ("hash", "norm")).groupBy("hash", "norm")
        .agg(chosen, F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("norm", 256).alias("sha256"), "keep_id", "group_size"),
        "exact-classes",
    )
    clashes = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    if clashes.isEmpty():
        joined = marks.join(classes.drop("sha256"), "hash")
    else:
        joined = _resolved(texts, marks, classes, clashes, hash_of, chosen)
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def _resolved(texts, marks, classes, clashes, hash_of, chosen) -> DataFrame:
    """The classes joined to the rows; rows under a hash of several texts join by their bytes."""
    plain = marks.join(classes.join(clashes, "hash", "left_anti").drop("sha256"), "hash")
    rows = normalised(texts, hash_of, ("hash", "sha256", "norm")).join(clashes, "hash", "left_semi")
    groups = rows.groupBy("hash", "norm").agg(chosen, F.count(F.lit(1)).alias("group_size"))
    return plain.unionByName(rows.join(groups, ["hash", "norm"]).drop("norm"))
