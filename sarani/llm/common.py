"""Helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The cells of a text or binary column as bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `size` bytes of text each, so that temporaries stay small."""
    for batch in batches:
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate(lengths):
            held += n
            if held >= size:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key (as long) and the text (null as empty), under fixed names."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def fits(df: DataFrame, row_bytes: int, items: str | None = None, most: int = 64 << 20) -> bool:
    """True when a written table takes at most `most` bytes: its rows (or the items of the
    list column `items`) are counted by partial sums and taken at `row_bytes` each."""
    one = F.lit(1) if items is None else F.size(items) + 1
    return (df.agg(F.sum(one)).first()[0] or 0) * row_bytes <= most


def broadcast_if(df: DataFrame, row_bytes: int, items: str | None = None, most: int = 64 << 20) -> DataFrame:
    """`df`, marked for a broadcast if it fits; the result of a join is the same either way."""
    return F.broadcast(df) if fits(df, row_bytes, items, most) else df
