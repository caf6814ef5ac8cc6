"""Tables as `{columns, index, data}` JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPLIT_SCHEMA = "columns array<string>, index array<int>, data array<array<string>>"


def to_split_json(header: Column, rows: Column) -> Column:
    """Header and rows as one split-JSON string."""
    n = F.size(rows)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.to_json(
        F.named_struct(F.lit("columns"), header, F.lit("index"), index, F.lit("data"), rows)
    )


def from_split_json(c: Column) -> Column:
    """Split-JSON text to a struct of columns, index and data; numbers come back as text."""
    return F.from_json(c, SPLIT_SCHEMA)
