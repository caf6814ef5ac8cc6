"""Ways to have an expensive expression evaluated once.

Spark substitutes computed columns into later filters and into lambda bodies, where
they would run again for every filter or every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with computed columns that filters cannot be pushed through."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
