"""Row numbers and first-of-group that hold up when one key owns much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sarani.session import is_small, materialise

# Rows one sort task is asked to number.
ROWS_PER_BUCKET = 200_000
_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def number_within(
    df: DataFrame,
    keys: list[str],
    order: str,
    name: str = "row_no",
    total: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """0-based number of each row within `keys`, by `order`, then `ties`.

    More than `rows_per_bucket` rows are cut into ranges of (keys, order, ties), as many as their
    number asks for, so a key with a third of all rows (or no key at all), or a single value
    of `order`, is numbered by many tasks. The sorted ranges are written with each row's place;
    a row's number is its place in the key's part of the range, and the sizes of the key's
    parts in the ranges before. Rows that agree in all of these are ordered by a hash of the row.
    With `total`, the group size is added.
    """
    group = keys or [F.lit(0)]
    rows = df.count()
    if rows <= rows_per_bucket:
        number = F.row_number().over(Window.partitionBy(*group).orderBy(order, *ties)) - 1
        out = df.withColumn(name, number.cast("bigint"))
        return out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*group))) if total else out
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    by = [*keys, order, *ties, F.xxhash64(*hashed)]
    ranged = df.repartitionByRange(-(-rows // rows_per_bucket), *by).sortWithinPartitions(*by)
    ranged = materialise(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_range", F.shiftright("_place", _PLACE_BITS))

    # One row per key and range.
    parts = ranged.groupBy(*keys, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = materialise(parts.select(
        *keys, "_range", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    ), "offsets")
    same = F.col("l._range") == F.col("r._range")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    right = (F.broadcast(offsets) if is_small(offsets) else offsets).alias("r")
    out = [F.col(f"l.{c}").alias(c) for c in df.columns]
    out.append((F.col("l._place") + F.col("r._offset")).cast("bigint").alias(name))
    if total:
        out.append(F.col("r._total").cast("bigint").alias(total))
    return ranged.alias("l").join(right, same).select(*out)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group.

    Spark cuts every map task's groups to one row before the shuffle, so a group of
    copies with a third of all rows sends one row per task.
    """
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")
