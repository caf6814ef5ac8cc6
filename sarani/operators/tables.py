"""Operators on the table corpus: shape, names, duplicates, cells and numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sarani.functions.once import compute_once
from sarani.operators.numbering import ROWS_PER_BUCKET, first_per_key, number_within

MAX_CELLS = 500
NUMERIC_PATTERN = r"\A\p{N}+\z"


def rectangular(df: DataFrame) -> DataFrame:
    """Tables whose rows all have the header's width."""
    return df.filter(F.forall("rows", lambda r: F.size(r) == F.size("header")))


def fan_out_rows(df: DataFrame) -> DataFrame:
    """Each row once per header column, as older copies of the corpus have it."""
    return df.withColumn(
        "rows", F.flatten(F.transform("rows", lambda r: F.array_repeat(r, F.size("header"))))
    )


def max_cells(df: DataFrame, n: int = MAX_CELLS) -> DataFrame:
    """Tables with at most `n` body cells."""
    return df.filter(F.size("rows") * F.size("header") <= n)


def name_tables(df: DataFrame, order: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`title_k`, where k counts the earlier tables with that title."""
    numbered = number_within(df, ["title"], order, "table_index", rows_per_bucket=rows_per_bucket)
    return numbered.withColumn(
        "table_name", F.concat("title", F.lit("_"), F.col("table_index").cast("string"))
    )


def title_of(table_name: Column) -> Column:
    """Table name up to its last underscore; all but the last character when it has none."""
    return F.when(F.contains(table_name, F.lit("_")), F.regexp_replace(table_name, r"_[^_]*\z", "")).otherwise(
        F.substring(table_name, F.lit(1), F.length(table_name) - 1)
    )


def content_hash(header: Column, rows: Column) -> Column:
    return F.sha2(F.to_json(F.struct(header.alias("h"), rows.alias("r"))), 256)


def unique_tables(df: DataFrame, order: str) -> DataFrame:
    """Within a title, the first table of each header and content."""
    hashed = df.withColumn("_hash", content_hash(F.col("header"), F.col("rows")))
    return first_per_key(hashed, ["title", "_hash"], [F.col(order)]).drop("_hash")


def to_cells(df: DataFrame) -> DataFrame:
    """Nested tables to one row per cell."""
    rows = df.select("table_id", "header", F.posexplode("rows").alias("row_no", "_values"))
    return rows.select(
        "table_id", "row_no", "header", F.posexplode("_values").alias("col_no", "value")
    ).select("table_id", "row_no", "col_no", F.get("header", F.col("col_no")).alias("header"), "value")


def to_tables(cells: DataFrame) -> DataFrame:
    """Cells back to nested tables, also above the cell limit.

    A table is one record, put together in one task: it must fit a task's memory and the
    2 GB that a record may have. Tables that grow with the data go in as blocks of rows
    with a table_id each.
    """
    grouped = cells.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "col_no", "header", "value"))).alias("_c"),
        (F.max("col_no") + 1).alias("_w"),
    )
    values = F.transform("_c", lambda c: c["value"])
    height = (F.size("_c") / F.col("_w")).cast("int")
    return compute_once(grouped, _v=values).select(
        "table_id",
        F.transform(F.slice("_c", F.lit(1), F.col("_w")), lambda c: c["header"]).alias("header"),
        F.transform(
            F.sequence(F.lit(0), height - 1), lambda i: F.slice("_v", i * F.col("_w") + 1, F.col("_w"))
        ).alias("rows"),
    )


def numeric_columns(cells: DataFrame) -> DataFrame:
    """Per column, whether every value consists of number characters."""
    return cells.groupBy("table_id", "col_no", "header").agg(
        F.bool_and(F.col("value").rlike(NUMERIC_PATTERN)).alias("is_numeric")
    )


def numeric_positions(header: Column, rows: Column) -> Column:
    """0-based positions of the numeric columns of a nested table; empty columns count."""
    places = F.sequence(F.lit(0), F.size(header) - 1)
    return F.filter(
        places, lambda j: F.forall(rows, lambda r: F.get(r, j).rlike(NUMERIC_PATTERN))
    )


def quarantine(df: DataFrame, checks: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows; bad rows carry the first `reason` that holds."""
    for reason, failed in (checks or {}).items():
        old = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("reason", F.coalesce(old, F.when(F.coalesce(failed, F.lit(True)), F.lit(reason))))
    return df.filter("reason is null").drop("reason"), df.filter("reason is not null")


def title_index(named: DataFrame, chunk: int = 1000) -> DataFrame:
    """Table names by title, in chunks of the table index so that no list grows without end."""
    return (
        named.groupBy("title", F.floor(F.col("table_index") / chunk).cast("bigint").alias("chunk_no"))
        .agg(F.array_sort(F.collect_list(F.struct("table_index", "table_name"))).alias("_t"))
        .select("title", "chunk_no", F.transform("_t", lambda t: t["table_name"]).alias("table_names"))
    )
