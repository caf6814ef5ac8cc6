"""Pages to a table corpus: pick, parse, check, name and deduplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sarani.operators.html import parse_tables, select_tables
from sarani.operators.tables import MAX_CELLS, max_cells, name_tables, quarantine, rectangular, unique_tables
from sarani.session import materialise


def parsed_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good tables with a running number `seq`, and the quarantined ones with their reason."""
    parsed = parse_tables(select_tables(pages))
    good, bad = quarantine(parsed)
    return good.withColumn("seq", F.col("page_id") * 10 + F.col("table_no")), bad


def build_corpus(pages: DataFrame, n: int = MAX_CELLS) -> DataFrame:
    """Named, distinct, rectangular tables of at most `n` cells.

    The parsed tables are written once; naming and deduplication read the file.
    """
    good, _ = parsed_tables(pages)
    kept = materialise(rectangular(max_cells(good, n)), "parsed")
    named = name_tables(kept, "seq")
    unique = unique_tables(named, "seq")
    return unique.select("table_name", "title", "table_index", "url", "header", "rows")


def corpus_rejects(pages: DataFrame, n: int = MAX_CELLS) -> DataFrame:
    """What `build_corpus` leaves out: reason, n_tables and n_rows (body rows where known).

    `ragged_rows` counts tables that lost rows of another width, and those rows;
    `too_many_cells` counts tables above `n` cells; other reasons are those of the quarantine.
    """
    good, bad = parsed_tables(pages)
    ragged = good.filter("ragged_rows > 0").select(F.lit("ragged_rows").alias("reason"), F.col("ragged_rows").alias("rows"))
    large = good.filter(F.size("rows") * F.size("header") > n).select(F.lit("too_many_cells").alias("reason"), F.size("rows").alias("rows"))
    unread = bad.select("reason", F.lit(None).cast("int").alias("rows"))
    left_out = ragged.unionByName(large).unionByName(unread)
    return left_out.groupBy("reason").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("rows").alias("n_rows"))


def raw_records(good: DataFrame) -> DataFrame:
    """Parsed tables as raw table records: row 0 of `table` is the header."""
    return good.select("title", "url", F.concat(F.array("header"), F.col("rows")).alias("table"))
