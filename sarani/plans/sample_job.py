"""Tables and templates to finished samples."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sarani.functions.splitjson import to_split_json
from sarani.operators.families import FAMILIES, answer_json, execute_family
from sarani.operators.numbering import first_per_key
from sarani.operators.records import answers_in_record, bound_in_record, template_parts, unanswered
from sarani.operators.templates import bind, render_sql, template_list


def bound_pairs(tables: DataFrame, families: tuple[str, ...] | None = None, split: str | None = None,
                seed: int = 42) -> DataFrame:
    """All tables with all (or some families') templates, bound and rendered."""
    return render_sql(bind(tables, template_list(tables.sparkSession, families), split, seed))


def build_samples(tables: DataFrame, families: tuple[str, ...] | None = None, split: str | None = None,
                  seed: int = 42, templates: DataFrame | None = None, table_name: str = "table_id") -> DataFrame:
    """Distinct samples with a non-empty answer, worked out inside each table's record.

    `templates` are the built-in ones unless given. Table ids must differ. Pairs that cannot be
    bound, fail or belong to a family that is not known give no sample; `skipped_pairs` counts them.
    """
    found, whole = sample_records(tables, families, split, seed, templates, table_name)
    found = found.withColumn("answer", answer_json(F.col("sql"), F.col("family"), F.col("answer_rows")))
    text = to_split_json(F.col("header"), F.col("rows"))
    return with_tables(found, tables, whole, input_table_name=F.col(table_name), input_tables=text).select(
        "table_id", "template_id", "sql", "answer", "input_table_name", "input_tables"
    )


def sample_records(tables: DataFrame, families: tuple[str, ...] | None = None, split: str | None = None, seed: int = 42,
                   templates: DataFrame | None = None, table_name: str = "table_id") -> tuple[DataFrame, bool]:
    """Distinct answered pairs, and whether they still hold their tables.

    A template list too long for one array goes in parts; then equal SQL texts of different
    parts meet in a shuffle of texts and answers, without the tables.
    """
    templates = template_list(tables.sparkSession, families) if templates is None else templates
    parts = [answers_in_record(bound_in_record(tables, part, split, seed, table_name)) for part in template_parts(templates)]
    if len(parts) == 1:
        return parts[0], True
    narrow = [p.select("table_id", "template_id", "sql", "family", "func", "answer_rows") for p in parts]
    return first_per_key(functools.reduce(DataFrame.unionByName, narrow), ["table_id", "sql"], [F.col("template_id")]), False


def with_tables(found: DataFrame, tables: DataFrame, whole: bool, **columns: Column) -> DataFrame:
    """The pairs with columns worked out from their tables: at once, or joined in by id."""
    if whole:
        return found.withColumns(columns)
    return found.join(tables.select("table_id", *[c.alias(n) for n, c in columns.items()]), "table_id")


def skipped_pairs(tables: DataFrame, templates: DataFrame | None = None, split: str | None = None, seed: int = 42) -> DataFrame:
    """reason, n_pairs: distinct pairs without a sample, as `unknown family ...` or `no answer`."""
    templates = template_list(tables.sparkSession) if templates is None else templates
    parts = [unanswered(bound_in_record(tables, part, split, seed)) for part in template_parts(templates)]
    left = functools.reduce(DataFrame.unionByName, parts)
    known = F.coalesce(F.col("family").isin(*FAMILIES), F.lit(False))
    reason = F.when(known, F.lit("no answer")).otherwise(F.concat(F.lit("unknown family "), F.coalesce("family", F.lit("null"))))
    return left.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_pairs"))


def family_answers(spark: SparkSession, tables: DataFrame, family: str) -> DataFrame:
    """Answers of one family over all tables; the SQL texts are not rendered."""
    return execute_family(bind(tables, template_list(spark, (family,))), family)
