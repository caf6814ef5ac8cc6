"""Answers of bound templates: one job per template family over all tables.

A family reads the bound pairs, opens their tables to rows and aggregates by
(table_id, template_id). The rows of a pair lie in one task, so aggregates shrink to a
row per pair before the shuffle. Tables too large to nest are joined in instead, by
blocks of rows, so that a very large table is spread over many tasks.

Answers are `table_id, template_id, row_no, value`; numbers are text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from sarani.functions.languages import number_of
from sarani.functions.splitjson import to_split_json
from sarani.session import materialise

KEYS = ["table_id", "template_id"]
ROW_BLOCK = 10_000
KEY_SALTS = 16


def _scan(bound: DataFrame, rows: DataFrame | None) -> DataFrame:
    """One record per pair and table row, with `v` the row's values.

    `rows` holds table_id, row_no and values; `bound` then needs `n_rows`, not `rows`.
    """
    keep = [*KEYS, "func", "slot_cols", "lits"]
    if rows is None:
        return bound.select(*keep, F.posexplode("rows").alias("row_no", "v"))
    last = F.floor((F.greatest(F.col("n_rows"), F.lit(1)) - 1) / ROW_BLOCK).cast("int")
    spread = bound.select(*keep, F.explode(F.sequence(F.lit(0), last)).alias("_block"))
    blocks = rows.select(
        "table_id", "row_no", F.col("values").alias("v"),
        F.floor(F.col("row_no") / ROW_BLOCK).cast("int").alias("_block"),
    )
    return spread.join(blocks, ["table_id", "_block"]).drop("_block")


def _slot(i: int) -> Column:
    """The row's value in the column of the i-th slot."""
    return F.get(F.col("v"), F.get(F.col("slot_cols"), F.lit(i)))


def _lit(i: int) -> Column:
    return F.get(F.col("lits"), F.lit(i))


def rounded(c: Column) -> Column:
    """A number as text, to four places."""
    return F.round(c, 4).cast("string")


def _answer(value: Column, row_no: Column | None = None) -> list[Column]:
    no = F.lit(0) if row_no is None else row_no
    return [*[F.col(k) for k in KEYS], no.cast("int").alias("row_no"), value.alias("value")]


def project_where(rows: DataFrame) -> DataFrame:
    value = F.when(F.col("func") == "abs", rounded(F.abs(number_of(_slot(0))))).otherwise(_slot(0))
    return rows.filter(_slot(1) == _lit(0)).select(*_answer(value, F.col("row_no")))


def count_where(rows: DataFrame) -> DataFrame:
    hit = F.count(F.when(_slot(1) == _lit(0), _slot(0)))
    return rows.groupBy(*KEYS).agg(hit.alias("n")).select(*_answer(F.col("n").cast("string")))


def count_distinct(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(*KEYS).agg(F.countDistinct(_slot(0)).alias("n"))
        .select(*_answer(F.col("n").cast("string")))
    )


def numeric_agg(rows: DataFrame) -> DataFrame:
    """sum, min, max and avg at once; each pair keeps the one it asks for."""
    n = F.col("n")
    hits = rows.filter(_slot(1) == _lit(0)).select(*KEYS, "func", number_of(_slot(0)).alias("n"))
    agg = hits.groupBy(*KEYS, "func").agg(
        F.sum(n).alias("sum"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("avg")
    )
    value = F.when(F.col("func") == "sum", F.col("sum")).when(F.col("func") == "min", F.col("min"))
    value = value.when(F.col("func") == "max", F.col("max")).otherwise(F.col("avg"))
    return agg.select(*_answer(rounded(value)))


def superlative(rows: DataFrame) -> DataFrame:
    """Value of the row with the largest number; the first such row wins."""
    best = F.max(F.struct(number_of(_slot(1)).alias("n"), (-F.col("row_no")).alias("r"), _slot(0).alias("v")))
    return rows.groupBy(*KEYS).agg(best.alias("b")).select(*_answer(F.col("b.v")))


def most_frequent(rows: DataFrame) -> DataFrame:
    """The most frequent value; the smallest text wins a tie."""
    counts = rows.groupBy(*KEYS, _slot(0).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("v")))
    return counts.groupBy(*KEYS).agg(best.alias("b")).select(*_answer(F.col("b.v")))


def between(rows: DataFrame) -> DataFrame:
    inside = number_of(_slot(1)).between(number_of(_lit(0)), number_of(_lit(1)))
    return rows.filter(inside).select(*_answer(_slot(0), F.col("row_no")))


def like(rows: DataFrame) -> DataFrame:
    """Rows like a pattern, in which a backslash is an ordinary character."""
    pattern = F.replace(_lit(0), F.lit("\\"), F.lit("\\\\"))
    return rows.filter(F.like(_slot(1), pattern)).select(*_answer(_slot(0), F.col("row_no")))


def difference(rows: DataFrame) -> DataFrame:
    """Difference of two looked-up numbers; pairs with more than one row per look-up fail."""
    first, second = _slot(1) == _lit(0), _slot(1) == _lit(1)
    n = number_of(_slot(0))
    agg = rows.groupBy(*KEYS).agg(
        F.count_if(first).alias("n1"), F.count_if(second).alias("n2"),
        F.max(F.when(first, n)).alias("a"), F.max(F.when(second, n)).alias("b"),
    )
    found = agg.filter((F.col("n1") <= 1) & (F.col("n2") <= 1))
    return found.select(*_answer(rounded(F.col("a") - F.col("b"))))


def in_subquery(rows: DataFrame) -> DataFrame:
    """Rows whose value the inner query selects."""
    return _selected(rows, "left_semi")


def not_in(rows: DataFrame) -> DataFrame:
    """Rows whose value the inner query does not select."""
    return _selected(rows, "left_anti")


def _selected(rows: DataFrame, how: str) -> DataFrame:
    """Rows with a key that some row with the inner literal has, or that none has.

    The inner keys are made distinct before they are shuffled, and the outer rows of a key are
    spread over `KEY_SALTS` tasks, so that a key with a third of a table's rows is no hot task.
    """
    salt = F.pmod("row_no", F.lit(KEY_SALTS))
    inner = rows.filter(_slot(2) == _lit(0)).select(*KEYS, _slot(1).alias("key")).filter("key is not null").distinct()
    inner = inner.select("*", F.explode(F.sequence(F.lit(0), F.lit(KEY_SALTS - 1))).alias("salt"))
    outer = rows.select(*KEYS, "row_no", _slot(0).alias("value"), _slot(1).alias("key"), salt.cast("int").alias("salt")).filter("key is not null")
    return outer.join(inner, [*KEYS, "key", "salt"], how).select(*_answer(F.col("value"), F.col("row_no")))


def bool_where(rows: DataFrame) -> DataFrame:
    """and, or and not of conditions."""
    a, b, func = _slot(1) == _lit(0), _slot(2) == _lit(1), F.col("func")
    hit = F.when(func == "and", a & b).when(func == "or", a | b).otherwise(~a)
    return rows.filter(hit).select(*_answer(_slot(0), F.col("row_no")))


def lowest_k(rows: DataFrame, k: int = 3) -> DataFrame:
    """Values of the rows with the `k` smallest numbers, in that order; earlier rows first.

    Two steps: the first `k` of each block of rows, then of the blocks' firsts.
    """
    cut = rows.select(*KEYS, "row_no", _slot(0).alias("value"), number_of(_slot(1)).alias("n"))
    cut = cut.withColumn("block", F.floor(F.col("row_no") / ROW_BLOCK))
    for group in ([*KEYS, "block"], KEYS):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("n").asc_nulls_last(), "row_no"))
        cut = cut.withColumn("rank", rank).filter(F.col("rank") <= k)
    return cut.select(*_answer(F.col("value"), F.col("rank") - 1))


def group_agg(rows: DataFrame) -> DataFrame:
    """sum and count per value of a column."""
    group = F.when(F.col("func") == "sum", _slot(1)).otherwise(_slot(0))
    agg = rows.groupBy(*KEYS, "func", group.alias("group")).agg(F.count(F.lit(1)).alias("count"), F.sum(number_of(_slot(0))).alias("sum"))
    value = F.when(F.col("func") == "sum", rounded(F.col("sum"))).otherwise(F.col("count").cast("string"))
    return agg.select(*_answer(value))


def having(rows: DataFrame) -> DataFrame:
    """Values that more than one row has."""
    counts = rows.groupBy(*KEYS, _slot(0).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1").select(*_answer(F.col("value")))


def subtract(rows: DataFrame) -> DataFrame:
    """Difference of two numbers of a row."""
    value = rounded(number_of(_slot(0)) - number_of(_slot(1)))
    return rows.filter(_slot(2) == _lit(0)).select(*_answer(value, F.col("row_no")))


def set_operation(rows: DataFrame) -> DataFrame:
    """union, intersect and except of two filters, on distinct values, in one pass."""
    agg = rows.groupBy(*KEYS, "func", _slot(0).alias("value")).agg(
        F.bool_or(_slot(1) == _lit(0)).alias("a"), F.bool_or(_slot(2) == _lit(1)).alias("b")
    )
    a, b, func = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False)), F.col("func")
    hit = F.when(func == "union", a | b).when(func == "intersect", a & b).otherwise(a & ~b)
    return agg.filter(hit).select(*_answer(F.col("value")))


FAMILIES = {
    "project_where": project_where, "count_where": count_where, "count_distinct": count_distinct,
    "numeric_agg": numeric_agg, "superlative": superlative, "most_frequent": most_frequent,
    "between": between, "like": like, "difference": difference, "in_subquery": in_subquery,
    "set_operation": set_operation, "bool_where": bool_where, "not_in": not_in, "lowest_k": lowest_k,
    "group_agg": group_agg, "having": having, "subtract": subtract,
}


def execute_family(bound: DataFrame, family: str, rows: DataFrame | None = None) -> DataFrame:
    """Answers of all pairs of one family."""
    return FAMILIES[family](_scan(bound.filter(F.col("family") == family), rows))


def execute(bound: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Answers of all families; give a written `bound`, it is read once per family.

    A pair of a family that is not known has no answer; `unknown_families` gives such pairs.
    """
    return functools.reduce(DataFrame.unionByName, [execute_family(bound, family, rows) for family in FAMILIES])


def unknown_families(bound: DataFrame) -> DataFrame:
    """Pairs that no family answers, with the reason."""
    known = F.coalesce(F.col("family").isin(*FAMILIES), F.lit(False))
    reason = F.concat(F.lit("no such family: "), F.coalesce("family", F.lit("null")))
    return bound.filter(~known).select(*KEYS, reason.alias("reason"))


def non_empty(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """Samples with at least one answer row."""
    return samples.join(answers.select(*KEYS).distinct(), KEYS, "left_semi")


def answer_column(sql: Column, family: Column) -> Column:
    """Header of the answer: the selected expression, a bare column without backticks."""
    whole = F.regexp_extract(sql, r"(?s)\Aselect (.*)\z", 1)
    head = F.when(family == "difference", whole).otherwise(F.regexp_extract(sql, r"(?s)\Aselect (.*?) from ", 1))
    bare = F.replace(F.regexp_extract(head, r"(?s)\A`(.*)`\z", 1), F.lit("``"), F.lit("`"))
    return F.when(head.rlike(r"\A`([^`]|``)*`\z"), bare).otherwise(head)


def answer_json(sql: Column, family: Column, answer_rows: Column) -> Column:
    """An answer in order as split-JSON text."""
    return to_split_json(F.array(answer_column(sql, family)), F.transform(answer_rows, lambda a: F.array(a["value"])))


def answer_blocks(answers: DataFrame, rows_per_block: int = ROW_BLOCK) -> DataFrame:
    """table_id, template_id, block, answer_rows: the answers of large tables in bounded records.

    Rows of the table keep their order: a block holds those of `rows_per_block` row numbers.
    Answers without row numbers (groups and distinct values) are dealt by value instead, as many
    blocks as their count asks for.
    """
    answers = materialise(answers, "answers")  # read for the sizes and for the blocks
    sizes = answers.groupBy(*KEYS).agg(F.max("row_no").alias("last"), F.count(F.lit(1)).alias("n"))
    sized = answers.join(sizes, KEYS)
    by_value = F.pmod(F.xxhash64("value"), F.ceil(F.col("n") / rows_per_block))
    block = F.when(F.col("last") == 0, by_value).otherwise(F.floor(F.col("row_no") / rows_per_block))
    grouped = sized.groupBy(*KEYS, block.cast("long").alias("block"))
    return grouped.agg(F.array_sort(F.collect_list(F.struct("row_no", "value"))).alias("answer_rows"))


def assemble(samples: DataFrame, answers: DataFrame, tables: DataFrame, table_name: str = "table_id") -> DataFrame:
    """Finished samples: SQL, answer, table name and the whole table in one record.

    `samples` are pairs with their SQL, of which only ids, texts and answers are moved; each table
    is joined in once, by its id, after its answers have met. An answer has at most as many rows as its
    table, which the cell limit bounds.
    """
    grouped = answers.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("row_no", "value"))).alias("answer_rows"))
    found = samples.select(*KEYS, "sql", "family").join(grouped, KEYS)
    found = found.select(*KEYS, "sql", answer_json(F.col("sql"), F.col("family"), F.col("answer_rows")).alias("answer"))
    whole = tables.select("table_id", F.col(table_name).alias("input_table_name"), to_split_json(F.col("header"), F.col("rows")).alias("input_tables"))
    return found.join(whole, "table_id").select(*KEYS, "sql", "answer", "input_table_name", "input_tables")
