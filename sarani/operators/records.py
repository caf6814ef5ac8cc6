"""Samples of a table worked out inside the table's own record.

A table within the cell limit holds all that its queries need. So its pairs with the
templates, their SQL, the choice of distinct texts and the answers are array expressions
over its record: no row is copied per pair and nothing is shuffled. Tables beyond the limit
go through the jobs of `families`, which give the same answers.

Answers are arrays of (row_no, value), as `families` gives them in rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sarani.functions.languages import number_of
from sarani.functions.once import compute_once, let
from sarani.operators.families import rounded
from sarani.operators.templates import (
    ARRAY_TEMPLATES, classify_templates, compile_templates, drop_id_templates, literal_values, slot_columns, sql_text,
)
from sarani.operators.tables import numeric_positions

ANSWER = "array<struct<row_no:int,value:string>>"
LOWEST = 3


def _one(value: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("row_no"), value.alias("value")))


def _rows(x: Column, hit: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """An answer row per table row that meets the condition."""
    return F.transform(F.filter(x, hit), lambda r: F.struct(r["row_no"].alias("row_no"), value(r).alias("value")))


def _values(values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(0).alias("row_no"), v.alias("value")))


def _first(r: Column) -> Column:
    return r["s0"]


def _total(numbers: Column) -> Column:
    """The sum of the numbers that aren't null; null without any."""
    known = F.filter(numbers, lambda n: n.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, n: a + n))


def _distinct(x: Column, value: Callable[[Column], Column]) -> Column:
    return F.array_distinct(F.transform(x, value))


def _where(x: Column, value: Callable[[Column], Column], group: Column) -> Column:
    return F.filter(x, lambda r: value(r).eqNullSafe(group))


def _numeric_agg(x: Column, lits: Column, func: Column) -> Column:
    def of(n: Column) -> Column:
        known = F.size(F.filter(n, lambda v: v.isNotNull()))
        value = F.when(func == "sum", _total(n)).when(func == "min", F.array_min(n)).when(func == "max", F.array_max(n))
        return F.when(F.size(n) > 0, _one(rounded(value.otherwise(_total(n) / F.when(known > 0, known)))))

    return let(F.transform(F.filter(x, lambda r: r["s1"] == F.get(lits, F.lit(0))), lambda r: number_of(r["s0"])), of)


def _superlative(x: Column) -> Column:
    best = F.array_max(F.transform(x, lambda r: F.struct(number_of(r["s1"]).alias("n"), (-r["row_no"]).alias("r"), r["s0"].alias("v"))))
    return _one(best["v"])


def _most_frequent(x: Column) -> Column:
    best = F.array_min(F.transform(_distinct(x, _first), lambda v: F.struct((-F.size(_where(x, _first, v))).alias("n"), v.alias("v"))))
    return _one(best["v"])


def _difference(x: Column, lits: Column) -> Column:
    look_up = lambda k: F.filter(x, lambda r: r["s1"] == F.get(lits, F.lit(k)))
    number = lambda found: number_of(F.get(found, F.lit(0))["s0"])
    both = lambda a, b: F.when((F.size(a) <= 1) & (F.size(b) <= 1), _one(rounded(number(a) - number(b))))
    return let(look_up(0), lambda a: let(look_up(1), lambda b: both(a, b)))


def _selected(x: Column, lits: Column, wanted: bool) -> Column:
    """Rows whose value the inner query selects, or does not."""
    inner = F.transform(F.filter(x, lambda r: r["s1"].isNotNull() & (r["s2"] == F.get(lits, F.lit(0)))), lambda r: r["s1"])
    return let(inner, lambda keys: _rows(x, lambda r: r["s1"].isNotNull() & (F.array_contains(keys, r["s1"]) == wanted), _first))


def _lowest(x: Column) -> Column:
    ranked = F.transform(x, lambda r: F.struct(number_of(r["s1"]).isNull().alias("none"), number_of(r["s1"]).alias("n"), r["row_no"].alias("r"), r["s0"].alias("v")))
    return F.transform(F.slice(F.array_sort(ranked), 1, LOWEST), lambda r, i: F.struct(i.alias("row_no"), r["v"].alias("value")))


def _group_agg(x: Column, func: Column) -> Column:
    group = lambda r: F.when(func == "sum", r["s1"]).otherwise(r["s0"])
    total = lambda g: rounded(_total(F.transform(_where(x, group, g), lambda r: number_of(r["s0"]))))
    count = lambda g: F.size(_where(x, group, g)).cast("string")
    return _values(F.transform(_distinct(x, group), lambda g: F.when(func == "sum", total(g)).otherwise(count(g))))


def _set_operation(x: Column, lits: Column, func: Column) -> Column:
    def hit(v):
        own = _where(x, _first, v)
        a = F.exists(own, lambda r: F.coalesce(r["s1"] == F.get(lits, F.lit(0)), F.lit(False)))
        b = F.exists(own, lambda r: F.coalesce(r["s2"] == F.get(lits, F.lit(1)), F.lit(False)))
        return F.when(func == "union", a | b).when(func == "intersect", a & b).otherwise(a & ~b)

    return _values(F.filter(_distinct(x, _first), hit))


def answer(family: Column, func: Column, lits: Column, x: Column) -> Column:
    """Answer of a bound pair from its rows `x`, (row_no, s0, s1, s2) by slot; null if there is
    none, as for a family that is not known."""
    lit = lambda k: F.get(lits, F.lit(k))
    absolute = lambda r: F.when(func == "abs", rounded(F.abs(number_of(r["s0"])))).otherwise(r["s0"])
    within = lambda r: number_of(r["s1"]).between(number_of(lit(0)), number_of(lit(1)))

    def condition(r):
        a, b = r["s1"] == lit(0), r["s2"] == lit(1)
        return F.when(func == "and", a & b).when(func == "or", a | b).otherwise(~a)

    by_family = {
        "project_where": _rows(x, lambda r: r["s1"] == lit(0), absolute),
        "count_where": _one(F.size(F.filter(x, lambda r: (r["s1"] == lit(0)) & r["s0"].isNotNull())).cast("string")),
        "count_distinct": _one(F.size(F.filter(_distinct(x, _first), lambda v: v.isNotNull())).cast("string")),
        "numeric_agg": _numeric_agg(x, lits, func),
        "superlative": _superlative(x),
        "most_frequent": _most_frequent(x),
        "between": _rows(x, within, _first),
        "like": _rows(x, lambda r: F.like(r["s1"], F.replace(lit(0), F.lit("\\"), F.lit("\\\\"))), _first),
        "difference": _difference(x, lits),
        "in_subquery": _selected(x, lits, True),
        "not_in": _selected(x, lits, False),
        "set_operation": _set_operation(x, lits, func),
        "bool_where": _rows(x, condition, _first),
        "lowest_k": _lowest(x),
        "group_agg": _group_agg(x, func),
        "having": _values(F.filter(_distinct(x, _first), lambda v: F.size(_where(x, _first, v)) > 1)),
        "subtract": _rows(x, lambda r: r["s2"] == lit(0), lambda r: rounded(number_of(r["s0"]) - number_of(r["s1"]))),
    }
    found = F.lit(None).cast(ANSWER)
    for name, value in by_family.items():
        found = F.when(family == name, value.cast(ANSWER)).otherwise(found)
    return F.when(F.size(x) > 0, found)


def slotted(rows: Column, slot_cols: Column) -> Column:
    """The table's rows with the values of the first three slots."""
    cell = lambda v, k: F.get(v, F.get(slot_cols, F.lit(k))).alias(f"s{k}")
    return F.transform(rows, lambda v, i: F.struct(i.alias("row_no"), cell(v, 0), cell(v, 1), cell(v, 2)))


def template_parts(templates: DataFrame, most: int = ARRAY_TEMPLATES) -> list[DataFrame]:
    """The templates in parts of about `most` at the most, each short enough for one array."""
    n = -(-templates.count() // most)
    return [templates.filter(F.pmod(F.xxhash64("template_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [templates]


def bound_in_record(tables: DataFrame, templates: DataFrame, split: str | None = None, seed: int = 42, table_name: str = "table_id") -> DataFrame:
    """The tables with `pairs`: their distinct bound templates, of equal SQL texts the lowest one.

    The templates travel as one array; `template_parts` cuts a longer list. Each pair is (sql,
    template_id, family, func, slot_cols, lits).
    """
    templates = classify_templates(drop_id_templates(templates))
    if split is not None:
        templates = templates.filter(F.col("split") == ("numeric" if split == "numeric" else "non_numeric"))
    compiled = compile_templates(templates)
    fields = ["template_id", "family", "func", "slots", "places", "parts", "needs_number"]
    every = compiled.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("every")).scalar()
    tables = compute_once(tables, numeric_cols=numeric_positions(F.col("header"), F.col("rows"))).withColumn("every", every)
    table_id, header, rows, numbers = (F.col(c) for c in ("table_id", "header", "rows", "numeric_cols"))

    def finished(t, columns):
        bound = F.forall(columns, lambda c: c.isNotNull())
        return let(literal_values(t, columns, table_id, rows, seed), lambda lits: F.when(
            bound & F.forall(lits, lambda v: v.isNotNull()),
            F.struct(
                sql_text(t, columns, lits, header, F.col(table_name)).alias("sql"), t["template_id"].alias("template_id"), t["family"].alias("family"),
                t["func"].alias("func"), columns.alias("slot_cols"), lits.alias("lits"),
            ),
        ))

    usable = F.filter("every", lambda t: ~t["needs_number"] | (F.size(numbers) > 0))
    pairs = F.transform(usable, lambda t: let(slot_columns(t, table_id, header, numbers, seed), lambda columns: finished(t, columns)))
    ordered = compute_once(tables, ordered=F.array_sort(F.filter(pairs, lambda p: p.isNotNull())))
    # In order of text and template, a pair stays unless the one before it has its text.
    kept = F.filter("ordered", lambda p, i: F.coalesce(F.get(F.col("ordered"), i - 1)["sql"] != p["sql"], F.lit(True)))
    return compute_once(ordered, pairs=kept).drop("ordered", "every")


def _answered(bound: DataFrame) -> DataFrame:
    """The tables with `answered`: per pair template_id, sql, family, func and answer_rows."""

    def answered(p):
        found = answer(p["family"], p["func"], p["lits"], slotted(F.col("rows"), p["slot_cols"]))
        return F.struct(*[p[c].alias(c) for c in ("template_id", "sql", "family", "func")], F.array_sort(found).alias("answer_rows"))

    return compute_once(bound, answered=F.transform("pairs", answered)).drop("pairs", "numeric_cols")


def answers_in_record(bound: DataFrame) -> DataFrame:
    """One record per pair of `bound_in_record` that has an answer: the tables' other columns,
    the pair's fields and `answer_rows`, (row_no, value) in order. Pairs that fail or whose family
    is not known have none; `unanswered` gives them."""
    some = compute_once(_answered(bound), answered=F.filter("answered", lambda p: F.size(p["answer_rows"]) > 0))
    return some.select(*[c for c in some.columns if c != "answered"], F.inline("answered"))


def unanswered(bound: DataFrame) -> DataFrame:
    """table_id, template_id, family of the pairs without an answer."""
    none = F.filter("answered", lambda p: ~F.coalesce(F.size(p["answer_rows"]) > 0, F.lit(False)))
    return _answered(bound).select("table_id", F.inline(none)).select("table_id", "template_id", "family")
