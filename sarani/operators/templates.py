"""Query templates: classes, pairing with tables, binding and rendering.

Everything after the pairing is a narrow expression over the pair's own record, which
carries the whole table (at most MAX_CELLS cells) as the finished sample does.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sarani.functions.once import compute_once
from sarani.functions.text import hash_pick
from sarani.operators.tables import numeric_positions
from sarani.session import is_small

TOKEN = "array<struct<kind:string,value:string>>"
TEMPLATE = f"template_id int, family string, func string, tokens {TOKEN}"

# Slot names that ask for a numeric column hold one of these.
NUMERIC_TYPES = ("number",)

# Functions that are written without blanks up to their bracket.
AGGREGATES = ("count", "sum", "min", "max", "avg", "abs", "subtract")

# Most templates that travel as one array; more are joined.
ARRAY_TEMPLATES = 20_000
TEMPLATE_SALTS = 64


def _t(template_id: int, family: str, text: str, func: str = "") -> dict:
    """One template from text: c1, c2_number are columns, L is a literal, w the table."""

    def token(word):
        kind = "Column" if word[:1] == "c" and word[1:2].isdigit() else "Keyword"
        return {"kind": "Literal.String", "value": "literal"} if word == "L" else {"kind": kind, "value": word}

    return {
        "template_id": template_id, "family": family, "func": func,
        "tokens": [token(w) for w in text.split()],
    }


TEMPLATES = [
    _t(1, "project_where", "select c1 from w where c2 = L"),
    _t(2, "project_where", "select abs ( c1_number ) from w where c2 = L", "abs"),
    _t(3, "count_where", "select count ( c1 ) from w where c2 = L"),
    _t(4, "count_distinct", "select count ( distinct c1 ) from w"),
    _t(5, "numeric_agg", "select sum ( c1_number ) from w where c2 = L", "sum"),
    _t(6, "numeric_agg", "select min ( c1_number ) from w where c2 = L", "min"),
    _t(7, "numeric_agg", "select max ( c1_number ) from w where c2 = L", "max"),
    _t(8, "numeric_agg", "select avg ( c1_number ) from w where c2 = L", "avg"),
    _t(9, "superlative", "select c1 from w order by c2_number desc limit 1"),
    _t(10, "most_frequent", "select c1 from w group by c1 order by count ( * ) desc limit 1"),
    _t(11, "between", "select c1 from w where c2_number between L and L"),
    _t(12, "like", "select c1 from w where c2 like L"),
    _t(13, "difference",
       "select ( select c1_number from w where c2 = L ) - ( select c1_number from w where c2 = L )"),
    _t(14, "in_subquery", "select c1 from w where c2 in ( select c2 from w where c3 = L )"),
    _t(15, "set_operation", "select c1 from w where c2 = L union select c1 from w where c3 = L", "union"),
    _t(16, "set_operation", "select c1 from w where c2 = L intersect select c1 from w where c3 = L",
       "intersect"),
    _t(17, "set_operation", "select c1 from w where c2 = L except select c1 from w where c3 = L", "except"),
    _t(18, "project_where", "select c1 from w where id = L"),
    _t(19, "most_frequent", "select c1 from w group by c1 order by count ( * ) desc limit 1"),
    _t(20, "bool_where", "select c1 from w where c2 = L and c3 = L", "and"),
    _t(21, "bool_where", "select c1 from w where c2 = L or c3 = L", "or"),
    _t(22, "bool_where", "select c1 from w where not c2 = L", "not"),
    _t(23, "not_in", "select c1 from w where c2 not in ( select c2 from w where c3 = L )"),
    _t(24, "lowest_k", "select c1 from w order by c2_number asc limit 3"),
    _t(25, "group_agg", "select sum ( c1_number ) from w group by c2", "sum"),
    _t(26, "group_agg", "select count ( * ) from w group by c1", "count"),
    _t(27, "having", "select c1 from w group by c1 having count ( * ) > 1"),
    _t(28, "subtract", "select subtract ( c1_number , c2_number ) from w where c3 = L"),
]


def template_list(spark: SparkSession, families: tuple[str, ...] | None = None) -> DataFrame:
    """The built-in templates, optionally of some families only."""
    chosen = [t for t in TEMPLATES if not families or t["family"] in families]
    data = F.from_json(F.lit(json.dumps(chosen)), f"array<struct<{TEMPLATE.replace(' int', ':int').replace(' string', ':string').replace('tokens ', 'tokens:')}>>")
    return spark.range(1).select(F.inline(data))


def _is_column(t: Column) -> Column:
    return (t["kind"] == "Column") & (t["value"] != "w")


def _is_literal(t: Column) -> Column:
    return F.contains(t["kind"], F.lit("Literal")) & (t["value"] != "w")


def classify_templates(templates: DataFrame) -> DataFrame:
    """`split` is numeric when a column token's text holds `number`."""
    numeric = F.exists(
        "tokens", lambda t: (t["kind"] == "Column") & F.contains(t["value"], F.lit("number"))
    )
    return templates.withColumn(
        "split", F.when(numeric, F.lit("numeric")).otherwise(F.lit("non_numeric"))
    )


def is_numeric_slot(slot: Column, types: tuple[str, ...] = NUMERIC_TYPES) -> Column:
    """Whether the slot's text holds the name of a numeric type."""
    return F.exists(F.array(*[F.lit(t) for t in types]), lambda t: F.contains(slot, t))


def drop_id_templates(templates: DataFrame) -> DataFrame:
    """Templates whose text does not hold ` id `."""
    text = F.array_join(F.transform("tokens", lambda t: t["value"]), " ")
    return templates.filter(~F.contains(text, F.lit(" id ")))


def compile_templates(templates: DataFrame) -> DataFrame:
    """What the binding of a template needs, worked out once per template and not per pair.

    `slots`: its distinct column names. `places`: per literal its token position and the slot
    last seen before it (-1: none). `parts`: the pieces of its SQL text, each with the text in
    front of it, blanks included, and the slot or literal it stands for; there are no blanks
    from an aggregate's name to the next closing bracket.
    """
    tokens = F.col("tokens")
    slots = F.array_distinct(F.transform(F.filter(tokens, _is_column), lambda t: t["value"]))
    slot_of = lambda name: (F.array_position(F.col("slots"), name) - 1).cast("int")

    def place(i):
        seen = F.filter(F.slice(tokens, F.lit(1), i), _is_column)
        last = F.try_element_at(seen, F.lit(-1))["value"]
        return F.struct(i.alias("at"), F.coalesce(slot_of(last), F.lit(-1)).alias("slot"))

    places = F.transform(F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: _is_literal(F.get(tokens, i))), place)

    def step(state, t):
        kind = F.when(t["value"] == "w", "table").when(t["kind"] == "Column", "column").when(_is_literal(t), "literal").otherwise("text")
        lead = F.when(state["open"] | (F.size(state["out"]) == 0), F.lit("")).otherwise(F.lit(" "))
        number = F.when(kind == "column", slot_of(t["value"])).when(kind == "literal", state["literals"]).otherwise(F.lit(-1))
        part = F.struct(F.concat(lead, F.when(kind == "text", t["value"]).otherwise("")).alias("text"), kind.alias("kind"), number.cast("int").alias("number"))
        is_open = F.when(state["open"], t["value"] != ")").otherwise((kind == "text") & t["value"].isin(*AGGREGATES))
        return F.struct(
            is_open.alias("open"), (state["literals"] + (kind == "literal").cast("int")).alias("literals"), F.concat(state["out"], F.array(part)).alias("out")
        )

    start = F.struct(
        F.lit(False).alias("open"), F.lit(0).alias("literals"), F.array().cast("array<struct<text:string,kind:string,number:int>>").alias("out")
    )
    needs = F.exists(tokens, lambda t: _is_column(t) & is_numeric_slot(t["value"]))
    return templates.withColumn("slots", slots).withColumn("places", places).withColumn("parts", F.aggregate(tokens, start, step)["out"]).withColumn("needs_number", needs)


def pair(tables: DataFrame, templates: DataFrame, split: str | None = None) -> DataFrame:
    """Every table with every template of the split, or of all splits for None.

    Any split name but `numeric` means `non_numeric`. Templates that need a numeric
    column skip the tables without one: they could not be bound.
    """
    templates = classify_templates(drop_id_templates(templates))
    if split is not None:
        wanted = "numeric" if split == "numeric" else "non_numeric"
        templates = templates.filter(F.col("split") == wanted)
    templates = compile_templates(templates)
    tables = compute_once(tables, numeric_cols=numeric_positions(F.col("header"), F.col("rows")))
    fields = ["template_id", "family", "func", "tokens", "split", "needs_number", "slots", "places", "parts"]
    has_number = F.size("numeric_cols") > 0
    if is_small(templates, ARRAY_TEMPLATES):
        array = templates.agg(
            F.array_sort(F.collect_list(F.struct(*fields))).alias("_all")
        ).scalar()
        every = tables.withColumn("_all", array).select(*tables.columns, F.inline("_all"))
        out = every.filter(~F.col("needs_number") | has_number)
    else:
        # Each table visits every salt, each template lies in one of them.
        salted = tables.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TEMPLATE_SALTS - 1))))
        spread = templates.select(*fields, F.pmod("template_id", F.lit(TEMPLATE_SALTS)).alias("_salt"))
        out = salted.join(spread, "_salt").filter(~F.col("needs_number") | has_number)
        out = out.select(*tables.columns, *fields)
    return out.drop("needs_number")


def bind_columns(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """A column for each distinct slot: `slots` and `slot_cols` (0-based positions).

    Numeric slots take a numeric column, others any; pairs without a candidate go.
    The choice follows from seed, table, template and slot.
    """
    chosen = slot_columns(F.struct("template_id", "slots"), F.col("table_id"), F.col("header"), F.col("numeric_cols"), seed)
    return compute_once(pairs, slot_cols=chosen).filter(F.forall("slot_cols", lambda c: c.isNotNull()))


def slot_columns(t: Column, table_id: Column, header: Column, numeric_cols: Column, seed: int) -> Column:
    """A column position per slot of a compiled template; null without a candidate."""

    def choose(slot):
        pick = lambda n: hash_pick(n, str(seed), table_id, t["template_id"].cast("string"), slot)
        of_numbers = F.get(numeric_cols, pick(F.size(numeric_cols)).cast("int"))
        return F.when(is_numeric_slot(slot), of_numbers).otherwise(pick(F.size(header)).cast("int"))

    return F.transform(t["slots"], choose)


def bind_literals(bound: DataFrame, seed: int = 42) -> DataFrame:
    """`lits`: for each literal a value of the column last seen before it.

    The row follows from seed, table, template and token position; pairs with a literal
    before any column, or with an empty table, go.
    """
    values = literal_values(F.struct("template_id", "places"), F.col("slot_cols"), F.col("table_id"), F.col("rows"), seed)
    return compute_once(bound, lits=values).filter(F.forall("lits", lambda v: v.isNotNull()))


def literal_values(t: Column, slot_cols: Column, table_id: Column, rows: Column, seed: int) -> Column:
    """A cell per literal of a compiled template; null where there is none."""

    def value(p):
        row = hash_pick(F.size(rows), str(seed), table_id, t["template_id"].cast("string"), p["at"].cast("string"))
        return F.get(F.get(rows, row.cast("int")), F.get(slot_cols, p["slot"]))

    return F.transform(t["places"], value)


def render_sql(bound: DataFrame, table_name: str = "table_id") -> DataFrame:
    """`sql`: names in backticks, literals in double quotes, both doubled inside, and no
    blanks from an aggregate's name to the next closing bracket."""
    return compute_once(bound, sql=sql_text(F.struct("parts"), F.col("slot_cols"), F.col("lits"), F.col("header"), F.col(table_name)))


def sql_text(t: Column, slot_cols: Column, lits: Column, header: Column, table_name: Column) -> Column:
    """The SQL text of a compiled template with its columns and literals."""
    quoted = lambda mark, c: F.concat(F.lit(mark), F.replace(c, F.lit(mark), F.lit(mark * 2)), F.lit(mark))

    def piece(p):
        name = F.when(p["kind"] == "table", table_name).otherwise(F.get(header, F.get(slot_cols, p["number"])))
        own = F.when(p["kind"] == "text", F.lit("")).when(p["kind"] == "literal", quoted('"', F.get(lits, p["number"]))).otherwise(quoted("`", name))
        return F.concat(p["text"], own)

    return F.array_join(F.transform(t["parts"], piece), "")


def bind(tables: DataFrame, templates: DataFrame, split: str | None = None, seed: int = 42) -> DataFrame:
    """Pair, bind columns and literals."""
    return bind_literals(bind_columns(pair(tables, templates, split), seed), seed)
