"""HTML tables to rectangular tables, with native expressions and no shuffle."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from sarani.functions.once import compute_once, let
from sarani.functions.text import strip_text

# The table classes that are looked for, in this order.
TABLE_CLASSES = ("wikitable sortable", "wikitable collapsible", "wikitable collapsed")

# The named character references of the HTML standard, as the Python library lists them.
NAMED = {f"&{name}": char for name, char in html5.items() if name.endswith(";") and name.lower() != "amp;"}

# The largest spans of the HTML standard; larger ones are cut to them.
MAX_SPANS = {"colspan": 1000, "rowspan": 65534}

# The attributes of a tag: a quoted value may hold the end sign.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
_CELL_TAG = rf"<t[dh](?=[\s/>])({_ATTRIBUTES})>"
_CELL = rf"(?is){_CELL_TAG}.*?(?=<t[dh][\s/>]|</t[dh]\s*>|\z)"
_ROW = rf"(?is)<tr(?=[\s/>]){_ATTRIBUTES}>(.*?)(?=<tr[\s/>]|</tr\s*>|\z)"
_CLASS = (
    r"""(?is)\A<table(?=\s)(?:[^>="']|=\s*"[^"]*"|=\s*'[^']*'|=)*?\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
)
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def _first_group(c: Column, pattern: str, groups: int) -> Column:
    return F.concat(*[F.regexp_extract(c, pattern, g) for g in range(1, groups + 1)])


def _levels(tags: Column) -> Column:
    """How many tables are open after each tag: +1 for an opening tag, -1 for a closing one.

    A closing tag without an open table counts nothing.
    """
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("levels"))

    def step(state, tag):
        return let(F.greatest(state["open"] + tag["step"], F.lit(0)), lambda n: F.struct(n.alias("open"), F.concat(state["levels"], F.array(n)).alias("levels")))

    return F.aggregate(tags, start, step)["levels"]


def select_tables(pages: DataFrame, classes: tuple[str, ...] = TABLE_CLASSES) -> DataFrame:
    """The first table of each class per page: class_name, table_no and the table's own html.

    Tables that stand inside another table are left out of its html, and can be selected
    themselves. Tables that are never closed come with a `reason`.
    """
    clean = F.regexp_replace("html", _HIDDEN, " ")
    # Each part begins with a tag that opens or closes a table.
    parts = F.filter(F.split(clean, r"(?i)(?=</?table[\s>])", -1), lambda p: p.rlike(r"(?i)\A</?table[\s>]"))
    opens = lambda p: F.lower(F.substring(p, 1, 6)) == "<table"
    tags = F.transform(
        parts,
        lambda p: F.struct(
            F.when(opens(p), F.trim(F.regexp_replace(_first_group(p, _CLASS, 3), r"\s+", " "))).alias("class_name"),
            F.when(opens(p), 1).otherwise(-1).alias("step"),
            p.alias("part"),
        ),
    )
    found = F.array(
        *[
            F.struct(
                F.lit(name).alias("class_name"),
                F.lit(i).alias("table_no"),
                F.array_position(F.transform("_tags", lambda t: t["class_name"]), name).alias("at"),
            )
            for i, name in enumerate(classes)
        ]
    )
    keep = [c for c in pages.columns if c != "html"]
    scanned = compute_once(compute_once(pages, _tags=tags), _levels=_levels(F.col("_tags")))
    rows = scanned.withColumn("_t", F.explode(F.filter(found, lambda t: t["at"] > 0))).select(
        *keep, "_t.class_name", "_t.table_no", "_tags", "_levels", F.col("_t.at").cast("int").alias("_at")
    )
    level = F.get("_levels", F.col("_at") - 1)
    # The table ends at the first tag that leaves fewer tables open than it did.
    ends = F.filter(F.sequence(F.col("_at"), F.size("_tags")), lambda j: (j > F.col("_at")) & (F.get("_levels", j - 1) < level))
    rows = compute_once(rows, _end=F.get(ends, F.lit(0)))
    own = F.filter(F.sequence(F.col("_at"), F.col("_end") - 1), lambda j: F.get("_levels", j - 1) == level)
    text = F.transform(own, lambda j: F.regexp_replace(F.get("_tags", j - 1)["part"], r"(?i)\A</table\s*+>?", " "))
    return compute_once(
        rows,
        table_html=F.coalesce(F.array_join(text, ""), F.lit("")),
        reason=F.when(F.col("_end").isNull(), F.lit("open_table")),
    ).drop("_tags", "_levels", "_at", "_end")


def cell_text(c: Column) -> Column:
    """Visible text of a cell: tags dropped, character references decoded, stripped."""
    text = F.regexp_replace(c, f"<{_ATTRIBUTES}>", "")

    def decode(t: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(?!0*38;|[xX]0*26;)(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
        names = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&(?!(?i:amp);)[A-Za-z][A-Za-z0-9]{1,31};"), F.lit(0)))

        def one(acc, ref):
            digits = F.regexp_extract(ref, "[0-9a-fA-F]+(?=;)", 0)
            code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("int")
            char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
            valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
            return F.when(valid, F.replace(acc, ref, char)).otherwise(acc)

        known = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
        t = F.aggregate(refs, t, one)
        t = F.aggregate(names, t, lambda acc, ref: F.replace(acc, ref, F.coalesce(F.try_element_at(known, ref), ref)))
        # The ampersand last, so that nothing is decoded twice.
        return F.regexp_replace(t, r"&(?:(?i:amp)|#0*38|#[xX]0*26);", "&")

    return let(text, lambda t: strip_text(F.when(F.contains(t, F.lit("&")), decode(t)).otherwise(t)))


def _span(attrs: Column, name: str) -> Column:
    """A span within its bounds; 0 rows reach to the end, 0 columns are one; null if not a number."""
    found, most = rf"(?i)(?:\A|[\s\"'/]){name}\s*=", MAX_SPANS[name]
    value = F.regexp_extract(attrs, found + r"""\s*["']?\s*([^"'\s>]*)""", 1)
    number = F.when(value.rlike(r"\A[0-9]+\z"), F.least(F.coalesce(value.try_cast("int"), F.lit(most)), F.lit(most)))
    number = F.when(number == 0, F.lit(most if name == "rowspan" else 1)).otherwise(number)
    return F.when(attrs.rlike(found), number).otherwise(F.lit(1))


def parse_cells(table_html: Column) -> Column:
    """Rows of cells: array<array<struct<text, colspan, rowspan>>>; a bad span is null."""

    tag = rf"(?is)\A{_CELL_TAG}"

    def cell(c):
        attrs = F.regexp_extract(c, tag, 1)
        return let(attrs, lambda attrs: F.struct(
            cell_text(F.regexp_replace(c, tag, "")).alias("text"), _span(attrs, "colspan").alias("colspan"), _span(attrs, "rowspan").alias("rowspan"),
        ))

    def cells(row):
        return F.transform(F.regexp_extract_all(row, F.lit(_CELL), F.lit(0)), cell)

    return F.transform(F.regexp_extract_all(table_html, F.lit(_ROW), F.lit(1)), cells)


def expand_colspan(cells: Column) -> Column:
    """Each cell repeated over its columns: array<struct<text, rowspan>>."""
    return F.flatten(
        F.transform(
            cells,
            lambda c: F.array_repeat(
                F.struct(c["text"].alias("text"), c["rowspan"].alias("rowspan")), c["colspan"]
            ),
        )
    )


def _rank(flags: Column, i: Column, wanted) -> Column:
    """How many of the first i + 1 entries satisfy `wanted`."""
    return F.size(F.filter(F.slice(flags, F.lit(1), i + 1), wanted))


def flatten_header(rows: Column) -> Column:
    """Struct of header texts, number of header rows, and whether the header is sound.

    While a header cell spans further rows, the next row is header too and its texts
    are added in brackets to the columns that do not span it.
    """
    def step(state, row):
        spans = state["spans"]

        def after(child):
            def own(i):
                return F.try_element_at(child, _rank(spans, i, lambda v: v == 1))

            texts = F.transform(
                state["texts"],
                lambda t, i: F.when(
                    F.get(spans, i) == 1, F.concat(t, F.lit(" ("), own(i)["text"], F.lit(")"))
                ).otherwise(t),
            )
            left = F.transform(
                spans,
                lambda v, i: F.when(v > 1, v - 1).otherwise(F.when(v == 1, own(i)["rowspan"]).otherwise(v)),
            )
            enough = F.size(child) >= F.size(F.filter(spans, lambda v: v == 1))
            return F.struct(
                texts.alias("texts"), left.alias("spans"), (state["used"] + 1).alias("used"), enough.alias("ok")
            )

        more = state["ok"] & (F.array_max(spans) > 1)
        return F.when(more, let(expand_colspan(row), after)).otherwise(state)

    def start(first):
        return F.struct(
            F.transform(first, lambda c: c["text"]).alias("texts"),
            F.transform(first, lambda c: c["rowspan"]).alias("spans"),
            F.lit(1).alias("used"),
            F.lit(True).alias("ok"),
        )

    rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    end = let(
        let(expand_colspan(F.get(rows, F.lit(0))), start),
        lambda s: F.when(F.array_max(s["spans"]) > 1, F.aggregate(rest, s, step)).otherwise(s),
    )
    return let(
        end,
        lambda e: F.struct(
            e["texts"].alias("header"),
            e["used"].alias("header_rows"),
            (e["ok"] & (F.array_max(e["spans"]) <= 1)).alias("ok"),
        ),
    )


def fill_rowspan(body: Column, width: Column) -> Column:
    """Body rows as texts, with spanning cells repeated in the rows below them.

    A row that does not fill the grid keeps its own, different width.
    """
    blank = F.struct(F.lit("").alias("text"), F.lit(0).alias("left"))
    start = F.struct(
        F.array().cast("array<array<string>>").alias("out"),
        F.array_repeat(blank, width).alias("carry"),
    )

    def step(state, row):
        carry = state["carry"]
        cells = F.transform(
            expand_colspan(row),
            lambda c: F.struct(c["text"].alias("text"), F.greatest(c["rowspan"] - 1, F.lit(0)).alias("left")),
        )

        def place(cells):
            return F.transform(
                carry,
                lambda c, i: F.when(
                    c["left"] > 0, F.struct(c["text"].alias("text"), (c["left"] - 1).alias("left"))
                ).otherwise(F.try_element_at(cells, _rank(carry, i, lambda x: x["left"] == 0))),
            )

        def after(cells, placed):
            free = F.size(F.filter(carry, lambda c: c["left"] == 0))
            extra = F.slice(cells, free + 1, F.greatest(F.size(cells) - free, F.lit(0)))
            texts = F.transform(
                F.concat(F.filter(placed, lambda c: c.isNotNull()), extra), lambda c: c["text"]
            )
            return F.struct(
                F.concat(state["out"], F.array(texts)).alias("out"),
                F.transform(placed, lambda c: F.coalesce(c, blank)).alias("carry"),
            )

        return let(cells, lambda c: let(place(c), lambda p: after(c, p)))

    spans = F.exists(body, lambda r: F.exists(r, lambda c: c["rowspan"] > 1))
    plain = F.transform(body, lambda r: F.transform(expand_colspan(r), lambda c: c["text"]))
    return F.when(spans, F.aggregate(body, start, step)["out"]).otherwise(plain)


def parse_tables(selected: DataFrame) -> DataFrame:
    """Selected tables to header and rows; tables that cannot be read keep a `reason`.

    Body rows of another width than the header are left out and counted.
    """
    df = compute_once(selected, _rows=parse_cells(F.col("table_html"))).drop("table_html")
    bad_span = F.exists(
        "_rows", lambda r: F.exists(r, lambda c: c["colspan"].isNull() | c["rowspan"].isNull())
    )
    reason = F.coalesce(
        "reason",
        F.when(F.size("_rows") == 0, F.lit("no_rows")).when(bad_span, F.lit("bad_span"))
        .when(F.size(F.get("_rows", F.lit(0))) == 0, F.lit("no_header")),
    )
    df = compute_once(df, reason=reason)
    df = compute_once(df, _head=F.when(F.col("reason").isNull(), flatten_header(F.col("_rows"))))
    sound = F.coalesce(F.col("_head.ok"), F.lit(False))
    df = compute_once(
        df, reason=F.coalesce("reason", F.when(~sound, F.lit("bad_header"))), header=F.when(sound, F.col("_head.header")),
    )
    used = F.col("_head.header_rows")
    body = F.slice("_rows", used + 1, F.greatest(F.size("_rows") - used, F.lit(0)))
    grid = let(body, lambda b: fill_rowspan(b, F.size("header")))
    df = compute_once(df, _grid=F.when(F.col("reason").isNull(), grid)).drop("_rows", "_head")
    return compute_once(df, rows=F.filter("_grid", lambda r: F.size(r) == F.size("header"))).withColumn(
        "ragged_rows", F.size("_grid") - F.size("rows")
    ).drop("_grid")
