"""Tables as one line of text, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sarani.functions.languages import COLUMN_MARKS, ROW_MARKS, language_of, translate_digits
from sarani.functions.once import let
from sarani.functions.text import strip_text

_EMPTY = "array<string>"


def linearise(header: Column, rows: Column, lang: str) -> Column:
    """`<column mark> h | h <row mark N> v | v ...` with row numbers in the language's digits."""
    code = language_of(lang)

    def line(row, i):
        number = translate_digits((i + 1).cast("string"), lang)
        return F.concat(F.lit(ROW_MARKS[code]), number, F.lit("> "), F.array_join(row, " | "))

    return F.array_join(
        F.concat(
            F.array(F.concat(F.lit(COLUMN_MARKS[code] + " "), F.array_join(header, " | "))),
            F.transform(rows, line),
        ),
        " ",
    )


def _after_blank(c: Column) -> Column:
    return F.substring(c, F.instr(c, " ") + 1, F.length(c))


def _transpose(grid: Column) -> Column:
    """Columns of a list of lists, cut to the shortest list."""

    def columns(g):
        width = F.array_min(F.transform(g, lambda r: F.size(r)))
        return F.when(
            width > 0,
            F.transform(
                F.sequence(F.lit(1), width),
                lambda j: F.array_join(F.transform(g, lambda r: strip_text(F.element_at(r, j))), " | "),
            ),
        )

    return F.coalesce(let(grid, columns), F.array().cast(_EMPTY))


def parse_linearised(c: Column, lang: str) -> Column:
    """Struct of rows, columns and cells of a linear table.

    The first word is dropped, the rest is split at the row mark and each piece
    loses its row number. Empty pieces go; what is then first is the header. Rows
    and cells are split at `|`, columns (header included) at ` | `. Text without a
    blank, or in a language without marks, gives three empty lists.
    """
    code = language_of(lang)
    none = F.array().cast(_EMPTY)
    if code not in ROW_MARKS:
        return F.struct(none.alias("rows"), none.alias("columns"), none.alias("cells"))
    mark = ROW_MARKS[code]
    pieces = F.split(_after_blank(c), mark, -1)
    pieces = F.transform(
        pieces, lambda p, i: F.when((i > 0) & F.contains(p, F.lit(" ")), _after_blank(p)).otherwise(p)
    )
    pieces = F.filter(pieces, lambda p: p != "")

    def parts(pieces):
        body = F.transform(
            F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))),
            lambda p: F.transform(F.split(p, r"\|", -1), strip_text),
        )
        return let(
            body,
            lambda b: F.struct(
                F.transform(b, lambda r: F.array_join(r, " | ")).alias("rows"),
                _transpose(F.transform(pieces, lambda p: F.split(p, r" \| ", -1))).alias("columns"),
                F.flatten(b).alias("cells"),
            ),
        )

    # `struct` of empty lists where there is nothing to parse.
    empty = F.struct(none.alias("rows"), none.alias("columns"), none.alias("cells"))
    return F.when(F.contains(c, F.lit(" ")), let(pieces, parts)).otherwise(empty)


def parse_by_language(c: Column, lang: Column) -> Column:
    """`parse_linearised` in the language whose code the column holds."""
    found = parse_linearised(c, "")
    for code in ROW_MARKS:
        found = F.when(lang == code, parse_linearised(c, code)).otherwise(found)
    return found


def linearise_by_language(header: Column, rows: Column, lang: Column) -> Column:
    """`linearise` in the language whose code the column holds; null for others."""
    found = F.lit(None).cast("string")
    for code in ROW_MARKS:
        found = F.when(lang == code, linearise(header, rows, code)).otherwise(found)
    return found
