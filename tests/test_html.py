import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from sarani.operators import html
from sarani.operators.tables import quarantine


def parse(spark, body, cls="wikitable sortable"):
    page = f'<p>x</p><table class="{cls}">{body}</table>'
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    return html.parse_tables(html.select_tables(df)).first()


def grid_by_hand(rows):
    """The grid rule of HTML, cell by cell, for rows of (text, colspan, rowspan)."""
    grid, held = [], {}
    for row in rows:
        line, cells, col = {}, list(row), 0
        for c, (text, left) in list(held.items()):
            line[c] = text
            held[c] = (text, left - 1)
            if left == 1:
                del held[c]
        for text, colspan, rowspan in cells:
            for _ in range(colspan):
                while col in line:
                    col += 1
                line[col] = text
                if rowspan > 1:
                    held[col] = (text, rowspan - 1)
        grid.append([line[c] for c in sorted(line)])
    return grid


def as_html(rows, tag="td"):
    def cell(text, colspan, rowspan):
        return f'<{tag} colspan="{colspan}" rowspan={rowspan}>{text}</{tag}>'

    return "".join("<tr>" + "".join(cell(*c) for c in row) + "</tr>" for row in rows)


def test_first_table_of_each_class(spark):
    page = (
        '<!-- <table class="wikitable sortable"><tr><td>no</td></tr></table> -->'
        '<table class="plain"><tr><td>p</td></tr></table>'
        "<TABLE id=a class='wikitable  sortable'><tr><td>first</td></tr></TABLE>"
        '<table class="wikitable sortable"><tr><td>second</td></tr></table>'
        '<table class="wikitable collapsed"><tr><td><table><tr><td>in</td></tr></table></td></tr></table>'
        '<table class="wikitable sortable extra"><tr><td>third</td></tr></table>'
    )
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    got = {r.class_name: (r.table_html, r.reason) for r in html.select_tables(df).collect()}
    assert set(got) == {"wikitable sortable", "wikitable collapsed"}
    assert "first" in got["wikitable sortable"][0] and got["wikitable sortable"][1] is None
    assert "in" not in html_text(got["wikitable collapsed"][0]) and got["wikitable collapsed"][1] is None


def html_text(text):
    return re.sub("<[^>]*>", "", text)


class Reader(HTMLParser):
    """Own text of every table by the parser of the standard library, and whether it was closed."""

    def __init__(self, page):
        super().__init__()
        self.tables, self.stack = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.stack.append({"class": " ".join(dict(attrs).get("class", "").split()), "text": "", "closed": False})
            self.tables.append(self.stack[-1])

    def handle_endtag(self, tag):
        if tag == "table" and self.stack:
            self.stack.pop()["closed"] = True

    def handle_data(self, data):
        if self.stack:
            self.stack[-1]["text"] += data


def test_nested_tables_against_a_parser(spark):
    """Random tables in tables, closed or not, stray closing tags, between texts."""
    rng, pages = random.Random(5), []
    for k in range(120):
        page = ""
        for i in range(rng.randrange(14)):
            name = rng.choice([*html.TABLE_CLASSES, "plain", "wikitable  sortable"])
            page += rng.choice([f'<table class="{name}">', f"<TABLE id=x class='{name}' >", "</table>", "</TABLE >", "</table\n>", f"<tr><td>c{k}x{i}</td></tr>", f"t{i}"])
        pages.append((k, page))
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = {(r.page_id, r.class_name): r for r in html.select_tables(df).collect()}
    want = {}
    for k, page in pages:
        for t in Reader(page).tables:
            if t["class"] in html.TABLE_CLASSES:
                want.setdefault((k, t["class"]), t)
    assert set(got) == set(want) and len(want) > 100
    for key, t in want.items():
        assert (got[key].reason is None) == t["closed"]
        if t["closed"]:
            assert html_text(got[key].table_html).split() == t["text"].split() or html_text(got[key].table_html).replace(" ", "") == t["text"].replace(" ", "")


def test_rows_of_an_inner_table_stay_out(spark):
    inner = "<table class='wikitable collapsed'><tr><th>k</th></tr><tr><td>x</td></tr></table>"
    got = parse(spark, f"<tr><th>a</th><th>b</th></tr><tr><td>1</td><td>{inner}</td></tr><tr><td>2{inner} end</td><td>3</td></tr>")
    assert (got.header, got.rows, got.ragged_rows) == (["a", "b"], [["1", ""], ["2  end", "3"]], 0)
    page = f'<table class="wikitable sortable"><tr><td>{inner}</td></tr>'
    rows = html.select_tables(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "</table>")], "page_id int, html string")).collect()
    assert {(r.page_id, r.class_name, r.reason) for r in rows} == {(1, "wikitable sortable", "open_table"), (1, "wikitable collapsed", None)}


def test_header_of_three_rows(spark):
    head = (
        "<tr><th rowspan=3>a</th><th colspan=3>b</th></tr>"
        "<tr><th rowspan=2>c</th><th colspan=2>d</th></tr>"
        "<tr><th>e</th><th> f </th></tr>"
    )
    row = parse(spark, head + "<tr><td>1</td><td>2</td><td>3</td><td>4</td></tr>")
    assert row.header == ["a", "b (c)", "b (d) (e)", "b (d) (f)"]
    assert row.rows == [["1", "2", "3", "4"]] and row.ragged_rows == 0


def test_header_with_too_few_child_cells_is_quarantined(spark):
    row = parse(spark, "<tr><th rowspan=2>a</th><th>b</th><th>c</th></tr><tr><th>d</th></tr>")
    assert row.reason == "bad_header" and row.header is None


def test_overlapping_spans_follow_the_grid_rule(spark):
    rows = [
        [("a", 1, 2), ("b", 2, 3), ("c", 1, 1)],
        [("d", 1, 2)],
        [("e", 1, 1)],
        [("f", 2, 1), ("g", 1, 1), ("h", 1, 1)],
    ]
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in "wxyz") + "</tr>"
    got = parse(spark, head + as_html(rows))
    assert got.rows == grid_by_hand(rows)
    assert got.rows[1] == ["a", "b", "b", "d"] and got.rows[2] == ["e", "b", "b", "d"]


def test_ragged_rows_go_and_are_counted(spark):
    head = "<tr><th>a</th><th>b</th></tr>"
    got = parse(spark, head + "<tr><td>1</td></tr><tr><td>1</td><td>2</td></tr><tr><td>1</td><td>2</td><td>3</td></tr>")
    assert got.rows == [["1", "2"]] and got.ragged_rows == 2


def test_cell_text(spark):
    text = "<td> <a href='x'>A&amp;B</a>&nbsp;&#2476;&#38;lt; &lt;i&gt; </td>"
    got = spark.range(1).select(html.cell_text(F.lit(text))).first()[0]
    assert got == "A&B ব&lt; <i>" or got == "A&B ব&lt; <i>"


def test_unclosed_cells_and_rows(spark):
    got = parse(spark, "<tr><th>a<th>b<tr><td>1<td>2<tr><td>3<td>4")
    assert got.header == ["a", "b"] and got.rows == [["1", "2"], ["3", "4"]]


def test_quarantine_splits_completely(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "id int, v string")
    good, bad = quarantine(df, {"missing": F.col("v").isNull(), "empty": F.col("v") == ""})
    assert [r.id for r in good.collect()] == [1]
    assert {(r.id, r.reason) for r in bad.collect()} == {(2, "missing"), (3, "empty")}


def test_quoted_signs_and_other_attributes(spark):
    body = (
        '<tr><th title="x>y" data-colspan=3>a</th><th>b</th></tr>'
        '<tr><td data-rowspan="2" title=\'a > b\'>1</td><td>2</td></tr><tr class="r>s"><td>3</td><td>4</td></tr>'
    )
    got = parse(spark, body)
    assert (got.header, got.rows, got.ragged_rows) == (["a", "b"], [["1", "2"], ["3", "4"]], 0)
    page = '<table title="a > class=\'wikitable\'" class="wikitable sortable"><tr><th>h</th></tr></table>'
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert html.select_tables(df).first().class_name == "wikitable sortable"


def test_spans_of_zero_and_beyond_the_limit(spark):
    body = (
        '<tr><th>a</th><th>b</th></tr><tr><td rowspan=0>x</td><td colspan="0">1</td></tr>'
        "<tr><td>2</td></tr><tr><td>3</td></tr>"
    )
    assert parse(spark, body).rows == [["x", "1"], ["x", "2"], ["x", "3"]]
    for span in ("99999", "99999999999999"):
        body = f"<tr><th>a</th><th>b</th></tr><tr><td rowspan={span}>x</td><td>1</td></tr><tr><td>2</td></tr>"
        assert parse(spark, body).rows == [["x", "1"], ["x", "2"]]
    assert parse(spark, "<tr><th>a</th></tr><tr><td rowspan=two>x</td></tr>").reason == "bad_span"


def test_character_references(spark):
    cells = {
        "A&#x41;&eacute;&#65;": "AAéA", "&amp;lt;": "&lt;", "&#38;lt; &#x26;gt;": "&lt; &gt;", "&nosuch; &CounterClockwiseContourIntegral;": "&nosuch; ∳",
        "a&nbsp;": "a", "&#0;&#xD800;": "&#0;&#xD800;",
    }
    df = spark.createDataFrame([(k,) for k in cells], "c string")
    assert {r.c: r.t for r in df.select("c", html.cell_text(F.col("c")).alias("t")).collect()} == cells
