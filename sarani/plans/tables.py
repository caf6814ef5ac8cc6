"""HTML tables to the corpus, and the operators on the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sarani.functions.text import strip_text
from sarani.operators import html
from sarani.operators.tables import (
    fan_out_rows, max_cells, name_tables, numeric_columns, quarantine, rectangular, title_index, to_cells,
    to_tables, unique_tables,
)
from sarani.plans.checks import CORPUS
from sarani.plans.corpus_job import build_corpus, corpus_rejects, parsed_tables
from sarani.plans.registry import query
from sarani.sources.star import corpus_tables, html_pages, load, nested_pages, rows_to_tables

# What the pages of `html_pages` hold, stated without any HTML.
_PAGES = """
members AS (
  SELECT c_custkey // 30 AS page_id, c_custkey, c_mktsegment, CAST(c_acctbal AS VARCHAR) || ' & up' AS balance,
         ROW_NUMBER() OVER (PARTITION BY c_custkey // 30 ORDER BY c_mktsegment, c_custkey) - 1 AS row_no
  FROM customer
),
segments AS (
  SELECT page_id, c_mktsegment, COUNT(*) AS n,
         ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY c_mktsegment) - 1 AS row_no
  FROM members GROUP BY page_id, c_mktsegment
),
page_tables AS (
  SELECT page_id, 0 AS table_no, 'wikitable sortable' AS class_name, COUNT(*) AS n_rows,
         'segment ' || page_id || ' | account (id) | account (balance)' AS header
  FROM members GROUP BY page_id
  UNION ALL
  SELECT page_id, 1, 'wikitable collapsible', COUNT(*), 'a | b | n ' || page_id FROM segments GROUP BY page_id
  UNION ALL
  SELECT DISTINCT page_id, 2, 'wikitable collapsed', 1, 'k | v' FROM members WHERE page_id % 3 = 0
)"""


@query("html_select_tables", f"""
WITH {_PAGES}
SELECT page_id, class_name, table_no, CAST(CASE table_no WHEN 0 THEN n_rows + 2 WHEN 1 THEN n_rows + 1 ELSE 3 END AS INTEGER)
       AS n_row_tags FROM page_tables""")
def html_select_tables(spark, d):
    t = html.select_tables(html_pages(spark, d))
    return t.select(
        "page_id", "class_name", "table_no",
        F.size(F.regexp_extract_all("table_html", F.lit(r"(?i)<tr[\s>]"), F.lit(0))).alias("n_row_tags"),
    )


@query("html_nested_tables", """
WITH s AS (
  SELECT c_custkey // 30 AS page_id, c_mktsegment AS segment, COUNT(*) AS n, STRING_AGG(c_custkey, ';' ORDER BY c_custkey) AS keys
  FROM customer GROUP BY ALL)
SELECT page_id, 'wikitable sortable' AS class_name, 'segment | keys | n' AS header,
  STRING_AGG(segment || ' | see   below | ' || n, ';' ORDER BY segment) AS rows FROM s GROUP BY page_id
UNION ALL
SELECT page_id, 'wikitable collapsible', 'key', ARG_MIN(keys, segment) FROM s GROUP BY page_id""")
def html_nested_tables(spark, d):
    """Tables that hold tables: outer rows without the inner ones, and the first inner table of a class by itself."""
    t = html.parse_tables(html.select_tables(nested_pages(spark, d))).filter("reason IS NULL")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), ";")
    return t.select("page_id", "class_name", F.array_join("header", " | ").alias("header"), rows.alias("rows"))


@query("html_header_flatten", f"""
WITH {_PAGES} SELECT page_id, table_no, header FROM page_tables WHERE NOT (table_no = 2 AND page_id % 5 = 0)""")
def html_header_flatten(spark, d):
    t = html.select_tables(html_pages(spark, d))
    rows = t.withColumn("_rows", html.parse_cells(F.col("table_html")))
    head = rows.withColumn("_head", html.flatten_header(F.col("_rows")))
    good = ~F.exists("_rows", lambda r: F.exists(r, lambda c: c["colspan"].isNull()))
    return head.filter(good & F.col("_head.ok")).select(
        "page_id", "table_no", F.array_join("_head.header", " | ").alias("header")
    )


@query("html_colspan", f"""
WITH {_PAGES}
SELECT page_id, CAST(row_no AS INTEGER) AS row_no, c_mktsegment AS a, c_mktsegment AS b, CAST(n AS VARCHAR) AS n
FROM segments""")
def html_colspan(spark, d):
    t = html.select_tables(html_pages(spark, d)).filter("table_no = 1")
    body = F.transform(html.parse_cells(F.col("table_html")), lambda r: html.expand_colspan(r))
    rows = t.select("page_id", F.posexplode(body).alias("pos", "cells")).filter("pos > 0")
    return rows.select(
        "page_id", (F.col("pos") - 1).alias("row_no"),
        *[F.col("cells")[i]["text"].alias(name) for i, name in enumerate(("a", "b", "n"))],
    )


@query("html_rowspan", f"""
WITH {_PAGES}
SELECT page_id, CAST(row_no AS INTEGER) AS row_no, c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS id, balance
FROM members""")
def html_rowspan(spark, d):
    good, _ = parsed_tables(html_pages(spark, d))
    rows = good.filter("table_no = 0").select("page_id", F.posexplode("rows").alias("row_no", "r"))
    return rows.select(
        "page_id", "row_no", F.col("r")[0].alias("segment"), F.col("r")[1].alias("id"), F.col("r")[2].alias("balance")
    )


@query("table_rectangular", f"""
WITH {CORPUS}
SELECT table_id, CAST(n_rows AS INTEGER) AS n_rows FROM corpus
WHERE NOT (CAST(REGEXP_EXTRACT(table_id, '[0-9]+$') AS BIGINT) % 4 = 0 AND n_rows > 3)""")
def table_rectangular(spark, d):
    number = F.regexp_extract("table_id", "[0-9]+$", 0).cast("bigint")
    short = F.transform(
        "rows",
        lambda r, i: F.when((i == 3) & (number % 4 == 0), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r),
    )
    ragged = corpus_tables(spark, d).withColumn("rows", short)
    return rectangular(ragged).select("table_id", F.size("rows").alias("n_rows"))


@query("row_fan_out", f"""
WITH {CORPUS}
SELECT table_id, CAST(row_no * LEN(header) + k AS INTEGER) AS row_no, vals[1] AS first_value
FROM (SELECT *, UNNEST(RANGE(LEN(header))) AS k FROM corpus_rows)""")
def row_fan_out(spark, d):
    fanned = fan_out_rows(corpus_tables(spark, d))
    return fanned.select("table_id", F.posexplode("rows").alias("row_no", "r")).select(
        "table_id", "row_no", F.col("r")[0].alias("first_value")
    )


@query("table_size_filter", """
SELECT 'page_' || (c_custkey // 30) || c_mktsegment AS table_id, CAST(COUNT(*) AS INTEGER) AS n_rows
FROM customer GROUP BY c_custkey // 30, c_mktsegment HAVING COUNT(*) * 3 <= 18""")
def table_size_filter(spark, d):
    rows = load(spark, d, "customer").select(
        F.concat(F.lit("page_"), F.floor(F.col("c_custkey") / 30).cast("string"), "c_mktsegment").alias("table_id"),
        F.col("c_mktsegment").alias("title"),
        F.array(F.lit("id"), F.lit("name"), F.lit("balance")).alias("header"),
        F.col("c_custkey").alias("row_no"),
        F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string")).alias("values"),
    )
    return max_cells(rows_to_tables(rows), 18).select("table_id", F.size("rows").alias("n_rows"))


def _named_orders(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderpriority").alias("title"), "o_orderkey")
    return name_tables(o, "o_orderkey")


@query("table_naming", """
SELECT o_orderkey, o_orderpriority || '_' || (ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)
       AS table_name FROM orders""")
def table_naming(spark, d):
    return _named_orders(spark, d).select("o_orderkey", "table_name")


@query("table_dedup", "SELECT lang AS title, MIN(doc_id) AS doc_id FROM documents GROUP BY lang, text")
def table_dedup(spark, d):
    docs = load(spark, d, "documents").select(
        F.col("lang").alias("title"), "doc_id", F.array(F.lit("text")).alias("header"),
        F.array(F.array("text")).alias("rows"),
    )
    return unique_tables(docs, "doc_id").select("title", "doc_id")


@query("cells_explode", f"WITH {CORPUS} SELECT table_id, row_no, col_no, header, value FROM cells")
def cells_explode(spark, d):
    return to_cells(corpus_tables(spark, d))


@query("cells_implode", f"""
WITH {CORPUS}
SELECT table_id, ARRAY_TO_STRING(header, '|') AS header,
       ARRAY_TO_STRING(LIST_TRANSFORM(trows, LAMBDA r: ARRAY_TO_STRING(r, '|')), ';') AS content FROM corpus""")
def cells_implode(spark, d):
    t = to_tables(to_cells(corpus_tables(spark, d)))
    return t.select(
        "table_id", F.array_join("header", "|").alias("header"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("content"),
    )


ORDER_KEYS = 4096


def order_tables(spark, d):
    """The orders of each priority as tables of a range of `ORDER_KEYS` keys each, so that no record grows with the data."""
    o = load(spark, d, "orders").select(
        F.struct(
            F.concat(F.lit("priority "), "o_orderpriority").alias("priority"),
            F.expr(f"(o_orderkey - pmod(o_orderkey, {ORDER_KEYS})) div {ORDER_KEYS}").alias("block"),
        ).alias("table_id"),
        "o_orderkey", "o_orderstatus",
    )
    values = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus")
    cells = o.select("table_id", F.col("o_orderkey").alias("row_no"), F.posexplode(values).alias("col_no", "value"))
    header = F.get(F.array(F.lit("key"), F.lit("status")), F.col("col_no"))
    return to_tables(cells.select("table_id", "row_no", "col_no", header.alias("header"), "value"))


@query("cells_implode_large", """
SELECT 'priority ' || o_orderpriority AS table_id, COUNT(*) AS n_rows, MIN(o_orderkey) AS first_key, MAX(o_orderkey) AS last_key
FROM orders GROUP BY o_orderpriority""")
def cells_implode_large(spark, d):
    """Tables far above the cell limit come back whole, in row order."""
    key = lambda i: F.get(F.get("rows", i), F.lit(0)).cast("bigint")
    return order_tables(spark, d).groupBy(F.col("table_id.priority").alias("table_id")).agg(
        F.sum(F.size("rows")).alias("n_rows"), F.min(key(F.lit(0))).alias("first_key"),
        F.max(key(F.size("rows") - 1)).alias("last_key"),
    )


@query("corpus_rejects", f"""
WITH {_PAGES}, t AS (SELECT * FROM page_tables)
SELECT reason, COUNT(*) AS n_tables, SUM(n) AS n_rows FROM (
  SELECT 'bad_span' AS reason, CAST(NULL AS INTEGER) AS n FROM t WHERE table_no = 2 AND page_id % 5 = 0
  UNION ALL SELECT 'ragged_rows', 1 FROM t WHERE table_no = 2 AND page_id % 5 <> 0
  UNION ALL SELECT 'too_many_cells', n_rows FROM t WHERE n_rows * 3 > 60 AND table_no < 2) GROUP BY reason""")
def corpus_rejects_query(spark, d):
    return corpus_rejects(html_pages(spark, d), 60)


_BLANKS = "CHR(9) || ' ' || CHR(160) || CHR(8195)"


@query("cell_strip", f"""
SELECT page_id AS id, 'page' AS kind, TRIM(url, {_BLANKS} || CHR(10) || CHR(13)) AS text FROM pages
UNION ALL
SELECT doc_id, 'document', TRIM(text, {_BLANKS} || CHR(10) || CHR(13) || CHR(11) || CHR(12) || CHR(133) || CHR(8232) || CHR(12288))
FROM documents""")
def cell_strip(spark, d):
    blanks = F.lit("\t   ")
    p = load(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.concat(blanks, "url", blanks).alias("text")
    )
    t = load(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.concat(blanks, "text", blanks).alias("text")
    )
    return p.unionByName(t).withColumn("text", strip_text(F.col("text")))


@query("numeric_columns", f"WITH {CORPUS} SELECT table_id, col_no, header, is_numeric FROM columns_of")
def numeric_columns_query(spark, d):
    return numeric_columns(to_cells(corpus_tables(spark, d)))


@query("quarantine_counts", f"""
WITH {_PAGES}
SELECT CASE WHEN table_no = 2 AND page_id % 5 = 0 THEN 'bad_span' WHEN n_rows < 5 THEN 'too_short' ELSE 'kept' END AS reason,
       COUNT(*) AS n FROM page_tables GROUP BY 1""")
def quarantine_counts(spark, d):
    parsed = html.parse_tables(html.select_tables(html_pages(spark, d)))
    good, bad = quarantine(parsed, {"too_short": F.size("rows") < 5})
    kept = good.select(F.lit("kept").alias("reason"))
    return kept.unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("tables_per_title", """
SELECT title, CAST(k // 1000 AS BIGINT) AS chunk_no, CAST(COUNT(*) AS INTEGER) AS n_tables,
       STRING_AGG(title || '_' || k, ',' ORDER BY k) AS table_names
FROM (SELECT o_orderpriority AS title, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k FROM orders)
GROUP BY title, k // 1000""")
def tables_per_title(spark, d):
    return title_index(_named_orders(spark, d)).select(
        "title", "chunk_no", F.size("table_names").alias("n_tables"), F.array_join("table_names", ",").alias("table_names")
    )


@query("build_corpus", f"""
WITH {_PAGES},
good AS (
  SELECT *, 'page ' || (page_id % 7) AS title FROM page_tables WHERE NOT (table_no = 2 AND page_id % 5 = 0)
),
named AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY title ORDER BY page_id * 10 + table_no) - 1 AS table_index FROM good
)
SELECT title || '_' || table_index AS table_name, header, CAST(n_rows AS INTEGER) AS n_rows FROM named
QUALIFY table_no < 2 OR ROW_NUMBER() OVER (PARTITION BY title, table_no ORDER BY page_id) = 1""")
def build_corpus_query(spark, d):
    return build_corpus(html_pages(spark, d)).select(
        "table_name", F.array_join("header", " | ").alias("header"), F.size("rows").alias("n_rows")
    )
