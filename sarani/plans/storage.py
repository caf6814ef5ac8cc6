"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sarani.functions.splitjson import from_split_json, to_split_json
from sarani.functions.text import normalise_prediction
from sarani.operators.tables import name_tables
from sarani.plans.checks import CORPUS
from sarani.plans.registry import query
from sarani.plans.sqltext import PART_SAMPLE_SQL, WORDS, keywords_check, part_samples, words_check
from sarani.session import scratch_path, spread
from sarani.sources.corpus import (
    list_tables, load_split, open_corpus, read_samples, read_tables, replace_tables, save_corpus, save_splits,
    write_predictions, write_samples, write_tables,
)
from sarani.sources.pages import read_pages
from sarani.sources.star import corpus_tables, load
from sarani.streaming.incremental import read_converted, read_sample_stream, resume_convert


@query("scan_pages", """
SELECT page_id, url, html, CAST(LENGTH(html) AS INTEGER) AS n_chars FROM pages WHERE url LIKE '%/en/%'""")
def scan_pages(spark, d):
    return read_pages(spark, f"{d}/pages.parquet", "en").select(
        "page_id", "url", "html", F.length("html").alias("n_chars")
    )


@query("tables_jsonl_roundtrip", f"""
WITH {CORPUS}
SELECT title, 'http://example.org/' || table_id AS url, n_rows + 1 AS n_rows,
       ARRAY_TO_STRING(header, '|') || ';' ||
       ARRAY_TO_STRING(LIST_TRANSFORM(trows, LAMBDA r: ARRAY_TO_STRING(r, '|')), ';') AS content
FROM corpus""")
def tables_jsonl_roundtrip(spark, d):
    path = scratch_path(spark, "tables")
    raw = corpus_tables(spark, d).select(
        "title",
        F.concat(F.lit("http://example.org/"), "table_id").alias("url"),
        F.concat(F.array("header"), F.col("rows")).alias("table"),
    )
    write_tables(raw, path)
    return read_tables(spark, path).select(
        "title", "url", F.size("table").cast("bigint").alias("n_rows"),
        F.array_join(F.transform("table", lambda r: F.array_join(r, "|")), ";").alias("content"),
    )


@query("samples_jsonl_roundtrip", f"""
WITH {PART_SAMPLE_SQL} SELECT sample_id, sql, answer, input_table_name, input_tables FROM samples""")
def samples_jsonl_roundtrip(spark, d):
    path = scratch_path(spark, "samples")
    write_samples(part_samples(spark, d), path)
    return read_samples(spark, path, "sample_id bigint")


@query("predictions_jsonl_roundtrip", r"""
SELECT TRIM(LOWER(REPLACE(text, CHR(10), ' ')), ' ') AS prediction, LOWER(role) AS target
FROM conversations""")
def predictions_jsonl_roundtrip(spark, d):
    path = scratch_path(spark, "predictions")
    c = load(spark, d, "conversations")
    write_predictions(c.select(F.col("text").alias("prediction"), F.col("role").alias("target")), path)
    return spark.read.schema("prediction string, target string").json(path)


def _order_tables(spark, d):
    """A table per order, named by its priority and number."""
    tables = load(spark, d, "orders").select(
        F.col("o_orderpriority").alias("title"), "o_orderkey", F.array(F.lit("total")).alias("header"),
        F.array(F.array(F.col("o_totalprice").cast("string"))).alias("rows"),
    )
    return name_tables(tables, "o_orderkey")


@query("corpus_table_list", """
SELECT DISTINCT o_orderpriority || '_' || (ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)
       AS table_name FROM orders""")
def corpus_table_list(spark, d):
    path = scratch_path(spark, "corpus")
    save_corpus(_order_tables(spark, d), path)
    return list_tables(open_corpus(spark, path))


@query("corpus_replace_table", """
SELECT table_name, CASE WHEN k % 10 = 3 THEN 'changed' ELSE 'total' END AS header, CASE WHEN k % 10 = 3 THEN 'x' || o_orderkey ELSE total END AS cell
FROM (SELECT *, o_orderpriority || '_' || k AS table_name FROM (
  SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS total, o_orderpriority, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k
  FROM orders))
UNION ALL SELECT 'added_' || r_regionkey, 'name', r_name FROM region""")
def corpus_replace_table(spark, d):
    """Every tenth table of a title replaced by another one, and some added; the others stay."""
    path = scratch_path(spark, "corpus")
    tables = _order_tables(spark, d)
    save_corpus(tables, path)
    cell = F.array(F.array(F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))))
    changed = tables.where(F.col("table_index") % 10 == 3).withColumn("header", F.array(F.lit("changed"))).withColumn("rows", cell)
    added = load(spark, d, "region").select(
        F.lit("added").alias("title"), F.lit(0).cast("long").alias("o_orderkey"), F.array(F.lit("name")).alias("header"),
        F.array(F.array(F.col("r_name"))).alias("rows"), F.col("r_regionkey").cast("long").alias("table_index"),
        F.concat(F.lit("added_"), F.col("r_regionkey").cast("string")).alias("table_name"),
    )
    replace_tables(changed.unionByName(added), path)
    return open_corpus(spark, path).select("table_name", F.col("header")[0].alias("header"), F.col("rows")[0][0].alias("cell"))


@query("split_json_roundtrip", f"""
WITH {CORPUS}
SELECT table_id,
       CAST(JSON_OBJECT('columns', header, 'index', RANGE(n_rows), 'data', trows) AS VARCHAR) AS json,
       CAST(n_rows AS INTEGER) AS n_rows, trows[n_rows][1] AS last_name
FROM corpus""")
def split_json_roundtrip(spark, d):
    t = corpus_tables(spark, d).select("table_id", to_split_json(F.col("header"), F.col("rows")).alias("json"))
    back = from_split_json(F.col("json"))
    return t.select(
        "table_id", "json", F.size(back["index"]).alias("n_rows"),
        F.element_at(back["data"], -1)[0].alias("last_name"),
    )


@query("split_scan", "SELECT doc_id, source, n_chars, lang FROM documents WHERE lang = 'en'")
def split_scan(spark, d):
    path = scratch_path(spark, "splits")
    save_splits(load(spark, d, "documents").select("doc_id", "source", "n_chars", "lang"), path, "lang")
    return load_split(spark, path, "en", "lang")


@query("prediction_normalize", r"""
SELECT conv_id, turn, TRIM(LOWER(REPLACE(text, CHR(10), ' ')), ' ') AS prediction FROM conversations""")
def prediction_normalize(spark, d):
    return load(spark, d, "conversations").select(
        "conv_id", "turn", normalise_prediction(F.col("text")).alias("prediction")
    )


_EVENT_SQL = """
events_sql AS (
  SELECT event_id, 'SELECT value FROM `events_' || user_id || '` WHERE kind = "' || event_type
         || '" AND id = ' || event_id AS sql,
         'events_' || user_id AS input_table_name, value FROM events
)"""


def event_samples(spark, d):
    """SQL samples over the events."""
    e = load(spark, d, "events")
    table = F.concat(F.lit("events_"), F.col("user_id").cast("string"))
    return e.select(
        "event_id",
        F.concat(
            F.lit("SELECT value FROM `"), table, F.lit('` WHERE kind = "'), "event_type",
            F.lit('" AND id = '), F.col("event_id").cast("string"),
        ).alias("sql"),
        to_split_json(
            F.array(F.lit("count")), F.array(F.array(F.col("value").cast("string")))
        ).alias("answer"),
        table.alias("input_table_name"),
        to_split_json(F.array(F.lit("value")), F.array(F.array(F.col("value").cast("string")))).alias("input_tables"),
    )


_CONVERTED = f"""
WITH {_EVENT_SQL},
kinds AS (SELECT *, {keywords_check("REGEXP_EXTRACT(sql, 'kind = \"([^\"]*)\"', 1)", 'bn')} AS kind FROM events_sql)
SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_id % 2, event_id) - 1 AS index,
  'নির্বাচন করুন মান থেকে `ঘটনা যেখানে ' || {keywords_check("'kind'", 'bn')} || ' = "' || {words_check('kind')}
    || '" এবং id = ' || CASE WHEN event_id > 9 THEN TRANSLATE(CAST(event_id AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯')
                              ELSE CAST(event_id AS VARCHAR) END AS indic_sql,
  '{{"columns":["গণনা"],"index":[0],"data":[["' ||
    TRANSLATE(CAST(value AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') || '"]]}}' AS translated_answer
FROM kinds"""


def _convert_in_two_runs(spark, d, lexicon):
    """Two runs over a growing folder: the second converts only the new files and counts on."""
    source, out, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    samples = spread(event_samples(spark, d), "event_id")
    for part in (0, 1):
        samples.filter(F.col("event_id") % 2 == part).write.mode("append").json(source)
        resume_convert(read_sample_stream(spark, source, "event_id bigint"), out, checkpoint, "bn", lexicon, "event_id")
    return read_converted(spark, out).select("event_id", "index", "indic_sql", "translated_answer")


@query("incremental_convert", _CONVERTED)
def incremental_convert(spark, d):
    return _convert_in_two_runs(spark, d, spark.createDataFrame(list(WORDS.items()), "source string, target string"))


@query("incremental_convert_lexicon", _CONVERTED)
def incremental_convert_lexicon(spark, d):
    """The same with a far larger lexicon: that of `incremental_convert` and the customers' names."""
    words = spark.createDataFrame(list(WORDS.items()), "source string, target string")
    names = load(spark, d, "customer").select(F.col("c_name").alias("source"), F.lit("নাম").alias("target"))
    return _convert_in_two_runs(spark, d, words.unionByName(names))
