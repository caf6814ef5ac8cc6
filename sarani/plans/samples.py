"""Templates bound to tables, their SQL and their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sarani.operators.families import FAMILIES, KEYS, answer_blocks, assemble, execute, execute_family, non_empty
from sarani.operators.records import bound_in_record
from sarani.operators.templates import (
    bind, bind_columns, classify_templates, drop_id_templates, pair, template_list,
)
from sarani.plans.checks import ANSWER_HEADER, ANSWERS, BOUND, CORPUS, FAMILY_SQL, OPENED, TEMPLATE_VALUES
from sarani.plans.registry import query
from sarani.plans.sample_job import bound_pairs, build_samples, family_answers
from sarani.session import materialise
from sarani.sources.star import corpus_tables, load


@query("template_classify", f"""
WITH {BOUND}
SELECT table_id, CASE WHEN numeric THEN 'numeric' ELSE 'non_numeric' END AS split, COUNT(*) AS n_templates
FROM pairs GROUP BY 1, 2""")
def template_classify(spark, d):
    pairs = pair(corpus_tables(spark, d), classify_templates(template_list(spark)))
    return pairs.groupBy("table_id", "split").agg(F.count("*").alias("n_templates"))


@query("template_filter", f"""
WITH {CORPUS}, {TEMPLATE_VALUES}
SELECT table_id, template_id FROM corpus JOIN templates ON NOT has_id""")
def template_filter(spark, d):
    templates = drop_id_templates(template_list(spark))
    return pair(corpus_tables(spark, d), templates).select("table_id", "template_id")


@query("template_pairs", f"WITH {BOUND} SELECT table_id, template_id, family FROM pairs WHERE numeric")
def template_pairs(spark, d):
    return pair(corpus_tables(spark, d), template_list(spark), "numeric").select("table_id", "template_id", "family")


@query("bind_columns", f"""
WITH {BOUND}
SELECT table_id, template_id, slot, header[1 + col] AS column_name
FROM (SELECT table_id, template_id, header, UNNEST(slots) AS slot, UNNEST(slot_cols) AS col FROM bound)""")
def bind_columns_query(spark, d):
    bound = bind_columns(pair(corpus_tables(spark, d), template_list(spark)))
    slots = bound.select("table_id", "template_id", "header", F.inline(F.arrays_zip("slots", "slot_cols")))
    return slots.select(
        "table_id", "template_id", F.col("slots").alias("slot"), F.get("header", F.col("slot_cols")).alias("column_name")
    )


@query("bind_literals", f"""
WITH {BOUND}
SELECT table_id, template_id, CAST(k - 1 AS INTEGER) AS literal_no, literal
FROM (SELECT table_id, template_id, UNNEST(RANGE(1, LEN(lits) + 1)) AS k, UNNEST(lits) AS literal FROM bound)""")
def bind_literals_query(spark, d):
    bound = bind(corpus_tables(spark, d), template_list(spark))
    return bound.select("table_id", "template_id", F.posexplode("lits").alias("literal_no", "literal"))


@query("render_sql", f"WITH {BOUND} SELECT table_id, template_id, sql FROM bound")
def render_sql_query(spark, d):
    return bound_pairs(corpus_tables(spark, d)).select("table_id", "template_id", "sql")


@query("distinct_sql", f"""
WITH {BOUND} SELECT table_id, sql, MIN(template_id) AS template_id FROM bound GROUP BY table_id, sql""")
def distinct_sql_query(spark, d):
    bound = bound_in_record(corpus_tables(spark, d), template_list(spark))
    return bound.select("table_id", F.inline("pairs")).select("table_id", "sql", "template_id")


def _register_family(family):
    @query(f"family_{family}", f"WITH {OPENED}{FAMILY_SQL[family]}")
    def run(spark, d):
        return family_answers(spark, corpus_tables(spark, d), family)


for _family in FAMILIES:
    _register_family(_family)


def large_table(spark, d, family, slot_cols, lits):
    """`orders` as one table that is too large for a record: its pair of a family, and its rows."""
    o = load(spark, d, "orders")
    row_no = F.col("o_orderkey").cast("long")
    cells = F.array(*[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")])
    pair = o.agg((F.max(row_no) + 1).alias("n_rows")).select(
        F.lit("orders").alias("table_id"), F.lit(1).alias("template_id"), F.lit(family).alias("family"), F.lit("").alias("func"),
        F.array(*[F.lit(c) for c in slot_cols]).alias("slot_cols"), F.array(*[F.lit(x) for x in lits]).cast("array<string>").alias("lits"), "n_rows",
    )
    return pair, o.select(F.lit("orders").alias("table_id"), row_no.alias("row_no"), cells.alias("values"))


@query("family_lowest_k_large", """
SELECT 'orders' AS table_id, CAST(1 AS INTEGER) AS template_id, CAST(ROW_NUMBER() OVER (ORDER BY p, o_orderkey) - 1 AS INTEGER) AS row_no, k AS value
FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS p FROM orders)
QUALIFY ROW_NUMBER() OVER (ORDER BY p, o_orderkey) <= 3""")
def family_lowest_k_large(spark, d):
    pair, rows = large_table(spark, d, "lowest_k", [0, 2], [])
    return execute_family(pair, "lowest_k", rows)


@query("family_not_in_large", """
SELECT 'orders' AS table_id, CAST(1 AS INTEGER) AS template_id, CAST(o_orderkey AS INTEGER) AS row_no, CAST(o_orderkey AS VARCHAR) AS value
FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def family_not_in_large(spark, d):
    pair, rows = large_table(spark, d, "not_in", [0, 1, 3], ["1-URGENT"])
    return execute_family(pair, "not_in", rows)


@query("family_answer_blocks", """
SELECT 'orders' AS table_id, CAST(1 AS INTEGER) AS template_id, o_orderkey // 1000 AS block, COUNT(*) AS n_rows,
  MD5(STRING_AGG(o_orderkey, ',' ORDER BY o_orderkey)) AS digest
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL""")
def family_answer_blocks(spark, d):
    pair, rows = large_table(spark, d, "project_where", [0, 3], ["1-URGENT"])
    blocks = answer_blocks(execute_family(pair, "project_where", rows), 1000)
    digest = F.md5(F.array_join(F.transform("answer_rows", lambda a: a["value"]), ","))
    return blocks.select(*KEYS, "block", F.size("answer_rows").cast("long").alias("n_rows"), digest.alias("digest"))


@query("non_empty_answers", f"""
WITH {ANSWERS}
SELECT DISTINCT b.table_id, b.template_id FROM bound b JOIN answers a USING (table_id, template_id)""")
def non_empty_answers(spark, d):
    bound = bound_pairs(corpus_tables(spark, d))
    return non_empty(bound, execute(bound)).select(*KEYS)


_ASSEMBLED = f"""
SELECT b.table_id, b.template_id, b.sql,
  CAST(JSON_OBJECT('columns', [{ANSWER_HEADER}],
    'index', RANGE(COUNT(*)), 'data', LIST([a.value] ORDER BY a.row_no, a.value)) AS VARCHAR) AS answer,
  b.table_id AS input_table_name,
  CAST(JSON_OBJECT('columns', ANY_VALUE(b.header), 'index', RANGE(ANY_VALUE(b.n_rows)), 'data', ANY_VALUE(b.trows)) AS VARCHAR) AS input_tables
FROM bound b JOIN answers a USING (table_id, template_id)"""
_GROUP = " GROUP BY b.table_id, b.template_id, b.sql, b.func, b.family, b.header, b.slot_cols"


@query("sample_assemble", f"WITH {ANSWERS}{_ASSEMBLED}{_GROUP}")
def sample_assemble(spark, d):
    tables = corpus_tables(spark, d)
    bound = materialise(bound_pairs(tables), "bound", ("family",))
    return assemble(bound, execute(bound), tables)


@query("build_samples", f"""
WITH {ANSWERS},
firsts AS (SELECT table_id, MIN(template_id) AS template_id FROM bound GROUP BY table_id, sql)
SELECT * FROM ({_ASSEMBLED}{_GROUP}) JOIN firsts USING (table_id, template_id)""")
def build_samples_query(spark, d):
    return build_samples(corpus_tables(spark, d))
