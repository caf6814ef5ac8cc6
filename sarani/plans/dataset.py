"""Training sets: linear tables, examples, lengths, batches, order and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sarani.functions.languages import translate_digits
from sarani.functions.linear import linearise
from sarani.operators.dataset import (
    INSTRUCTIONS, batches, concat_sets, demonstrations, dictionary_ids, few_shot_prompts, fit_length, qa_examples,
    restore_labels, shuffle_rank, stack_batches, word_dictionary,
)
from sarani.operators.families import answer_column
from sarani.plans.checks import ANSWER_HEADER, ANSWERS, CORPUS
from sarani.plans.registry import query
from sarani.plans.rewriting import _TOKENS
from sarani.plans.sample_job import sample_records, with_tables
from sarani.plans.sqltext import PART_SAMPLE_SQL, part_samples
from sarani.session import materialise, spread
from sarani.sources.star import corpus_tables, load

_BN = "'0123456789', '০১২৩৪৫৬৭৮৯'"
_HI = "'0123456789', '०१२३४५६७८९'"


def linear_sql(header: str, rows: str, lang: str = "bn") -> str:
    column, row, digits = ("<কলাম>", "<রো ", _BN) if lang == "bn" else ("<कलाम>", "<रो ", _HI)
    return (
        f"'{column} ' || ARRAY_TO_STRING({header}, ' | ') || ' ' || ARRAY_TO_STRING(LIST_TRANSFORM({rows}, "
        f"LAMBDA r, i: '{row}' || TRANSLATE(CAST(i AS VARCHAR), {digits}) || '> ' || ARRAY_TO_STRING(r, ' | ')), ' ')"
    )


@query("linearise_table", f"""
WITH {CORPUS}
SELECT table_id, {linear_sql('header', 'trows', 'bn')} AS bn, {linear_sql('header', 'trows', 'hi')} AS hi FROM corpus""")
def linearise_table(spark, d):
    return corpus_tables(spark, d).select(
        "table_id",
        linearise(F.col("header"), F.col("rows"), "bn").alias("bn"),
        linearise(F.col("header"), F.col("rows"), "hindi").alias("hi"),
    )


@query("linearise_answers", f"""
WITH {ANSWERS},
firsts AS (SELECT table_id, MIN(template_id) AS template_id FROM bound GROUP BY table_id, sql),
found AS (SELECT table_id, template_id, LIST(value ORDER BY row_no, value) AS vals FROM answers GROUP BY table_id, template_id)
SELECT table_id, b.sql,
  {linear_sql('b.header', 'b.trows')} AS source,
  '<কলাম> ' || {ANSWER_HEADER} || ' ' || ARRAY_TO_STRING(LIST_TRANSFORM(vals,
    LAMBDA v, i: '<রো ' || TRANSLATE(CAST(i AS VARCHAR), {_BN}) || '> ' || COALESCE(TRANSLATE(v, {_BN}), '')), ' ') AS target
FROM bound b JOIN found USING (table_id, template_id) JOIN firsts USING (table_id, template_id)""")
def linearise_answers(spark, d):
    """All questions over every table, answered, as linear Bengali text with Bengali digits."""
    tables = corpus_tables(spark, d)
    found, whole = sample_records(tables)
    data = F.transform("answer_rows", lambda r: F.array(translate_digits(r["value"], "bn")))
    found = found.withColumn("target", linearise(F.array(answer_column(F.col("sql"), F.col("family"))), data, "bn"))
    source = linearise(F.col("header"), F.col("rows"), "bn")
    return with_tables(found, tables, whole, source=source).select("table_id", "sql", "source", "target")


@query("qa_examples", f"""
WITH {PART_SAMPLE_SQL}
SELECT sample_id, sql AS question, input_tables AS tables, input_table_name AS table_names, answer,
  sql || ' ' || {linear_sql("['name', 'brand', 'size']", '[[p_name, p_brand, CAST(p_size AS VARCHAR)]]')} AS source,
  {linear_sql("['name', 'max(size)']", '[[p_name, CAST(p_size AS VARCHAR)]]')} AS target
FROM samples""")
def qa_examples_query(spark, d):
    return qa_examples(part_samples(spark, d), "bn", "sql")


@query("fit_length", rf"""
WITH numbered AS (
  SELECT doc_id, lang, (ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS batch_id,
    LIST_TRANSFORM(LIST_SLICE({_TOKENS.replace('(t,', '(text,')}, 1, 1024),
      LAMBDA w: CAST('0x' || SUBSTR(MD5(w), 1, 5) AS INTEGER) % 1048576 + 4) AS ids
  FROM documents),
longest AS (SELECT lang, batch_id, MAX(LEN(ids)) AS m FROM numbered GROUP BY ALL)
SELECT doc_id, lang, batch_id,
  ARRAY_TO_STRING(ids || LIST_TRANSFORM(RANGE(m - LEN(ids)), LAMBDA x: 1), ' ') AS input_ids,
  ARRAY_TO_STRING(LIST_TRANSFORM(ids, LAMBDA x: 1) || LIST_TRANSFORM(RANGE(m - LEN(ids)), LAMBDA x: 0), ' ') AS attention_mask
FROM numbered JOIN longest USING (lang, batch_id)""")
def fit_length_query(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    batched = batches(docs, 16, "doc_id", ["lang"])
    fitted = fit_length(batched, "text", ["lang", "batch_id"], 1024)
    return fitted.select(
        "doc_id", "lang", "batch_id", F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", " ").alias("attention_mask"),
    )


_DICTIONARY_SQL = f"""
tokens AS (SELECT doc_id, lang, LIST_SLICE({_TOKENS.replace('(t,', '(text,')}, 1, 1024) AS ws, {_TOKENS.replace('(t,', '(text,')} AS every FROM documents),
dictionary AS (
  SELECT w, ROW_NUMBER() OVER (ORDER BY CAST('0x' || SUBSTR(MD5(w), 1, 15) AS BIGINT), w) + 3 AS id
  FROM (SELECT DISTINCT UNNEST(every) AS w FROM tokens))"""


@query("word_dictionary", f"WITH {_DICTIONARY_SQL} SELECT w AS word, id FROM dictionary")
def word_dictionary_query(spark, d):
    return word_dictionary(spread(load(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text")


@query("fit_length_dictionary", f"""
WITH {_DICTIONARY_SQL},
spots AS (SELECT doc_id, UNNEST(ws) AS w, UNNEST(RANGE(LEN(ws))) AS pos FROM tokens),
ids AS (SELECT doc_id, LIST(id ORDER BY pos) AS ids FROM spots JOIN dictionary USING (w) GROUP BY doc_id),
numbered AS (
  SELECT t.doc_id, lang, (ROW_NUMBER() OVER (PARTITION BY lang ORDER BY t.doc_id) - 1) // 16 AS batch_id, COALESCE(ids, []) AS ids
  FROM tokens t LEFT JOIN ids ON ids.doc_id = t.doc_id),
longest AS (SELECT lang, batch_id, MAX(LEN(ids)) AS m FROM numbered GROUP BY ALL)
SELECT doc_id, lang, batch_id, CAST(LEN(ids) AS INTEGER) AS n_words,
  MD5(ARRAY_TO_STRING(ids || LIST_TRANSFORM(RANGE(m - LEN(ids)), LAMBDA x: 1), ' ')) AS input_ids
FROM numbered JOIN longest USING (lang, batch_id)""")
def fit_length_dictionary(spark, d):
    """Ids of a dictionary of all documents' words, cut and padded by batch."""
    docs = spread(load(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    dictionary = materialise(word_dictionary(docs, "text"), "dictionary")
    ids = docs.select("doc_id", "lang").join(dictionary_ids(docs, "text", dictionary, "doc_id", 1024), "doc_id")
    fitted = fit_length(batches(ids, 16, "doc_id", ["lang"]), "ids", ["lang", "batch_id"], 1024)
    return fitted.select(
        "doc_id", "lang", "batch_id", F.size("ids").alias("n_words"), F.md5(F.array_join("input_ids", " ")).alias("input_ids")
    )


_NUMBERED_TURNS = """
numbered AS (
  SELECT conv_id, turn, role, ROW_NUMBER() OVER (ORDER BY conv_id, turn) - 1 AS k, COUNT(*) OVER () AS n
  FROM conversations
)"""


def _turn_batches(spark, d, drop_last):
    c = load(spark, d, "conversations").select("conv_id", "turn", "role")
    return batches(c, 8, "conv_id", drop_last=drop_last, ties=("turn",))


@query("batch_assign", f"""
WITH {_NUMBERED_TURNS}
SELECT conv_id, turn, k // 8 AS batch_id, CAST(k % 8 AS INTEGER) AS batch_pos FROM numbered WHERE k < n - n % 8""")
def batch_assign(spark, d):
    return _turn_batches(spark, d, True).select("conv_id", "turn", "batch_id", "batch_pos")


@query("batch_stack", f"""
WITH {_NUMBERED_TURNS}
SELECT k // 8 AS batch_id, STRING_AGG(role, ',' ORDER BY k) AS roles, STRING_AGG(turn, ',' ORDER BY k) AS turns
FROM numbered GROUP BY k // 8""")
def batch_stack(spark, d):
    stacked = stack_batches(_turn_batches(spark, d, False), ["role", "turn"])
    return stacked.select(
        "batch_id", F.array_join("role", ",").alias("roles"), F.array_join("turn", ",").alias("turns")
    )


@query("seeded_shuffle", """
SELECT doc_id, ROW_NUMBER() OVER (ORDER BY CAST('0x' || SUBSTR(MD5('42|' || doc_id), 1, 15) AS BIGINT), doc_id) - 1 AS rank
FROM documents""")
def seeded_shuffle(spark, d):
    return shuffle_rank(load(spark, d, "documents").select("doc_id"), "doc_id")


@query("concat_sets", """
SELECT 'documents' AS origin, doc_id AS id, text FROM documents
UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
UNION ALL SELECT 'conversations', conv_id, text FROM conversations""")
def concat_sets_query(spark, d):
    def part(name, key):
        return load(spark, d, name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), "text")

    return concat_sets(part("documents", "doc_id"), part("benchmark", "item_id"), part("conversations", "conv_id"))


@query("restore_labels", """
SELECT doc_id, quality || ',' || CASE WHEN toxic = 1 THEN 1 ELSE 7 END || ',1' AS labels FROM labels""")
def restore_labels_query(spark, d):
    ids = F.array(
        F.col("quality"), F.when(F.col("toxic") == 1, F.lit(-100)).otherwise(F.lit(7)), F.lit(-100)
    )
    return load(spark, d, "labels").select("doc_id", F.array_join(restore_labels(ids, 1), ",").alias("labels"))


def _prompts_sql(lang: str, question: str, answer: str) -> str:
    system = f"{INSTRUCTIONS[lang]}\n{demonstrations(lang)}".replace("'", "''")
    return f"""
SELECT conv_id, turn, '{system}' AS system, ':{question}: ' || text || CHR(10) || '{answer}: ' AS user
FROM conversations WHERE role = 'user'"""


@query("few_shot_prompts", _prompts_sql("bn", "প্রশ্ন", "উত্তর"))
def few_shot_prompts_query(spark, d):
    c = load(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    return few_shot_prompts(c, "bengali").select("conv_id", "turn", "system", "user")


@query("few_shot_prompts_hi", _prompts_sql("hi", "सवाल", "उत्तर"))
def few_shot_prompts_hi(spark, d):
    c = load(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    return few_shot_prompts(c, "hi").select("conv_id", "turn", "system", "user")
