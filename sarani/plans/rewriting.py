"""SQL and answers in an Indic language."""

from __future__ import annotations

from pyspark.sql import functions as F

from sarani.functions.languages import DIGITS, KEYWORDS, in_script, lexicon_entries, translate_digits
from sarani.functions.text import split_words
from sarani.operators.rewriting import (
    clean_table_token, convert_samples, drop_table_clause, translate_answer, translate_columns,
    translate_digit_tokens, translate_keywords, translate_words,
)
from sarani.plans.checks import CORPUS
from sarani.plans.registry import query
from sarani.plans.sqltext import PART_SAMPLE_SQL, WORDS, keywords_check, part_samples
from sarani.session import spread
from sarani.sources.star import corpus_tables, load

_SCRIPT = r"\P{L}*\p{Bengali}+(?:\P{L}+\p{Bengali}+)*\P{L}*"
_NUMBER = r"""[(-.:"''`]*\p{Nd}+[-:,.]*\p{Nd}+[)-:%.]*[?''"`]*"""
_CORE = r"REGEXP_EXTRACT(w, '^[^\pL\pN]*(.*?)[^\pL\pM\pN]*$', 1)"
_HEAD = r"REGEXP_EXTRACT(w, '^[^\pL\pN]*', 0)"


def _digits_sql(x: str, lang: str) -> str:
    return f"TRANSLATE({x}, '0123456789', '{DIGITS[lang]}')"


def _digit_tokens_sql(tokens: str, lang: str) -> str:
    return (
        f"ARRAY_TO_STRING(LIST_TRANSFORM({tokens}, LAMBDA w: CASE WHEN REGEXP_FULL_MATCH(w, '{_NUMBER}') "
        f"THEN {_digits_sql('w', lang)} ELSE w END), ' ')"
    )


def _words_sql(tokens: str, lookup: str) -> str:
    """Each token by `lookup`, an SQL expression over `core` that is null when there is no entry."""
    found = lookup.replace("core", _CORE)
    return (
        f"ARRAY_TO_STRING(LIST_TRANSFORM({tokens}, LAMBDA w: CASE WHEN REGEXP_FULL_MATCH(w, '{_SCRIPT}') "
        f"THEN w ELSE COALESCE({_HEAD} || ({found}) || SUBSTR(w, LENGTH({_HEAD}) + LENGTH({_CORE}) + 1), w) END), ' ')"
    )


_CLEAN = r"""CASE WHEN REGEXP_FULL_MATCH(w, '.*_[0-9]*["''`]*')
  THEN REPLACE(REGEXP_REPLACE(w, '_[^_]*$', ''), '_', ' ') ELSE w END"""


def _keyword_values(lang: str) -> str:
    listed = list(KEYWORDS[lang])
    every = list(dict.fromkeys(listed + [k.lower() for k in listed]))
    return ", ".join(f"('{k}', {i})" for i, k in enumerate(every))


_ORDERED = "\nUNION ALL ".join(
    f"SELECT '{lang}' AS lang, k, ROW_NUMBER() OVER (ORDER BY LENGTH(k) DESC, pos) - 1 AS rank FROM (VALUES {_keyword_values(lang)}) t(k, pos)"
    for lang in KEYWORDS
)


@query("lexicon_order", f"""
WITH {PART_SAMPLE_SQL},
words AS ({_ORDERED})
SELECT sample_id, lang, STRING_AGG(k, ',' ORDER BY rank) AS found, CAST(MIN(rank) AS INTEGER) AS first_rank
FROM samples JOIN words ON CONTAINS(sql, k) GROUP BY sample_id, lang""")
def lexicon_order(spark, d):
    """The keywords of every language that a sample holds, in the order they are tried."""
    lists: dict[tuple[str, ...], list[str]] = {}
    for lang in KEYWORDS:
        lists.setdefault(tuple(k for k, _ in lexicon_entries(lang)), []).append(lang)
    found = F.array(*[
        F.struct(
            F.array(*[F.lit(lang) for lang in langs]).alias("langs"),
            F.concat_ws(",", *[F.when(F.contains("sql", F.lit(k)), F.lit(k)) for k in words]).alias("found"),
            F.array(*[F.lit(k) for k in words]).alias("words"),
        )
        for words, langs in lists.items()
    ])
    # Each list of keywords is searched once, whichever languages share it; no keyword has a comma.
    s = spread(part_samples(spark, d).select("sample_id", "sql"), "sample_id").select("sample_id", F.inline(found)).where("found <> ''")
    first = F.array_position("words", F.substring_index("found", ",", 1)) - 1
    return s.select("sample_id", F.explode("langs").alias("lang"), "found", first.cast("int").alias("first_rank"))


def _register_keywords(lang):
    @query(
        f"translate_keywords_{lang}",
        f"WITH {PART_SAMPLE_SQL} SELECT sample_id, {keywords_check('sql', lang)} AS indic FROM samples",
    )
    def run(spark, d):
        return part_samples(spark, d).select("sample_id", translate_keywords(F.col("sql"), lang).alias("indic"))


for _lang in KEYWORDS:
    _register_keywords(_lang)


@query("translate_keywords_bounded", f"""
WITH {PART_SAMPLE_SQL}
SELECT sample_id, 'চয়ন' AS mark,
  'নির্বাচন করুন name, সর্বোচ্চ ( size ) থেকে `' || input_table_name || '` যেখানে name = "' || p_name || '" এবং size > '
  || p_size || ' দল করা name সাজান হোক price অবরোহী সীমা 10' AS indic FROM samples""")
def translate_keywords_bounded(spark, d):
    return spread(part_samples(spark, d), "sample_id").select(
        "sample_id", F.lit("চয়ন").alias("mark"), translate_keywords(F.col("sql"), "bn", word_bounded=True).alias("indic")
    )


@query("translate_digits", f"""
SELECT o_orderkey, {_digits_sql('CAST(o_orderkey AS VARCHAR)', 'bn')} AS bn, {_digits_sql('CAST(o_totalprice AS VARCHAR)', 'hi')} AS hi,
  {_digits_sql('o_orderpriority', 'or')} AS odia, o_orderpriority AS other FROM orders""")
def translate_digits_query(spark, d):
    o = load(spark, d, "orders")
    return o.select(
        "o_orderkey",
        translate_digits(F.col("o_orderkey").cast("string"), "bengali").alias("bn"),
        translate_digits(F.col("o_totalprice").cast("string"), "hindi").alias("hi"),
        translate_digits(F.col("o_orderpriority"), "oriya").alias("odia"),
        translate_digits(F.col("o_orderpriority"), "french").alias("other"),
    )


_TOKENS = r"LIST_FILTER(STRING_SPLIT_REGEX(t, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), LAMBDA w: w <> '')"


@query("translate_digit_tokens", f"""
SELECT doc_id, {_digit_tokens_sql(_TOKENS, 'bn')} AS text
FROM (SELECT doc_id, text || ' 7 "' || doc_id || '", (' || n_chars || ')?' AS t FROM documents)""")
def translate_digit_tokens_query(spark, d):
    doc = spread(load(spark, d, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    text = F.concat(
        "text", F.lit(' 7 "'), F.col("doc_id").cast("string"), F.lit('", ('), F.col("n_chars").cast("string"), F.lit(")?")
    )
    return doc.select("doc_id", translate_digit_tokens(text, "bn").alias("text"))


@query("drop_table_clause", f"""
WITH {PART_SAMPLE_SQL}
SELECT sample_id, REPLACE({keywords_check('sql', 'hi')}, 'से `' || input_table_name || '`', '') AS indic FROM samples""")
def drop_table_clause_query(spark, d):
    text = translate_keywords(F.col("sql"), "hi")
    return part_samples(spark, d).select(
        "sample_id", drop_table_clause(text, "hi", F.col("input_table_name")).alias("indic")
    )


@query("script_filter", f"""
SELECT p_partkey, REGEXP_FULL_MATCH({_digits_sql('CAST(p_partkey AS VARCHAR)', 'bn')}, '{_SCRIPT}') AS key_bn,
  REGEXP_FULL_MATCH({_digits_sql('p_brand', 'bn')}, '{_SCRIPT}') AS brand_bn,
  REGEXP_FULL_MATCH('আকার ' || p_size, '{_SCRIPT}') AS size_bn,
  REGEXP_FULL_MATCH({_digits_sql('CAST(p_partkey AS VARCHAR)', 'hi')}, '{_SCRIPT.replace('Bengali', 'Devanagari')}') AS key_hi,
  REGEXP_FULL_MATCH({_digits_sql('CAST(p_partkey AS VARCHAR)', 'bn')}, '{_SCRIPT.replace('Bengali', 'Oriya')}') AS key_or
FROM part""")
def script_filter(spark, d):
    p = load(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(
        "p_partkey",
        in_script(translate_digits(key, "bn"), "bn").alias("key_bn"),
        in_script(translate_digits(F.col("p_brand"), "bn"), "bn").alias("brand_bn"),
        in_script(F.concat(F.lit("আকার "), F.col("p_size").cast("string")), "bn").alias("size_bn"),
        in_script(translate_digits(key, "hi"), "hi").alias("key_hi"),
        in_script(translate_digits(key, "bn"), "or").alias("key_or"),
    )


@query("table_token_clean", f"""
SELECT p_partkey, {_CLEAN} AS cleaned FROM (
  SELECT p_partkey, '`' || REPLACE(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '_' || p_size ELSE '' END || '`' AS w FROM part)""")
def table_token_clean(spark, d):
    p = load(spark, d, "part")
    tail = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise(F.lit(""))
    word = F.concat(F.lit("`"), F.replace("p_name", F.lit(" "), F.lit("_")), tail, F.lit("`"))
    return p.select("p_partkey", clean_table_token(word).alias("cleaned"))


_LEXICON_SQL = r"""
lexicon AS (
  SELECT DISTINCT w AS source, 'শব্দ' || TRANSLATE(CAST(LENGTH(w) AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') AS target
  FROM (SELECT UNNEST(REGEXP_EXTRACT_ALL(text, '[\pL\pM\pN]+')) AS w FROM benchmark
        UNION ALL SELECT UNNEST(STRING_SPLIT(p_name, ' ')) FROM part)
)"""


def lexicon(spark, d):
    """A word lexicon of the benchmark's and the part names' words."""
    bench = load(spark, d, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("source")
    )
    names = load(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("source"))
    number = translate_digits(F.length("source").cast("string"), "bn")
    return bench.unionByName(names).distinct().withColumn("target", F.concat(F.lit("শব্দ"), number))


@query("translate_words", rf"""
WITH {_LEXICON_SQL},
tokens AS (
  SELECT doc_id, UNNEST({_TOKENS.replace('(t,', '(text,')}) AS w, UNNEST(RANGE(LEN({_TOKENS.replace('(t,', '(text,')}))) AS pos
  FROM documents),
cored AS (SELECT *, {_CORE} AS core, {_HEAD} AS head FROM tokens),
words AS (
  SELECT doc_id, pos, CASE WHEN target IS NULL OR REGEXP_FULL_MATCH(w, '{_SCRIPT}') THEN w
         ELSE head || target || SUBSTR(w, LENGTH(head) + LENGTH(core) + 1) END AS o
  FROM cored LEFT JOIN lexicon ON source = core)
SELECT d.doc_id, COALESCE(STRING_AGG(o, ' ' ORDER BY pos), '') AS indic
FROM documents d LEFT JOIN words USING (doc_id) GROUP BY d.doc_id""")
def translate_words_query(spark, d):
    docs = spread(load(spark, d, "documents").select("doc_id", "text"), "doc_id")
    words = {"indic": split_words(F.col("text"))}
    return translate_words(docs, lexicon(spark, d), "bn", words, "doc_id").select("doc_id", "indic")


@query("translate_words_skewed", rf"""
WITH {_LEXICON_SQL},
given AS (SELECT doc_id, LIST_TRANSFORM({_TOKENS.replace('(t,', '(text,')}, LAMBDA w, i: CASE WHEN i % 3 = 1 THEN '(the)' ELSE w END) AS ws FROM documents),
tokens AS (SELECT doc_id, UNNEST(ws) AS w, UNNEST(RANGE(LEN(ws))) AS pos FROM given),
cored AS (SELECT *, {_CORE} AS core, {_HEAD} AS head FROM tokens),
words AS (
  SELECT doc_id, pos, CASE WHEN target IS NULL OR REGEXP_FULL_MATCH(w, '{_SCRIPT}') THEN w
         ELSE head || target || SUBSTR(w, LENGTH(head) + LENGTH(core) + 1) END AS o
  FROM cored LEFT JOIN lexicon ON source = core)
SELECT d.doc_id, COALESCE(STRING_AGG(o, ' ' ORDER BY pos), '') AS indic
FROM documents d LEFT JOIN words USING (doc_id) GROUP BY d.doc_id""")
def translate_words_skewed(spark, d):
    """A third of all words are one word; the lexicon is looked up as one too large to broadcast."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text"), "doc_id")
    words = F.transform(split_words(F.col("text")), lambda w, i: F.when(i % 3 == 0, "(the)").otherwise(w))
    return translate_words(docs, lexicon(spark, d), "bn", {"indic": words}, "doc_id", most_broadcast=0).select("doc_id", "indic")


@query("translate_words_nulls", rf"""
WITH {_LEXICON_SQL},
given AS (SELECT turn + 1000 * conv_id AS id, CASE WHEN turn % 3 = 0 THEN NULL ELSE text END AS text FROM conversations),
tokens AS (
  SELECT id, UNNEST({_TOKENS.replace('(t,', '(text,')}) AS w, UNNEST(RANGE(LEN({_TOKENS.replace('(t,', '(text,')}))) AS pos FROM given),
cored AS (SELECT *, {_CORE} AS core, {_HEAD} AS head FROM tokens),
words AS (
  SELECT id, pos, CASE WHEN target IS NULL OR REGEXP_FULL_MATCH(w, '{_SCRIPT}') THEN w
         ELSE head || target || SUBSTR(w, LENGTH(head) + LENGTH(core) + 1) END AS o
  FROM cored LEFT JOIN lexicon ON source = core),
joined AS (SELECT id, STRING_AGG(o, ' ' ORDER BY pos) AS o FROM words GROUP BY id)
SELECT id, CASE WHEN text IS NOT NULL THEN COALESCE(o, '') END AS indic FROM given LEFT JOIN joined USING (id)""")
def translate_words_nulls(spark, d):
    """Records without a text stay, without a translation."""
    c = load(spark, d, "conversations")
    given = c.select((F.col("turn") + 1000 * F.col("conv_id")).alias("id"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text"))
    return translate_words(given, lexicon(spark, d), "bn", {"indic": split_words(F.col("text"))}, "id").select("id", "indic")


@query("translate_columns", f"""
WITH {CORPUS}
SELECT table_id, ARRAY_TO_STRING(LIST_TRANSFORM(header, LAMBDA h: {keywords_check("'sum(' || h || ') AS ' || h", 'or')}), '|') AS columns
FROM corpus""")
def translate_columns_query(spark, d):
    header = F.transform("header", lambda h: F.concat(F.lit("sum("), h, F.lit(") AS "), h))
    return corpus_tables(spark, d).select("table_id", F.array_join(translate_columns(header, "odia"), "|").alias("columns"))


@query("translate_answer", f"""
WITH {PART_SAMPLE_SQL}
SELECT sample_id, CAST(JSON_OBJECT('columns', ['name', 'সর্বোচ্চ(size)'], 'index', [0],
  'data', [[p_name, {_digits_sql('CAST(p_size AS VARCHAR)', 'bn')}]]) AS VARCHAR) AS translated_answer FROM samples""")
def translate_answer_query(spark, d):
    return part_samples(spark, d).select(
        "sample_id", translate_answer(F.col("answer"), "bn").alias("translated_answer")
    )


_WORD_MAP = "CASE core " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + " END"


@query("convert_samples", f"""
WITH {PART_SAMPLE_SQL},
texts AS (
  SELECT *, {_digit_tokens_sql("STRING_SPLIT(" + keywords_check('sql', 'bn') + ", ' ')", 'bn')} AS t FROM samples
)
SELECT sample_id, 'bn' AS language,
  {_words_sql(f"LIST_TRANSFORM(STRING_SPLIT(t, ' '), LAMBDA w: {_CLEAN})", _WORD_MAP)} AS indic_sql,
  {_words_sql("LIST_FILTER(STRING_SPLIT(REPLACE(t, 'থেকে `' || input_table_name || '`', ''), ' '), LAMBDA w: w <> '')", _WORD_MAP)}
    AS sql_without_table_name,
  CAST(JSON_OBJECT('columns', ['name', 'সর্বোচ্চ(size)'], 'index', [0],
    'data', [[p_name, {_digits_sql('CAST(p_size AS VARCHAR)', 'bn')}]]) AS VARCHAR) AS translated_answer,
  ROW_NUMBER() OVER (ORDER BY sample_id) - 1 AS index
FROM texts""")
def convert_samples_query(spark, d):
    words = spark.createDataFrame(list(WORDS.items()), "source string, target string")
    out = convert_samples(part_samples(spark, d), "bn", words, "sample_id")
    return out.select("sample_id", "language", "indic_sql", "sql_without_table_name", "translated_answer", "index")
