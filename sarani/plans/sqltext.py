"""SQL samples written straight from the parts, and a small word lexicon, for the rewriting jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sarani.functions.languages import lexicon_entries
from sarani.functions.splitjson import to_split_json
from sarani.sources.star import load

# A word lexicon for the checks: English word, Bengali word.
WORDS = {
    "value": "মান", "events": "ঘটনা", "click": "ক্লিক", "view": "দেখা", "error": "ভুল", "part": "অংশ",
    "name": "নাম", "size": "আকার", "small": "ছোট", "red": "লাল", "blue": "নীল", "hot": "গরম",
    "cold": "ঠান্ডা", "new": "নতুন", "bolt": "বোল্ট", "ring": "আংটি", "the": "টি", "of": "এর",
}


def words_check(column: str) -> str:
    """SQL: the translation of a whole word, or the word."""
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items())
    return f"CASE {column} {whens} ELSE {column} END"


def keywords_check(column: str, lang: str) -> str:
    """SQL: one REPLACE per keyword, in lexicon order."""
    for word, target in lexicon_entries(lang):
        column = f"REPLACE({column}, '{word}', '{target}')"
    return column


# Built from the parts alone, so that SQL can state the same samples.
PART_SAMPLE_SQL = """
samples AS (
  SELECT p_partkey AS sample_id,
    'SELECT name, max ( size ) FROM `part_' || (p_partkey // 20) || '` WHERE name = "' || p_name
      || '" AND size > ' || p_size || ' GROUP BY name ORDER BY price DESC LIMIT 10' AS sql,
    CAST(JSON_OBJECT('columns', ['name', 'max(size)'], 'index', [0],
         'data', [[p_name, CAST(p_size AS VARCHAR)]]) AS VARCHAR) AS answer,
    'part_' || (p_partkey // 20) AS input_table_name,
    CAST(JSON_OBJECT('columns', ['name', 'brand', 'size'], 'index', [0],
         'data', [[p_name, p_brand, CAST(p_size AS VARCHAR)]]) AS VARCHAR) AS input_tables,
    p_name, p_brand, p_size
  FROM part
)"""


def part_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per part: sample_id and the sample columns."""
    p = load(spark, sf_dir, "part")
    table = F.concat(F.lit("part_"), F.floor(F.col("p_partkey") / 20).cast("string"))
    size = F.col("p_size").cast("string")
    return p.select(
        F.col("p_partkey").alias("sample_id"),
        F.concat(
            F.lit("SELECT name, max ( size ) FROM `"), table, F.lit('` WHERE name = "'), "p_name",
            F.lit('" AND size > '), size, F.lit(" GROUP BY name ORDER BY price DESC LIMIT 10"),
        ).alias("sql"),
        to_split_json(
            F.array(F.lit("name"), F.lit("max(size)")), F.array(F.array(F.col("p_name"), size))
        ).alias("answer"),
        table.alias("input_table_name"),
        to_split_json(
            F.array(F.lit("name"), F.lit("brand"), F.lit("size")),
            F.array(F.array(F.col("p_name"), F.col("p_brand"), size)),
        ).alias("input_tables"),
    )
