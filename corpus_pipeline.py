"""A training corpus from raw documents: five stages, each written and read again.

language ID, exact deduplication, near-duplicate removal, benchmark decontamination, BPE
encoding. Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
Decisions hold for rows, not for ids: a null or repeated doc_id is a value like others, and
rows with one id and different texts are documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sarani.llm.bpe import bpe_encode
from sarani.llm.common import LOWER, UPPER
from sarani.llm.decontaminate import find_leaks
from sarani.llm.exact_dedup import exact_dedup
from sarani.llm.language import UNKNOWN, fit_languages, held_out, identify_language
from sarani.llm.near_dedup import near_components
from sarani.plans.registry import query
from sarani.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.3  # a document whose n-grams fit no learned language goes


def norm_sha256() -> Column:
    """The text_sha256 of exact_dedup."""
    return F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a row_no that no other row has, written so that it stays."""
    return materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_no")), "rows")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without letters or language go.

    Each row is judged by its own text, whatever its id; null texts go.
    """
    model = fit_languages(docs.where(~held_out()))
    found = identify_language(docs, model, carry=tuple(COLUMNS[1:]))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts (A-Z in lower case): that with the largest id.

    A null id loses to any other; null texts equal empty ones. Of rows with that id and equal
    texts, the first by text (as written), lang, source and n_chars stays.
    """
    chosen = exact_dedup(docs, keep="largest").where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    rows = docs.select(*COLUMNS, norm_sha256().alias("norm"))
    rows = rows.join(chosen, (F.col("norm") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return rows.groupBy("norm").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): the smallest id.

    Rows with a null id lose to others; equal ids go by the hash of the text, the other
    columns and last the row's number. Texts without words stay, one and all.
    """
    rows = numbered(docs)
    groups = near_components(rows, key="row_no").select(F.col("doc_id").alias("row_no"), "component_id")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2("text", 256), F.xxhash64("lang", "source", "n_chars"), "row_no")
    first = groups.join(rows.select("row_no", rank.alias("rank")), "row_no").groupBy("component_id").agg(F.min("rank").alias("rank"))
    return rows.join(first.select("rank.row_no"), "row_no", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; each row by its own text, whatever its id."""
    rows = numbered(docs)
    leaks = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row_no")
    return rows.join(leaks.select(F.col("doc_id").alias("row_no")).distinct(), "row_no", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document; one row per row, null ids too."""
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
    ("decontaminate", decontaminated), ("bpe_encode", encoded),
]
ORACLE_SQL = None  # SQL cannot express the language, near-copy and token stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


query("pipeline")(run)
