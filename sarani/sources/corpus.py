"""Reading and writing the table corpus, samples, splits and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sarani.functions.text import normalise_prediction, strip_text
from sarani.session import materialise

RAW_TABLE = "title string, url string, table array<array<string>>"
SAMPLE = "sql string, answer string, input_table_name string, input_tables string"

CORPUS_BUCKETS = 64


def write_tables(df: DataFrame, path: str) -> None:
    """Raw table records as JSON lines; row 0 of `table` is the header."""
    df.select("title", "url", "table").write.json(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_TABLE).json(path)


def write_samples(df: DataFrame, path: str) -> None:
    """SQL samples as JSON lines; extra (translated) columns are kept."""
    df.write.json(path)


def read_samples(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """SQL samples; `extra` is the DDL of further columns."""
    return spark.read.schema(SAMPLE + (f", {extra}" if extra else "")).json(path)


def save_corpus(df: DataFrame, path: str, buckets: int = CORPUS_BUCKETS) -> None:
    """Tables as Parquet, replacing the whole corpus; each table lies in the bucket of its name."""
    _bucketed(df, buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)


def bucket_of(table_name: Column, buckets: int = CORPUS_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(table_name), F.lit(buckets)).cast("int")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    # Few files per bucket, however many tasks there are; a large bucket still gets several.
    bucketed = df.withColumn("bucket", bucket_of(F.col("table_name"), buckets))
    return bucketed.repartition("bucket", F.pmod(F.xxhash64("table_name", F.lit("file")), F.lit(4)))


def open_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_tables(df: DataFrame, path: str, buckets: int = CORPUS_BUCKETS) -> None:
    """Puts tables into a saved corpus; tables of the same names go, all others stay.

    Only the buckets of the new tables are read and written again, each as a whole when all
    tasks are done; so a run that fails leaves the corpus as it was. `df` has the corpus's columns.
    Repeated names in `df` all stay. The corpus must have been saved with as many buckets.
    """
    spark = df.sparkSession
    new = materialise(df.withColumn("bucket", bucket_of(F.col("table_name"), buckets)), "new-tables")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    corpus = open_corpus(spark, path)
    held = corpus.where(F.col("bucket").isin(touched)).join(new.select("table_name", "bucket").distinct(), ["table_name", "bucket"], "left_anti")
    # Written aside first: files that are read may not be replaced.
    whole = materialise(held.select(corpus.columns).unionByName(new.select(corpus.columns)), "replaced-buckets")
    _bucketed(whole.drop("bucket"), buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def list_tables(df: DataFrame) -> DataFrame:
    """Distinct table names."""
    return df.select("table_name").distinct()


def read_table(df: DataFrame, table_name: str, buckets: int = CORPUS_BUCKETS) -> DataFrame:
    """One table of a saved corpus by name: only its bucket is opened, and the name reaches the scan."""
    named = F.lit(table_name)
    return df.filter((F.col("bucket") == bucket_of(named, buckets)) & (F.col("table_name") == named)).drop("bucket")


def save_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def load_split(spark: SparkSession, path: str, value: str, split: str = "split") -> DataFrame:
    """One split of a saved data set: only its folder is read."""
    return spark.read.parquet(path).filter(F.col(split) == value)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions and targets as JSON lines, lower-cased and stripped."""
    df.select(
        normalise_prediction(F.col("prediction")).alias("prediction"),
        F.lower(strip_text(F.col("target"))).alias("target"),
    ).write.json(path)
