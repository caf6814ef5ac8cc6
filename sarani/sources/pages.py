"""Page source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_pages(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """Pages with url and html; `language` keeps those with that path segment in the url."""
    pages = spark.read.parquet(path)
    if language:
        pages = pages.filter(F.col("url").contains(f"/{language}/"))
    return pages
