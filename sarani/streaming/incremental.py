"""Conversion of sample files as they arrive; a restart goes on where the last run ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sarani.operators.rewriting import convert_samples
from sarani.sources.corpus import SAMPLE

LEDGER = "first long, n long"


def read_sample_stream(spark: SparkSession, path: str, extra: str = "", files: int | None = None) -> DataFrame:
    """Sample files as a stream; `files` limits how many one step takes."""
    reader = spark.readStream.schema(SAMPLE + (f", {extra}" if extra else ""))
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.json(path)


def write_step(batch: DataFrame, step: int, out: str, lang: str, lexicon: DataFrame, order: str) -> None:
    """Converts one step and writes it, replacing what an earlier try of the step has left.

    The ledger holds per step the index of its first sample and their number. Its entry is
    written before the samples; a step that is run again finds the entries of the steps before it
    unchanged, so its samples get the same indexes.
    """
    spark = batch.sparkSession
    ledger = spark.read.schema(f"{LEDGER}, step long").parquet(f"{out}/_ledger").where(F.col("step") < step)
    first = ledger.agg(F.coalesce(F.max(F.col("first") + F.col("n")), F.lit(0))).first()[0]
    entry = spark.range(1).select(F.lit(first).cast("long").alias("first"), F.lit(batch.count()).cast("long").alias("n"))
    entry.write.mode("overwrite").parquet(f"{out}/_ledger/step={step}")
    convert_samples(batch, lang, lexicon, order, first).write.mode("overwrite").parquet(f"{out}/step={step}")


def resume_convert(stream: DataFrame, out: str, checkpoint: str, lang: str, lexicon: DataFrame, order: str) -> None:
    """Convert all samples not yet converted and add them to `out`.

    Every step is converted as the batch job converts it, with the same lexicon table of any size
    (source, target), and written to a folder of its own number. `order` is a unique number of
    the samples; `index` goes on from step to step and follows `order` inside a step. What was read
    is kept in `checkpoint`. A step that is run again after a failure replaces its folder and its
    ledger entry, so every sample is written once, with one index.
    """
    start = stream.sparkSession.range(1).select(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n"))
    start.write.mode("ignore").parquet(f"{out}/_ledger/step=-1")
    started = stream.writeStream.foreachBatch(lambda batch, step: write_step(batch, step, out, lang, lexicon, order))
    started.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_converted(spark: SparkSession, out: str) -> DataFrame:
    """All converted samples, with the step that wrote them."""
    return spark.read.parquet(out)
