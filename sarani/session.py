"""Session set-up, scratch folders and size checks shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Most rows and bytes (as JSON text) a side may have before it is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def get_session(app: str = "sarani", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC times; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Small shuffles here feed stages that work long on every record.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written working table.

    On a cluster it lies in the shared folder of `spark.checkpoint.dir`. Only a
    local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="sarani-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partitions: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as Parquet in the scratch folder and read it back: cuts lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan that keeps fewer tasks busy than there are cores, spread over the cores by `keys`; others as they are.

    For stages that work long on each record. A file's row groups are not cut, so one split may hold
    most rows of a large file while the others stay empty; the rows of each split are counted,
    from the footers alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    if splits >= cores:
        sizes = scan.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        most, rows = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if most * cores <= 2 * rows:
            return scan
    return scan.repartition(max(cores, splits), *keys)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when `df` has at most `rows` rows and `size` bytes; reads at most `rows` + 1 rows."""
    found = df.limit(rows + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    ).first()
    return found[0] <= rows and found[1] <= size
