"""Removal of boilerplate lines that spread over many sites, native DataFrame operations only.

Each line hash gets a HyperLogLog sketch of the sites that show it; sketches merge by
aggregation, so a line in a third of all documents costs one row per task. Estimates far
from the threshold decide at once, near ones are replaced by exact distinct counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sarani.llm.common import broadcast_if
from sarani.session import materialise

MIN_SITES = 10
SKETCH_LOG_SIZE = 10  # 1,024 cells: a standard error of about 3 %
NEAR = 0.25  # estimates within this part of the threshold are counted exactly


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of lines shown by at least `min_sites` sites; `lines` has h1, h2, site."""
    sketched = lines.where("site IS NOT NULL").groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LOG_SIZE)).alias("sketch"))
    rated = materialise(
        sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR)),
        "line-rates",
    )
    far, near = rated.where(F.col("sites") > min_sites * (1 + NEAR)), rated.where(F.col("sites") <= min_sites * (1 + NEAR))
    near = near.select("h1", "h2")
    shown = lines.where("site IS NOT NULL").join(broadcast_if(near, 32), ["h1", "h2"], "left_semi")
    counted = shown.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return far.select("h1", "h2").unionByName(counted.select("h1", "h2"))


def remove_spread_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text: one row per input row.

    A line that at least `min_sites` different sites show is removed wherever it stands, also
    when repeated; blank lines always stay. Lines are parts between line feeds, compared
    exactly by a 128-bit hash. A null site counts for nothing; a null text has no line and
    an empty kept text, an empty text one blank line. Rows with null or repeated ids are told
    apart by their texts. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    )
    shown = rows.select("doc_id", "text_hash", "site", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    shown = shown.where(F.trim("line") != "").select(
        "doc_id", "text_hash", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )
    shown = materialise(shown, "lines")
    spread = materialise(spread_lines(shown.select("h1", "h2", "site"), min_sites), "line-spread")
    hit = shown.join(broadcast_if(spread, 32), ["h1", "h2"], "left_semi")
    gone = hit.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("gone"))
    gone = materialise(gone.withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"}), "line-gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    joined = rows.join(broadcast_if(gone, 16, "gone"), same, "left")
    lines = F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>"))
    cut = joined.select("doc_id", "text", "gone", lines.alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    return cut.select(
        "doc_id", F.size("lines").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
