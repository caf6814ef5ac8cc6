"""Hard negatives from a packed R-tree over all vectors.

1. The rows are cut into ranges of (label, first coordinate, row), so that a label or a vector
   that very many rows hold fills many tasks; each range is tiled into leaves and written.
2. The anchors, a stated query set, go over all rows in groups of bounded size: each group is
   broadcast, and every task builds the upper levels over the leaves it reads and searches
   them best first. What a task has found bounds its later searches.
3. First the positives are found; their scores give the windows for the negatives.

Work grows with anchors times rows, as every anchor is held against all; boxes save a part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sarani.llm.box_tree import LEAF, LONG, Tree, tiles
from sarani.session import materialise

RANGE_VALUES = 1 << 20  # components of the rows tiled together
GROUP_VALUES = 2 << 20  # components of the anchors broadcast together
NO_ID = 2**63  # sorts after every id

FOUND = "anchor long, query long, row long, id long, score long"


def taking_part(rows: DataFrame, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """row, id, label, v (floor(scale * x) as doubles), d: rows with a label and only finite values."""
    most = 1.7e308 / max(1.0, abs(scale))
    v = F.col(vector).cast("array<double>")
    chosen = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    chosen = chosen.where("label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull() & x.between(-most, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)) + 0.0  # no negative zero
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            data = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            first = pa.array([flat[a] if b > a else 0.0 for a, b in zip(ends, ends[1:])], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(np.diff(ends), pa.int64()), first, data], ["id", "label", "d", "first", "v"])

    return chosen.mapInArrow(run, "id long, label long, d long, first double, v binary").withColumn("row", F.monotonically_increasing_id())


def stacked(batch: pa.RecordBatch, rows: np.ndarray, d: int) -> np.ndarray:
    """The vectors of some rows of a batch, all of d components."""
    return np.frombuffer(b"".join(batch.column("v").take(pa.array(rows)).to_pylist()), np.float64).reshape(len(rows), d)


def packed(rows: DataFrame) -> DataFrame:
    """The rows in leaf order, with `leaf`, the same for the rows of one leaf and differing between neighbours."""
    total = rows.agg(F.sum(F.col("d") + 4)).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // RANGE_VALUES)), "label", "d", "first", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        batch = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)
        batch = pa.concat_batches(batch) if len(batch) > 1 else batch[0]
        label, d = (batch.column(c).to_numpy() for c in ("label", "d"))
        order, leaf, n = [], [], 0
        for kind in sorted(set(zip(label.tolist(), d.tolist()))):
            own = np.flatnonzero((label == kind[0]) & (d == kind[1]))
            for tile in tiles(stacked(batch, own, kind[1])):
                order.append(own[tile])
                leaf.append(np.full(len(tile), n))
                n += 1
        out = batch.take(pa.array(np.concatenate(order)))
        names = ["row", "id", "label", "d", "v"]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaf), pa.int64()), *(out.column(c) for c in names)], ["leaf", *names])

    return dealt.mapInArrow(run, "leaf long, row long, id long, label long, d long, v binary")


def trees(batch: pa.RecordBatch) -> Iterator[Tree]:
    """The trees over a batch of packed rows, one per label and length."""
    label, d, leaf = (batch.column(c).to_numpy() for c in ("label", "d", "leaf"))
    ids = [(NO_ID if i is None else i, r) for i, r in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist())]
    for kind in sorted(set(zip(label.tolist(), d.tolist()))):
        own = np.flatnonzero((label == kind[0]) & (d == kind[1]))
        vectors = stacked(batch, own, kind[1])
        cuts = np.flatnonzero(np.diff(leaf[own], prepend=-1))
        # Leaves that a table's splits have joined are cut again.
        cuts = np.unique(np.concatenate([cuts, *(np.arange(a, b, LEAF) for a, b in zip(cuts, [*cuts[1:], len(own)]))]))
        yield Tree(vectors, cuts, [ids[i] for i in own], kind[0])


class Queries:
    """Anchors of one group with the searches to make: (number, window) per anchor."""

    def __init__(self, rows: list, searches: dict[int, list[tuple[int, tuple[int, int] | None]]]):
        rows = [r for r in rows if r["row"] in searches]
        self.rows = [r["row"] for r in rows]
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.lengths = np.array([r["d"] for r in rows], np.int64)
        self.vectors = [np.frombuffer(r["v"], np.float64) for r in rows]
        self.searches = [searches[r] for r in self.rows]


def searched(rows: DataFrame, queries: Queries, k: int, same_label: bool) -> DataFrame:
    """The k best rows of each search in each task's share of the packed rows."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        found = [{number: [] for number, _ in searches} for searches in q.searches]
        for batch in batches:
            for tree in trees(batch):
                fit = (q.labels == tree.label) == same_label
                own = np.flatnonzero(fit & (q.lengths == tree.vectors.shape[1]))
                if not len(own):
                    continue
                asked = np.stack([q.vectors[i] for i in own])
                intervals = tree.intervals(asked)
                for at, i in enumerate(own.tolist()):
                    bounds = [(low[at].tolist(), high[at].tolist()) for low, high in intervals]
                    scores: dict[int, np.ndarray] = {}
                    for number, window in q.searches[i]:
                        tree.search(found[i][number], k, asked[at], bounds, scores, window, q.rows[i])
        out = [(q.rows[i], number, row, None if id_ == NO_ID else id_, -minus) for i, kept in enumerate(found) for number, best in kept.items() for minus, id_, row in best]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "query", "row", "id", "score"])

    return rows.mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each search over all tasks, with their rank from 1."""
    order = Window.partitionBy("anchor", "query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    scale: float = 256.0, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); the score of two rows is their inner product as an
    integer (cut to the range of a long). An anchor's positives are its first `positives` other
    rows of its label by score, then id. For each anchor and positive: the first `negatives`
    rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score.
    `anchors` is a condition on `id` and `label`.

    Rows with a null label, a null vector or a component that is null, not finite or too large
    to be scaled take no part. Rows with a null id come last among equals and are null in the
    result. Rows that repeat an id are rows of their own. Vectors are compared only with those of
    the same length. Anchors without a positive or without a negative give no rows; an empty
    table gives none. Other columns are not read.
    """
    rows = materialise(taking_part(vectors, key, label, vector, scale), "vectors")
    chosen = rows.where(anchors).select("row", "id", "label", "d", "v")
    total = chosen.agg(F.sum(F.col("d") + 4)).first()[0] or 0
    groups = max(1, -(-total // GROUP_VALUES))
    chosen = materialise(chosen.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups))), "anchors", ("part",))
    tree = materialise(packed(rows), "packed")

    def over(part: Callable[[list], dict], k: int, same_label: bool, name: str) -> DataFrame:
        """The best k over all groups; each group's finds are written before the next is sent."""
        found = []
        for g in range(groups):
            own = chosen.where(F.col("part") == g).collect()
            found.append(materialise(searched(tree, Queries(own, part(own)), k, same_label), name))
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        return best(whole, k)

    near = materialise(over(lambda own: {r["row"]: [(0, None)] for r in own}, positives, True, "positives"), "positives")

    def windows(own: list) -> dict[int, list]:
        """A search per distinct score of an anchor's positives, numbered by the score."""
        places = [r["row"] for r in own]
        scores = near.select("anchor", "score").distinct().where(F.col("score") >= 0)
        wanted = scores.join(chosen.where(F.col("part") == own[0]["part"]).select(F.col("row").alias("anchor")), "anchor", "left_semi") if places else scores.limit(0)
        asked: dict[int, list] = {}
        for r in sorted(wanted.collect()):
            low, high = -(-least * r["score"] // 100), most * r["score"] // 100
            if low <= high:
                asked.setdefault(r["anchor"], []).append((r["score"], (low, high)))
        return asked

    far = over(windows, negatives, False, "negatives")
    names = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    kept = far.select("anchor", F.col("query").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(kept, ["anchor", "positive_score"]).join(names, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
