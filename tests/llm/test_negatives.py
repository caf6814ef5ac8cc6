import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import sarani.llm.hard_negatives as module
from sarani.llm.box_tree import LEAF, LONG, Tree, dot, tiles
from sarani.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=5, positives=5, negatives=3, least=50, most=95):
    """All pairs in plain Python; rows are (id, vector, label)."""
    taking = [(i, [math.floor(256 * float(x)) for x in v], label, n) for n, (i, v, label) in enumerate(rows)
              if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, label, n in taking:
        if i is None or i % every:
            continue
        score = lambda o: max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(v, o[1]))))  # noqa: B023, E731
        others = sorted((o for o in taking if o[3] != n and len(o[1]) == len(v)), key=lambda o: (-score(o), o[0] is None, o[0] or 0, o[3]))
        for p in [o for o in others if o[2] == label][:positives]:
            fit = [o for o in others if o[2] != label and least * score(p) <= 100 * score(o) <= most * score(p)]
            out += [(i, p[0], k + 1, o[0], score(p), score(o)) for k, o in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


def mined(spark, rows, every=5):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("v", F.lit(2)).withColumn("score", F.lit(3))
    found = hard_negatives(df, F.col("id") % every == 0)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


def f32(values):
    return [float(np.float32(x)) for x in values]


def test_tiles_hold_every_row_once_in_narrow_boxes():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(5000, 3))
    found = list(tiles(vectors))
    assert sorted(np.concatenate(found).tolist()) == list(range(5000)) and max(map(len, found)) <= LEAF
    spans = np.mean([np.ptp(vectors[t], axis=0) for t in found], axis=0)
    assert (spans < 0.6 * np.mean([np.ptp(vectors[rng.permutation(5000)[:LEAF]], axis=0) for _ in range(20)], axis=0)).all()
    assert [t.tolist() for t in tiles(np.zeros((3, 0)))] == [[0, 1, 2]]


def test_search_prunes_boxes_and_finds_the_best():
    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.normal(size=(6000, 4)))
    order = list(tiles(vectors))
    starts = np.cumsum([0, *map(len, order)])[:-1]
    packed = vectors[np.concatenate(order)]
    tree = Tree(packed, starts, [(int(i), int(i)) for i in np.concatenate(order)], 0)
    opened = 0
    for q in np.floor(256 * rng.normal(size=(40, 4))):
        all_scores = vectors @ q
        bounds = [(a[0].tolist(), b[0].tolist()) for a, b in tree.intervals(q[None])]
        for window in (None, (1000, 60_000), (-500, 500), (5, 4)):
            found, scores = [], {}
            tree.search(found, 5, q, bounds, scores, window)
            low, high = window or (-1e30, 1e30)
            want = sorted((-int(s), i, i) for i, s in enumerate(all_scores) if low <= s <= high)[:5]
            assert found == want
            opened += len(scores) * (window is None)
    assert opened < 40 * len(starts) / 3


def test_products_are_exact_beyond_doubles():
    a = np.array([[2.0**40, 3.0], [1.0, -1.0]])
    assert dot(a, a).tolist() == [[2**80 + 9, 2**40 - 3], [2**40 - 3, 2]]


def test_negatives_equal_brute_force(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.2) for _ in range(6)] for _ in range(4)]
    rows = [(i, f32(c + rng.gauss(0, 0.1) for c in centres[i % 4]), rng.randrange(3)) for i in range(400)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(150)]  # one vector that very many rows hold
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2002, f32([float("nan")] * 6), 1), (2005, f32([float("inf")] * 6), 1), (2010, [None, *rows[0][1][1:]], 1)]
    rows += [(None, rows[3][1], 0), (None, rows[3][1], 1), (3000, [], 1), (3005, [], 2), (3010, rows[0][1][:3], 1), (3015, rows[4][1][:3], 1), (3016, rows[4][1][:3], 2)]
    rows += [(50, rows[7][1], 0), (50, rows[7][1], 0)]  # repeated rows
    rows += [(4000 + 5 * i, f32([1e9 + i, 1e9, 3.0]), i % 2) for i in range(8)]  # scores beyond a long
    assert mined(spark, rows) == brute(rows)


def test_small_ranges_and_groups_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, f32(rng.gauss(0.1, 0.2) for _ in range(4)), rng.randrange(2)) for i in range(900)]
    want = brute(rows)
    monkeypatch.setattr(module, "RANGE_VALUES", 1000)
    monkeypatch.setattr(module, "GROUP_VALUES", 500)
    assert mined(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(0, [0.5], 1)], [(0, [0.5], 1), (1, [0.5], 1)], [(1, [0.5], 1), (2, [0.4], 2)]])
def test_too_few_rows_give_none(spark, rows):
    assert mined(spark, rows) == []
