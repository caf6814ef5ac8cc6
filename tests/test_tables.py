import random

import pytest
from pyspark.sql import functions as F

from sarani.operators import numbering
from sarani.operators.numbering import first_per_key, number_within
from sarani.operators.tables import (
    max_cells, name_tables, numeric_columns, title_index, title_of, to_cells, to_tables, unique_tables,
)
from sarani.plans.tables import ORDER_KEYS, cells_implode_large, order_tables
from sarani.sources.star import corpus_tables


def numbered_by_hand(rows):
    out, seen = {}, {}
    for key, order, tie in sorted(rows, key=lambda r: (r[1], r[2])):
        out[(key, order, tie)] = seen.get(key, 0)
        seen[key] = seen.get(key, 0) + 1
    return out


@pytest.mark.parametrize("rows_per_bucket", [10_000, 37, 5])
def test_number_within_with_a_hot_key_and_a_hot_value(spark, rows_per_bucket):
    rng = random.Random(7)
    rows = [
        ("hot" if rng.random() < 0.5 else rng.choice("abc"), 50.0 if rng.random() < 0.4 else float(rng.randrange(100)), i)
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "k string, o double, t bigint")
    got = number_within(df, ["k"], "o", "n", "total", rows_per_bucket, ("t",)).collect()
    want = numbered_by_hand(rows)
    assert {(r.k, r.o, r.t): r.n for r in got} == want
    assert {r.k: r.total for r in got}["hot"] == sum(1 for r in rows if r[0] == "hot")


def test_number_within_null_keys_and_no_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, o bigint")
    assert {(r.k, r.o): r.n for r in number_within(df, ["k"], "o", "n").collect()} == {
        (None, 1): 0, (None, 3): 1, ("a", 2): 0}
    assert {r.o: r.n for r in number_within(df, [], "o", "n", rows_per_bucket=1).collect()} == {1: 0, 2: 1, 3: 2}


def test_ranges_split_a_hot_key_and_a_hot_value(spark, monkeypatch):
    """One key and one value of the order: no task gets the whole group, and all numbers come out."""
    written = []
    real = numbering.materialise
    monkeypatch.setattr(numbering, "materialise", lambda df, name: written.append(real(df, name)) or written[-1])
    df = spark.range(3000).select(F.lit("t").alias("k"), F.lit(5).alias("o"), (F.col("id") * 7 % 3000).alias("t"))
    got = number_within(df, ["k"], "o", "n", rows_per_bucket=100, ties=("t",))
    assert all(r.n == r.t for r in got.collect()) and got.count() == 3000
    sizes = [r["count"] for r in written[0].groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400
    numbers = number_within(df.select("k", "o", "t"), [], "o", "n", rows_per_bucket=100)  # no tie-break at all
    assert sorted(r.n for r in numbers.collect()) == list(range(3000))
    named = name_tables(df.select(F.col("k").alias("title"), "t"), "t", rows_per_bucket=100)
    assert all(r.table_name == f"t_{r.t}" for r in named.collect())


def test_first_per_key_cuts_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    out = first_per_key(df, ["k"], [F.col("id")])
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_tables_of_one_priority_do_not_grow_with_the_orders(spark, tmp_path):
    keys = [*range(0, 20_000), 1_000_000, 1_000_001]
    rows = [(k, None if k % 2 else "1-URGENT", "O") for k in reversed(keys)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.table_id: (r.n_rows, r.first_key, r.last_key) for r in cells_implode_large(spark, str(tmp_path)).collect()}
    assert found == {"priority 1-URGENT": (10_001, 0, 1_000_000), None: (10_001, 1, 1_000_001)}
    tables = order_tables(spark, str(tmp_path)).collect()
    assert sum(len(t.rows) for t in tables) == len(keys) and max(len(t.rows) for t in tables) <= ORDER_KEYS
    assert all(t.header == ["key", "status"] and [int(r[0]) for r in t.rows] == sorted(int(r[0]) for r in t.rows) for t in tables)


def test_cells_and_back(spark, sf):
    t = corpus_tables(spark, sf)
    back = to_tables(to_cells(t))
    assert back.exceptAll(t.select("table_id", "header", "rows")).isEmpty()
    assert back.count() == t.count()


def test_large_tables_come_back_whole(spark):
    big = spark.createDataFrame([("t", ["a", "b"], [[str(i), "x"] for i in range(5000)])], "table_id string, header array<string>, rows array<array<string>>")
    back = to_tables(to_cells(big)).first()
    assert back.header == ["a", "b"] and back.rows == [[str(i), "x"] for i in range(5000)]


def test_unique_tables_keep_the_first_and_are_stable(spark):
    rows = [(3, "a", ["h"], [["1"]]), (1, "a", ["h"], [["1"]]), (2, "b", ["h"], [["1"]]), (4, "a", ["g"], [["1"]])]
    df = spark.createDataFrame(rows, "seq int, title string, header array<string>, rows array<array<string>>")
    once = unique_tables(df, "seq")
    assert sorted(r.seq for r in once.collect()) == [1, 2, 4]
    assert sorted(r.seq for r in unique_tables(once, "seq").collect()) == [1, 2, 4]


def test_title_of(spark):
    df = spark.createDataFrame([("a_b_12",), ("abc",)], "n string")
    assert [r[0] for r in df.select(title_of(F.col("n"))).collect()] == ["a_b", "ab"]


def test_numeric_columns(spark):
    values = {"1": True, "१२": True, "": False, "-1": False, "2.5": False, "x": False, "½": True}
    rows = [("t", 0, i, f"h{i}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "table_id string, row_no int, col_no int, header string, value string")
    got = {r.col_no: r.is_numeric for r in numeric_columns(df).collect()}
    assert [got[i] for i in range(len(values))] == list(values.values())


def test_max_cells_counts_real_cells(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [["1", "2"]] * 3)], "id int, header array<string>, rows array<array<string>>")
    assert max_cells(df, 6).count() == 1 and max_cells(df, 5).count() == 0


def test_title_index_is_cut_into_chunks(spark):
    df = spark.range(25).select(F.lit("t").alias("title"), F.col("id"))
    got = title_index(name_tables(df, "id"), chunk=10).orderBy("chunk_no").collect()
    assert [len(r.table_names) for r in got] == [10, 10, 5]
    assert got[1].table_names[0] == "t_10"


def test_numbering_of_one_value_with_text_ties(spark):
    df = spark.range(900).select(F.lit(5).alias("o"), F.concat(F.lit("k"), F.lpad(((F.col("id") * 7919) % 900).cast("string"), 4, "0")).alias("t"))
    out = number_within(df, [], "o", "no", rows_per_bucket=100, ties=("t",)).collect()
    assert [r.t for r in sorted(out, key=lambda r: r.no)] == sorted(r.t for r in out) and sorted(r.no for r in out) == list(range(900))
    few = number_within(df.limit(10), [], "o", "no", ties=("t",)).collect()
    assert [r.t for r in sorted(few, key=lambda r: r.no)] == sorted(r.t for r in few)
    by_text = number_within(df, [], "t", "no", rows_per_bucket=100).collect()
    assert [r.t for r in sorted(by_text, key=lambda r: r.no)] == sorted(r.t for r in by_text)
