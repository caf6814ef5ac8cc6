import sqlite3
from collections import Counter

from pyspark.sql import Row, functions as F

from sarani.operators import families as fam
from sarani.operators import records
from sarani.operators import templates as tem
from sarani.operators.records import answers_in_record, bound_in_record
from sarani.plans.sample_job import bound_pairs, build_samples, skipped_pairs
from sarani.sources.star import corpus_rows, corpus_tables


def test_pair_by_join_equals_pair_by_array(spark, sf, monkeypatch):
    t, templates = corpus_tables(spark, sf), tem.template_list(spark)
    keys = lambda df: {(r.table_id, r.template_id) for r in df.select("table_id", "template_id").collect()}
    by_array = keys(tem.pair(t, templates))
    monkeypatch.setattr(tem, "ARRAY_TEMPLATES", 0)
    joined = tem.pair(t, templates)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Cross" not in plan
    assert keys(joined) == by_array


def test_same_slot_gets_the_same_column_and_numbers_a_numeric_one(spark, sf):
    bound = tem.bind(corpus_tables(spark, sf), tem.template_list(spark))
    for r in bound.select("slots", "slot_cols", "numeric_cols", "template_id").collect():
        assert len(set(r.slots)) == len(r.slots) == len(r.slot_cols)
        for slot, col in zip(r.slots, r.slot_cols):
            assert "number" not in slot or col in r.numeric_cols


def test_tables_without_numbers_skip_numeric_templates(spark):
    t = spark.createDataFrame(
        [("t", "t", ["a"], [["x"], ["y"]])], "table_id string, title string, header array<string>, rows array<array<string>>"
    )
    bound = tem.bind(t, tem.template_list(spark))
    assert not [r for r in bound.select("slots").collect() if any("number" in s for s in r.slots)]
    assert bound.count() > 0


def test_empty_table_binds_no_literal(spark):
    t = spark.createDataFrame(
        [("t", "t", ["a"], [])], "table_id string, title string, header array<string>, rows array<array<string>>"
    )
    got = tem.bind(t, tem.template_list(spark)).select("lits").collect()
    assert got and all(r.lits == [] for r in got)


def test_quotes_in_literals_are_doubled(spark):
    t = spark.createDataFrame(
        [("t", "t", ["a"], [['say "x"']])], "table_id string, title string, header array<string>, rows array<array<string>>"
    )
    sql = [r.sql for r in bound_pairs(t, ("project_where",)).collect()]
    assert 'select `a` from `t` where `a` = "say ""x"""' in sql


def test_unclosed_aggregate_keeps_its_text(spark, sf):
    tokens = [("Keyword", "select"), ("Keyword", "count"), ("Keyword", "("), ("Column", "c1")]
    templates = spark.createDataFrame(
        [(1, "x", "", [{"kind": k, "value": v} for k, v in tokens])], tem.TEMPLATE
    )
    sql = tem.render_sql(tem.bind(corpus_tables(spark, sf), templates)).first().sql
    assert sql.startswith("select count(`")


def test_answers_equal_those_of_a_database(spark, sf):
    """Every rendered SQL text run on its own table by sqlite, where dialects agree."""
    tables = corpus_tables(spark, sf)
    bound = bound_pairs(tables).cache()
    answers = {}
    for r in fam.execute(bound).collect():
        answers.setdefault((r.table_id, r.template_id), []).append((r.row_no, r.value))
    con = sqlite3.connect(":memory:")
    numeric = {}
    for t in bound.select("table_id", "header", "rows", "numeric_cols").dropDuplicates(["table_id"]).collect():
        numeric[t.table_id] = t.numeric_cols
        kinds = [f"`{h}` {'INTEGER' if i in t.numeric_cols else 'TEXT'}" for i, h in enumerate(t.header)]
        con.execute(f"CREATE TABLE `{t.table_id}` ({', '.join(kinds)})")
        con.executemany(f"INSERT INTO `{t.table_id}` VALUES ({','.join('?' * len(t.header))})", t.rows)
    con.create_function("subtract", 2, lambda a, b: None if a is None or b is None else a - b)
    rows = {t.table_id: t.rows for t in tables.collect()}

    def fixed(r):
        """Whether the query has one answer in any database: no tie, no look-up of several rows."""
        slot = lambda k: [v[r.slot_cols[k]] for v in rows[r.table_id]]
        if r.family == "most_frequent":
            counts = sorted(Counter(slot(0)).values())
            return counts[-2:] != counts[-1:] * 2
        if r.family == "superlative":
            return [float(x) for x in slot(1)].count(max(map(float, slot(1)))) == 1
        if r.family == "lowest_k":
            return len(set(sorted(map(float, slot(1)))[:4])) == min(4, len(slot(1)))
        if r.family == "difference":
            return all(slot(1).count(x) <= 1 for x in r.lits)
        if r.family == "subtract":
            return all(i in numeric[r.table_id] for i in r.slot_cols[:2])
        return True

    checked = Counter()
    for r in bound.select("table_id", "template_id", "family", "sql", "slot_cols", "lits").collect():
        if not fixed(r):
            continue
        text = r.sql.replace("between \"", "between 0+\"").replace("and \"", "and 0+\"") if r.family == "between" else r.sql
        want = [row[0] for row in con.execute(text).fetchall()]
        got = [v for _, v in sorted(answers.get((r.table_id, r.template_id), []))]

        def plain(values):
            out = []
            for v in values:
                try:
                    out.append(round(float(v), 4))
                except (TypeError, ValueError):
                    out.append(v)
            return sorted(out, key=str)

        assert plain(got) == plain(want), r.sql
        checked[r.family] += 1
    assert sum(checked.values()) > 200 and set(checked) == set(fam.FAMILIES)


def test_joined_rows_give_the_same_answers(spark, sf, monkeypatch):
    """Large tables: rows joined in by blocks instead of carried along."""
    monkeypatch.setattr(fam, "ROW_BLOCK", 7)
    bound = bound_pairs(corpus_tables(spark, sf))
    rows = corpus_rows(spark, sf)
    flat = bound.withColumn("n_rows", F.size("rows")).drop("rows")
    a, b = fam.execute(bound), fam.execute(flat, rows)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_samples_are_distinct_and_answered(spark, sf):
    got = build_samples(corpus_tables(spark, sf)).collect()
    assert len({(r.table_id, r.sql) for r in got}) == len(got) > 0
    assert all('"data":[[' in r.answer for r in got)


def plain_answers(rows):
    out = {}
    for r in rows:
        out.setdefault((r.table_id, r.template_id), []).append((r.row_no, r.value))
    return {k: sorted(v, key=lambda x: (x[0], x[1] is not None, x[1] or "")) for k, v in out.items()}


def test_records_give_the_pairs_and_answers_of_the_jobs(spark, sf):
    """Binding, SQL and answers inside the record equal those of pairs as rows and of the family jobs."""
    odd = spark.createDataFrame([
        ("odd_1", "t", ["a", "n`m", "b"], [["x", "1", None], ["x", "২", "y"], [None, "3", "y"], ["z", "", "x"], ["\\", "5", "%"], ['q"', "-1", "y"]]),
        ("odd_2", "t", ["a"], []), ("odd_3", "t", ["n"], [["1"], ["2"], ["2"]]), ("odd_4", "t", ["a", "n"], [["x", "1"]]),
        ("odd_5", "t", [f"c{i}" for i in range(6)], [[str((i * k) % 3) for i in range(6)] for k in range(12)]),
    ], "table_id string, title string, header array<string>, rows array<array<string>>")
    tables = corpus_tables(spark, sf).select(*odd.columns).union(odd).cache()
    for seed in (42, 7, 8, 9):
        bound = bound_pairs(tables, seed=seed).cache()
        in_record = bound_in_record(tables, tem.template_list(spark), seed=seed).cache()
        pairs = in_record.select("table_id", F.inline("pairs"))
        first = {}
        for r in sorted(bound.select("table_id", "sql", "template_id").collect()):
            first.setdefault((r.table_id, r.sql), r.template_id)
        assert {(r.table_id, r.sql): r.template_id for r in pairs.collect()} == first and pairs.count() == len(first)
        chosen = {(t, k) for (t, _), k in first.items()}
        want = {k: v for k, v in plain_answers(fam.execute(bound).collect()).items() if k in chosen}
        found = answers_in_record(in_record).collect()
        got = plain_answers([Row(table_id=r.table_id, template_id=r.template_id, **a.asDict()) for r in found for a in r.answer_rows])
        assert got == want
        assert all(list(r.answer_rows) == sorted(r.answer_rows, key=lambda a: (a.row_no, a.value is not None, a.value or "")) for r in found)


def test_samples_of_files_are_made_without_a_shuffle(spark, sf, tmp_path):
    corpus_tables(spark, sf).write.parquet(str(tmp_path / "tables"))
    plan = build_samples(spark.read.parquet(str(tmp_path / "tables")))._jdf.queryExecution().executedPlan().toString()
    # The templates are gathered by a sub-query of their own; the tables meet no exchange and no join.
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def test_templates_in_parts_give_the_same_samples(spark, sf, monkeypatch):
    tables = corpus_tables(spark, sf)
    want = build_samples(tables)
    monkeypatch.setattr(records.template_parts, "__defaults__", (5,))
    assert len(records.template_parts(tem.template_list(spark))) == 6
    got = build_samples(tables)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_pair_that_cannot_be_answered_is_skipped_and_counted(spark, sf):
    tables = corpus_tables(spark, sf)
    extra = spark.createDataFrame([(900, "no_such", "", [{"kind": "Keyword", "value": "select"}, {"kind": "Column", "value": "c1"}])], tem.TEMPLATE)
    templates = tem.template_list(spark).unionByName(extra)
    got, want = build_samples(tables, templates=templates), build_samples(tables)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    counted = {r.reason: r.n_pairs for r in skipped_pairs(tables, templates).collect()}
    pairs = bound_in_record(tables, templates).select(F.inline("pairs")).count()
    assert counted["unknown family no_such"] == tables.count() and counted["no answer"] == pairs - want.count() - tables.count()


def test_answers_of_large_tables_come_in_blocks(spark):
    rows = [("t", 1, i, f"v{i}") for i in range(0, 95, 3)] + [("t", 2, 0, f"w{i}") for i in range(40)] + [("t", 3, 0, "x")]
    answers = spark.createDataFrame(rows, "table_id string, template_id int, row_no int, value string")
    blocks = fam.answer_blocks(answers, 10).collect()
    assert {r.block for r in blocks if r.template_id == 1} == set(range(10)) and {r.block for r in blocks if r.template_id == 3} == {0}
    for r in blocks:
        assert r.template_id != 1 or [a.row_no // 10 for a in r.answer_rows] == [r.block] * len(r.answer_rows)
    assert 1 < len([r for r in blocks if r.template_id == 2]) <= 4
    assert sorted((r.table_id, r.template_id, a.row_no, a.value) for r in blocks for a in r.answer_rows) == sorted(rows)


def test_a_key_with_most_rows_is_spread(spark):
    """in and not_in on one table whose key column is nearly one value, with nulls, by blocks of rows."""
    values = [[str(i), None if i % 50 == 7 else "hot" if i % 3 else f"k{i % 9}", "L" if i in (3, 5) else "x"] for i in range(300)]
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "table_id string, row_no int, values array<string>")
    for family in ("in_subquery", "not_in"):
        bound = spark.createDataFrame([("t", 1, family, "", [0, 1, 2], ["L"], 300)], "table_id string, template_id int, family string, func string, slot_cols array<int>, lits array<string>, n_rows int")
        got = sorted(int(r.value) for r in fam.execute_family(bound, family, rows).collect())
        inner = {v[1] for v in values if v[2] == "L"}
        assert got == [i for i, v in enumerate(values) if v[1] is not None and (v[1] in inner) == (family == "in_subquery")]


def _bound(spark, family, literal):
    schema = "table_id string, template_id int, family string, func string, slot_cols array<int>, lits array<string>, rows array<array<string>>"
    return spark.createDataFrame([("t", 1, family, "", [0, 1], [literal], [["1", "a\\b"], ["2", "a%b"], ["3", "a_b"], ["4", "axb"]])], schema)


def test_like_takes_a_backslash_as_it_is(spark):
    answers = lambda literal: sorted(r.value for r in fam.execute_family(_bound(spark, "like", literal), "like").collect())
    assert answers("a\\b") == ["1"] and answers("%\\%") == ["1"] and answers("a_b") == ["1", "2", "3", "4"] and answers("a%") == ["1", "2", "3", "4"]


def test_an_unknown_family_is_reported(spark):
    bound = _bound(spark, "no_such", "x")
    assert [tuple(r) for r in fam.unknown_families(bound).collect()] == [("t", 1, "no such family: no_such")]
    assert fam.execute(bound).count() == 0


def test_backticks_in_names_are_doubled(spark):
    t = spark.createDataFrame([("t`1", "t", ["a`b"], [["x"]])], "table_id string, title string, header array<string>, rows array<array<string>>")
    got = {r.sql: r.answer for r in build_samples(t, ("project_where",)).collect()}
    assert list(got) == ['select `a``b` from `t``1` where `a``b` = "x"'] and '"columns":["a`b"]' in list(got.values())[0]
