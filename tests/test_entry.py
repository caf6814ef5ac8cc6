import json
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# Queries of the parts that may be left out have tests of their own.
OWN = lambda name: not re.fullmatch(r"op\d+_.*|pipeline", name)
QUERIES = {n: q for n, q in entry_module.queries().items() if OWN(n)}
CHECKS = {n: c for n, c in entry_module.oracle_sql().items() if OWN(n)}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows
    )


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_equals_its_check(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(CHECKS[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"incremental_convert", "incremental_convert_lexicon"}))
def test_plans_are_native_and_free_of_cross_joins(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["table_id", "sql", "source", "target"] and df.count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ()])
def test_entry_imports_without_the_optional_parts(tmp_path, left_out):
    """A copy without the subpackage, and also without the pipeline, registers all other queries."""
    root = Path(entry_module.__file__).parent
    shutil.copytree(root / "sarani", tmp_path / "sarani", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(left_out):
        shutil.copy(root / name, tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=dict(os.environ, PYTHONPATH=""), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names, checks = json.loads(done.stdout)
    assert set(names) == (set(QUERIES) if left_out else set(entry_module.queries())) and set(checks) <= set(names)
