import re

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline

QUERIES, CHECKS = entry_module.queries(), entry_module.oracle_sql()
OWN = [n for n in QUERIES if re.fullmatch(r"op\d+_.*", n)]


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in OWN) == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", [n for n in OWN if n in CHECKS])
def test_query_equals_its_check(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(CHECKS[name])
    columns = sorted(c[0] for c in cur.description)
    assert columns == sorted(df.columns)
    place = {c[0]: i for i, c in enumerate(cur.description)}
    want = sorted(repr([r[place[c]] for c in columns]) for r in cur.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, sf):
    """The stages on few rows against what their rules say by hand."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(60)
    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    rows = [r for r in rows if r[2] == "en"][:20]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    texts = {r[0]: r[1] for r in rows}
    first = rows[0]
    words = rows[1][1].split()
    words[len(words) // 2] = "edited"
    planted = [
        (100_001, first[1].upper(), "en", "s", 1), (100_002, " ".join(words), "en", "s", 1), (100_003, rows[2][1] + " " + item, "en", "s", 1),
        (100_004, None, "en", "s", 1), (100_005, "12 34 !!", "en", "s", 1),
    ]
    base = spark.createDataFrame(rows + planted, docs.select(*corpus_pipeline.COLUMNS).schema)
    kept, seen = base, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
        seen[name] = {r.doc_id for r in kept.select("doc_id").collect()}
        if name != "bpe_encode":
            assert kept.columns == corpus_pipeline.COLUMNS
    ids = set(texts) | {p[0] for p in planted}
    assert seen["language_id"] == ids - {100_004, 100_005}
    assert seen["exact_dedup"] >= {100_001} and first[0] not in seen["exact_dedup"]
    assert 100_002 not in seen["near_dedup"] and rows[1][0] in seen["near_dedup"]
    assert 100_003 not in seen["decontaminate"]
    assert seen["bpe_encode"] == seen["decontaminate"]


def test_pipeline_stages_judge_rows_not_ids(spark, sf):
    """Null ids and repeated ids with different texts, some good, some rejected, through all stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND length(text) > 400").orderBy("doc_id").limit(12)
    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    body = lambda k: " ".join(f"{w}{k}" if i % 3 == 0 else w for i, w in enumerate(rows[k][1].split()))
    row = lambda doc_id, text, source="s": (doc_id, text, "en", source, 1)
    lone, twice, other, leaked = body(3), body(4), body(5), body(6)
    near = twice.split()
    near[len(near) // 2] = "edited"
    planted = [
        row(None, lone), row(None, "12 34 !!"), row(7_000_001, twice), row(7_000_001, other), row(7_000_001, "56 78 ??"), row(None, None),
        row(7_000_001, None), row(None, lone.upper()), row(None, " ".join(near)), row(7_000_001, leaked + " " + item), row(None, body(7) + " " + item),
        row(7_000_002, body(8), "b"), row(7_000_002, body(8), "a"), row(7_000_002, body(8), None),
    ]
    base = spark.createDataFrame(rows[:3] + planted, docs.select(*corpus_pipeline.COLUMNS).schema)
    kept, seen = base, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, kept, sf), name)
        seen[name] = sorted((r for r in map(tuple, kept.collect()) if r[0] is None or r[0] > 7_000_000), key=repr)
    want = [p for p in planted if p[1] and any(c.isalpha() for c in p[1])]
    assert seen["language_id"] == sorted(want, key=repr)
    want = [p for p in want if p not in (row(None, lone), row(7_000_002, body(8), "b"), row(7_000_002, body(8), "a"))]
    assert len(want) == 7 and seen["exact_dedup"] == sorted(want, key=repr)
    want.remove(row(None, " ".join(near)))
    assert seen["near_dedup"] == sorted(want, key=repr)
    assert seen["decontaminate"] == sorted((p for p in want if item not in p[1]), key=repr)


def test_pipeline_on_an_empty_table(spark, sf):
    """Every stage of no documents gives no documents, with its columns."""
    kept = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialise(stage(spark, kept, sf), name)
        assert kept.count() == 0
        assert kept.columns == corpus_pipeline.COLUMNS or name == "bpe_encode"
