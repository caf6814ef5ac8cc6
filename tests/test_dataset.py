from pyspark.sql import functions as F

from sarani.functions.linear import linearise, parse_linearised
from sarani.operators import dataset as ds
from sarani.operators.tables import fan_out_rows
from sarani.sources.corpus import open_corpus, read_samples, read_table, read_tables, replace_tables, save_corpus, write_tables
from sarani.plans.corpus_job import parsed_tables, raw_records
from sarani.plans.storage import event_samples
from sarani.plans.sqltext import WORDS
from sarani.session import scratch_path
from sarani.sources.star import html_pages
from sarani.operators.rewriting import convert_samples
from sarani.streaming import incremental
from sarani.streaming.incremental import read_converted, read_sample_stream, resume_convert


def test_batches(spark):
    df = spark.range(25).withColumn("k", F.col("id") % 2)
    kept = ds.batches(df, 4, "id", ["k"], drop_last=True, rows_per_bucket=3)
    sizes = {(r.k, r.batch_id): r["count"] for r in kept.groupBy("k", "batch_id").count().collect()}
    assert set(sizes.values()) == {4} and len(sizes) == 6
    stacked = ds.stack_batches(ds.batches(df, 10, "id"), ["id"])
    assert {r.batch_id: r.id for r in stacked.collect()} == {
        0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 25))}


def test_fit_length(spark):
    df = spark.createDataFrame([(0, "a b c d"), (0, "a"), (1, "b b")], "batch_id int, text string")
    rows = ds.fit_length(df, "text", ["batch_id"], 3).orderBy("batch_id", "text").collect()
    assert [len(r.input_ids) for r in rows] == [3, 3, 2]
    assert rows[0].attention_mask == [1, 0, 0] and rows[0].input_ids[1:] == [ds.PAD_ID] * 2
    assert rows[0].input_ids[0] == rows[1].input_ids[0] and rows[2].input_ids[0] == rows[2].input_ids[1]


def test_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(100)
    a = [r.id for r in ds.shuffle(df, "id", 1).collect()]
    assert a == [r.id for r in ds.shuffle(df.repartition(7), "id", 1).collect()] != list(range(100))
    ranked = {r.id: r["rank"] for r in ds.shuffle_rank(df, "id", 1).collect()}
    assert [ranked[i] for i in a] == list(range(100))


def test_restore_labels(spark):
    assert spark.range(1).select(ds.restore_labels(F.array(F.lit(5), F.lit(-100)), 1)).first()[0] == [5, 1]


def test_demonstrations_have_the_published_answers(spark):
    """Counting and summing over the fanned-out rows gives the printed answers."""
    for lang, needle, want in (("bn", "কাউন্টডাউন", 3), ("hi", "2019", 3)):
        first = ds.demonstrations(lang).split("\n")[2]
        table = first[first.index(ds.COLUMN_MARKS[lang]):]
        df = spark.createDataFrame([(table,)], "t string")
        cells = df.select(parse_linearised(F.col("t"), lang)["cells"]).first()[0]
        assert cells.count(needle) == want
    second = ds.demonstrations("hi").split("\n")[4]
    table = second[second.index("<कलाम>"):]
    rows = spark.createDataFrame([(table,)], "t string").select(parse_linearised(F.col("t"), "hi")["rows"]).first()[0]
    assert sum(int(r.split(" | ")[5]) for r in rows) == 18
    assert ds.demonstrations("bn").endswith("<কলাম> গণনা(`বছর`) <রো ১> ৩\n")


def test_fan_out_gives_the_demonstration_table(spark):
    films = [
        "2006 | সি নো ইভল | জেকব গুড নাইট", "2010 | ম্যাকগ্রাবার | ট্যাংকার লুতিয",
        "2014 | স্কুবি-ডো! রেসলম্যানিয়া মিস্টরি | নিজে", "2014 | সী নো ইভল ২ | জেকব গুড নাইট", "2016 | কাউন্টডাউন | লেঃ ক্রোনিন",
    ]
    films = [t.split(" | ") for t in films]
    df = spark.createDataFrame([(["বছর", "শিরোনাম", "ভূমিকা"], films)], "header array<string>, rows array<array<string>>")
    line = fan_out_rows(df).select(linearise(F.col("header"), F.col("rows"), "bn")).first()[0]
    assert line in ds.demonstrations("bn")


def test_prompts(spark):
    row = ds.few_shot_prompts(spark.createDataFrame([("q",)], "source string"), "hindi").first()
    assert row.user == ":सवाल: q\nउत्तर: " and row.system.startswith(ds.INSTRUCTIONS["hi"] + "\n\nउदाहरण:\n१) सवाल: ")


def test_qa_examples_parse_back(spark, sf):
    s = event_samples(spark, sf).withColumn("question", F.lit("how many"))
    row = ds.qa_examples(s, "bn").first()
    assert row.source.startswith("how many <কলাম> value <রো ১> ") and row.target.startswith("<কলাম> count <রো ১> ")


def test_raw_tables_round_trip(spark, sf):
    good, _ = parsed_tables(html_pages(spark, sf))
    path = scratch_path(spark, "raw")
    raw = raw_records(good)
    write_tables(raw, path)
    back = read_tables(spark, path)
    assert back.exceptAll(raw).isEmpty() and back.count() == raw.count()


def test_dictionary_ids_are_dense_and_differ(spark):
    texts = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 11))) for i in range(200)] + [(900, None), (901, " ")]
    df = spark.createDataFrame(texts, "id long, text string")
    words = {w for _, t in texts for w in (t or "").split()}
    found = {r.word: r.id for r in ds.word_dictionary(df, "text").collect()}
    assert set(found) == words and sorted(found.values()) == list(range(4, 4 + len(words)))
    assert {r.word: r.id for r in ds.word_dictionary(df.repartition(7), "text", rows_per_bucket=10).collect()} == found
    dictionary = spark.createDataFrame([r for r in found.items() if r[0] != "w5"], "word string, id long")
    for most in (200_000, 0):
        got = {r.id: r.ids for r in ds.dictionary_ids(df, "text", dictionary, "id", 6, most).collect()}
        assert got == {i: [3 if w == "w5" else found[w] for w in (t or "").split()[:6]] for i, t in texts}


def test_the_words_of_a_dictionary_are_made_once(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c b"), (None, None)], "id long, text string")
    for rows in (1, 200_000):
        found = ds.word_dictionary(df, "text", rows_per_bucket=rows)
        assert sorted(r.id for r in found.collect()) == [4, 5, 6]
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_replacing_tables_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "corpus")
    table = lambda name, v: (name, ["h"], [[v]])
    schema = "table_name string, header array<string>, rows array<array<string>>"
    first = [table(f"t_{i}", "old") for i in range(50)]
    save_corpus(spark.createDataFrame(first, schema), path, 8)
    new = [table("t_7", "new"), table("t_99", "added"), table("t_3", "new")]
    replace_tables(spark.createDataFrame(new, schema), path, 8)
    replace_tables(spark.createDataFrame([], schema), path, 8)
    want = {name: rows[0][0] for name, _, rows in first + new}
    assert {r.table_name: r["rows"][0][0] for r in open_corpus(spark, path).collect()} == want
    assert open_corpus(spark, path).count() == 51
    one = read_table(open_corpus(spark, path), "t_7", 8)
    assert one.columns == ["table_name", "header", "rows"] and [r["rows"] for r in one.collect()] == [[["new"]]]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(table_name,t_7)" in plan
    assert read_table(open_corpus(spark, path), "none", 8).count() == 0


def test_stream_resumes_after_a_killed_step_and_equals_batch(spark, sf, monkeypatch):
    """Steps of one file each; one is killed after its samples were written, one before."""
    source, out, checkpoint = (scratch_path(spark, x) for x in ("s-in", "s-out", "s-checkpoint"))
    samples = event_samples(spark, sf).cache()
    words = spark.createDataFrame(list(WORDS.items()), "source string, target string")
    third = F.floor(F.col("event_id") / (samples.agg(F.max("event_id")).first()[0] / 3 + 1))
    stream = lambda: read_sample_stream(spark, source, "event_id bigint", files=1)
    real, killed = incremental.write_step, []

    def write_and_die(batch, step, *rest):
        if step == 1:
            real(batch, step, *rest)
        if step in (1, 2) and killed.count(step) == 0:
            killed.append(step)
            raise RuntimeError("killed")
        real(batch, step, *rest)

    monkeypatch.setattr(incremental, "write_step", write_and_die)
    for part in range(3):
        samples.filter(third == part).coalesce(1).write.mode("append").json(source)
        for _ in range(2):
            try:
                resume_convert(stream(), out, checkpoint, "bn", words, "event_id")
            except Exception as e:
                assert "killed" in str(e)
    resume_convert(stream(), out, checkpoint, "bn", words, "event_id")
    assert killed == [1, 2]
    got = read_converted(spark, out).drop("step")
    want = convert_samples(read_samples(spark, source, "event_id bigint"), "bn", words, "event_id").select(got.columns)
    assert got.count() == samples.count() and got.exceptAll(want).isEmpty()
    ledger = sorted(tuple(r) for r in spark.read.schema("first long, n long, step long").parquet(f"{out}/_ledger").select("step", "first", "n").collect())
    assert [s[0] for s in ledger] == [-1, 0, 1, 2] and all(b[1] == a[1] + a[2] for a, b in zip(ledger, ledger[1:]))


def test_scratch_path_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path.startswith(shared or "/") and path != scratch_path(spark, "x")
