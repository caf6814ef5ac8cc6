import re

import pytest
from pyspark.sql import functions as F

from sarani.functions.languages import (
    KEYWORDS, in_script, keyword_lexicon, language_of, lexicon_entries, number_of, translate_digits,
)
from sarani.functions.linear import linearise, parse_linearised
from sarani.functions.text import SPACES, normalise_prediction, split_words, strip_text
from sarani.operators import lookup
from sarani.operators.rewriting import (
    clean_table_token, convert_samples, drop_table_clause, translate_answer, translate_digit_tokens,
    translate_keywords, translate_words,
)
from sarani.plans import rewriting  # noqa: F401  (registers the queries)
from sarani.plans.registry import QUERIES
from sarani.plans.sqltext import part_samples
from sarani.session import spread
from sarani.sources.star import corpus_tables, load


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_strip_and_split_as_python(spark):
    values = ["  a b ", "　x ", "\x1c\x85y \n", "", " \t", "a​b ", "a  b c"]
    assert apply(spark, values, strip_text) == [v.strip() for v in values]
    assert apply(spark, values, split_words) == [v.split() for v in values]
    assert all(c.isspace() for c in SPACES)


def test_every_character_splits_as_in_python(spark):
    values = [f"a{chr(i)}b" for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    assert apply(spark, values, split_words) == [v.split() for v in values]
    plan = spark.range(1).select(split_words(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert r"\x{2000}" not in plan and r"\x{85}" not in plan


def test_normalise(spark):
    assert apply(spark, [" A\n\rB\nC "], normalise_prediction) == ["a b c"]


@pytest.mark.parametrize("lang", list(KEYWORDS))
def test_keywords_are_tried_longest_first(spark, lang):
    entries = lexicon_entries(lang)
    lengths = [len(k) for k, _ in entries]
    assert lengths == sorted(lengths, reverse=True)
    text = "SELECT avg(x) FROM w GROUP BY y ORDER BY min(z) DESC"
    want = text
    for k, v in entries:
        want = want.replace(k, v)
    assert apply(spark, [text], lambda c: translate_keywords(c, lang)) == [want]
    assert keyword_lexicon(spark, lang).count() == len(entries)


def test_lower_case_takes_the_upper_case_word():
    assert dict(lexicon_entries("odia"))["sum"] == KEYWORDS["or"]["SUM"]
    assert dict(lexicon_entries("assamese"))["max"] == KEYWORDS["as"]["MAX"]


def test_word_bounded_keywords_leave_names_alone(spark):
    text = 'select `on in` from `as` where name in ("or", inside) group by point'
    got = apply(spark, [text], lambda c: translate_keywords(c, "bn", word_bounded=True))[0]
    assert "`on in`" in got and "`as`" in got and '"or"' in got and "inside" in got and "point" in got
    assert "দল করা" in got and " group by " not in got


def test_digit_tokens(spark):
    values = ["7 12 (3432)? 3342-2343 a12 1.5 x", "  12   7 ", '"12"']
    got = apply(spark, values, lambda c: translate_digit_tokens(c, "bn"))
    assert got == ["7 ১২ (৩৪৩২)? ৩৩৪২-২৩৪৩ a12 ১.৫ x", "১২ 7", '"১২"']
    changed = {
        "1": False, "12": True, "1-2": True, "-12": True, "১২": False, "১2": True, "12%": True, "12x": False,
        "x12": False, "(1)": False, "1,234": True, "12?'": True, "1--2": True, "1-": False, "12-": True,
        "1-২৩": True, "12-২৩.4)": True, "1?2": False, "9" * 5000 + "x": False, "9" * 5000: True,
    }
    kept = apply(spark, list(changed), lambda c: translate_digit_tokens(c, "hi"))
    assert [k != t for k, t in zip(kept, changed)] == list(changed.values())


def test_digits_of_unknown_language_stay(spark):
    assert language_of("French") is None
    assert apply(spark, ["a1"], lambda c: translate_digits(c, "french")) == ["a1"]
    assert apply(spark, ["১২.৫", "x", "-3"], number_of) == [12.5, None, -3.0]


def test_in_script_equals_the_pattern(spark):
    import regex

    pattern = regex.compile(r"\P{L}*\p{Bengali}+(?:\P{L}+\p{Bengali}+)*\P{L}*")
    values = ["বই", "১২", "12", "বই১২x", "x", "`বই`", "বই পড়া", "বইक", "", "?", "১" * 40 + "a", "ক-খ"]
    assert apply(spark, values, lambda c: in_script(c, "bn")) == [bool(pattern.fullmatch(v)) for v in values]


def test_table_tokens(spark):
    cleaned = {"`x_y_12`": "`x y", "x_y": "x_y", "a_1b": "a_1b", "_5": "", "plain": "plain", '`q_"': "`q", "a_b_": "a b"}
    assert apply(spark, list(cleaned), clean_table_token) == list(cleaned.values())


def test_drop_table_clause(spark):
    text = "চয়ন থেকে `t_1` যেখানে"
    assert apply(spark, [text], lambda c: drop_table_clause(c, "bn", F.lit("t_1"))) == ["চয়ন  যেখানে"]


def test_translate_answer(spark):
    values = [
        '{"columns":["name","max(size)"],"index":[0,1],"data":[["a1","-5"],["2b","7.5"]]}',
        '{"columns":["name"],"index":[],"data":[]}',
    ]
    got = apply(spark, values, lambda c: translate_answer(c, "bn"))
    assert got[0] == '{"columns":["name","সর্বোচ্চ(size)"],"index":[0,1],"data":[["a1","-৫"],["২b","৭.৫"]]}'
    assert got[1] is None


def test_words_by_join_equal_words_by_hand(spark, sf, monkeypatch):
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    empty = spark.createDataFrame([(-1, " ", "xx")], docs.schema)
    docs = docs.unionByName(empty)
    lexicon = spark.createDataFrame([("the", "টি"), ("of", "এর"), ("and", "এবং")], "source string, target string")
    table = {r.source: r.target for r in lexicon.collect()}

    def by_hand(text):
        out = []
        for w in text.split():
            core = re.sub(r"^[^\w]+|[^\w]+$", "", w.replace("_", "\x00")).replace("\x00", "_")
            out.append(w.replace(core, table[core], 1) if core in table else w)
        return " ".join(out)

    want = {r.doc_id: by_hand(r.text) for r in docs.collect()}
    def check(most, hot_parts=10_000, few=None):
        monkeypatch.setattr(lookup, "HOT_PARTS", hot_parts)
        got = translate_words(docs, lexicon, "bn", {"indic": split_words(F.col("text"))}, "doc_id", most)
        assert {r.doc_id: r.indic for r in got.collect()} == want
        assert got.select(docs.columns).exceptAll(docs).isEmpty()

    check(200_000)  # inside the record
    monkeypatch.setattr(lookup, "RECORD_ROWS", 0)
    check(200_000)  # broadcast
    check(0)  # hot words by broadcast
    check(0, hot_parts=2)  # some hot, some by shuffle
    check(0, hot_parts=0)  # all by shuffle


def test_hot_words_are_split_from_the_rest(spark):
    """A third of the words are one word; only rare ones meet in the shuffled join."""
    words = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 1500)).alias("source"))
    words = words.unionByName(spark.range(5).select((F.col("id") + 9000).alias("id"), F.lit(None).cast("string").alias("source")))
    table = spark.createDataFrame([("hot", "H"), ("w1", "A"), ("w2", "B"), ("none", "N")], "source string, target string")
    found = lookup.look_up(words, table, 0)
    assert found.count() == words.count()
    got = {(r.source, r.target) for r in found.select("source", "target").distinct().collect()}
    assert {g for g in got if g[1]} == {("hot", "H"), ("w1", "A"), ("w2", "B")} and (None, None) in got


def test_large_look_up_ends_on_a_repeated_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, text string")
    lexicon = spark.createDataFrame([("a", "x")], "source string, target string")
    words = {"out": split_words(F.col("text"))}
    assert sorted(r.out for r in translate_words(df, lexicon, "bn", words, "id").collect()) == ["b", "x"]
    with pytest.raises(Exception, match="not unique"):
        translate_words(df, lexicon, "bn", words, "id", 0).collect()


# Text: rows, columns, cells.
LINEAR = {
    "<কলাম> গণনা(...) <রো ১> ৩": (["৩"], ["গণনা(...) | ৩"], ["৩"]),
    "<কলাম> a | b <রো ১> 1 | 2 <রো ২> 3 | 4": (["1 | 2", "3 | 4"], ["a | 1 | 3", "b | 2 | 4"], ["1", "2", "3", "4"]),
    "noblank": ([], [], []),
    "": ([], [], []),
    "<কলাম> ": ([], [], []),
    "<কলাম> a | b <রো ১> 1 | 2 <রো ২> 3": (["1 | 2", "3"], ["a | 1 | 3"], ["1", "2", "3"]),
    # No header: the first row takes its place.
    "<কলাম> <রো ১> 1|2": ([], ["1|2"], []),
    # A row mark without a blank after it keeps its number.
    "<কলাম> a <রো ১>": (["১>"], ["a | ১>"], ["১>"]),
    # Rows and cells are split at every bar, columns only at a bar between blanks.
    "<কলাম> a  |  b <রো ১>  1 |2 ": (["1 | 2"], ["a | 1 |2"], ["1", "2"]),
    # An empty row goes.
    "<কলাম> a <রো ১> <রো ২> 5": (["5"], ["a | 5"], ["5"]),
    "<কলাম> a | b<রো ১> 1 | 2": (["1 | 2"], ["a | 1", "b | 2"], ["1", "2"]),
}


def test_parse_linear_tables(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LINEAR)], "i int, v string")
    got = df.orderBy("i").select(parse_linearised(F.col("v"), "bn").alias("p")).collect()
    assert [(r.p["rows"], r.p["columns"], r.p["cells"]) for r in got] == list(LINEAR.values())
    other = df.select(parse_linearised(F.col("v"), "or").alias("p")).first().p
    assert other["rows"] == other["columns"] == other["cells"] == []


def test_linear_form_goes_back(spark, sf):
    t = corpus_tables(spark, sf)
    parsed = t.select(
        "rows", "header", parse_linearised(linearise(F.col("header"), F.col("rows"), "hi"), "hi").alias("p"))
    for r in parsed.collect():
        assert r.p["rows"] == [" | ".join(x) for x in r.rows]
        assert r.p["columns"] == [" | ".join([h, *c]) for h, c in zip(r.header, zip(*r.rows))]
        assert r.p["cells"] == [c for x in r.rows for c in x]


def test_samples_are_spread_before_they_are_converted(spark, tmp_path):
    """The raw samples are joined with their numbers; no converted side is broadcast."""
    path = str(tmp_path / "samples")
    part_samples(spark, "/root/testdata/sf0.01").coalesce(1).write.parquet(path)
    samples = spark.read.parquet(path)
    lexicon = spark.createDataFrame([("name", "নাম")], "source string, target string")
    out = convert_samples(samples, "bn", lexicon, "sample_id", 5)
    assert [r["index"] for r in out.orderBy("sample_id").select("index").collect()] == list(range(5, 5 + samples.count()))
    joins = re.findall(r"\w+Join", out._jdf.queryExecution().executedPlan().toString())
    assert set(joins) == {"SortMergeJoin"}


def test_a_scan_of_one_row_group_is_spread(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= 4
        assert spread(scan, "id").groupBy(F.spark_partition_id()).count().count() >= 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    even = spark.range(1000).repartition(8)
    assert spread(even, "id") is even


def test_large_look_up_moves_no_word_lists(spark):
    """Words that the lexicon does not have are not sent anywhere; cold ones come back to their record, null keys too."""
    docs = spark.range(400).select(
        F.when(F.col("id") > 0, F.col("id")).alias("id"),
        F.concat_ws(" ", F.lit("(hot),"), F.concat(F.lit("c"), F.col("id") % 50), F.concat(F.lit("junk"), F.col("id")), F.lit("hot")).alias("text"),
    )
    lexicon = spark.createDataFrame([("hot", "H"), *[(f"c{i}", f"C{i}") for i in range(45)]], "source string, target string")
    lexicon = lexicon.unionByName(spark.range(100).select(F.concat(F.lit("none"), "id").alias("source"), F.lit("N").alias("target")))
    given = translate_words(docs, lexicon, "bn", {"out": split_words(F.col("text"))}, "id", 0)
    want = {(i or None, f"(H), {'C' if i % 50 < 45 else 'c'}{i % 50} junk{i} H") for i in range(400)}
    assert {(r.id, r.out) for r in given.collect()} == want
    plan = given._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(list" not in plan and "inline" not in plan


def test_lexicon_order_searches_a_shared_list_once(spark, sf):
    """The languages share their keywords, so one list of conditions serves them all, without a lambda per word."""
    plan = QUERIES["lexicon_order"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Contains(sql") <= len(lexicon_entries("bn")) and "lambdafunction" not in plan
