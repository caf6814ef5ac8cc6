import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarani.llm import decontaminate
from sarani.llm.decontaminate import MATCH, align, find_leaks
from sarani.llm.language import LanguageFilter, fit_languages, grams, held_out, identify_language, slots_of
from sarani.llm.license_scan import BASE, TEXTS, scan_licenses, template_words
from tests_llm_helpers import by_id


def test_language_accuracy_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(~held_out()))
    assert model.languages == ("de", "en", "es", "fr")
    found = identify_language(docs.drop("lang"), model).join(docs, "doc_id").where(held_out())
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 200 and right >= 0.99 * total
    assert found.where("score < 0 OR score > 1").isEmpty()


def test_language_of_odd_texts(spark, nasty, empty):
    rows = [(1, "der hund und die katze " * 9, "de"), (2, "the dog and the cat " * 9, "en"), (3, None, "en"), (4, "the dog", None)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = by_id(identify_language(nasty, model))
    for r in nasty.select("doc_id", "text").collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
        else:
            assert found[r.doc_id].lang_pred in ("de", "en")
    assert identify_language(empty, model).count() == 0
    assert fit_languages(empty).languages == ()
    assert {r.lang_pred for r in identify_language(nasty, fit_languages(empty)).collect()} == {"und"}


def test_a_rare_language_is_learned_beside_a_frequent_one(spark):
    """Three rows of one language, with a null id, beside thousands; the bound holds per language."""
    rng = random.Random(3)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(3, 7))) for _ in range(40))
    common = [(i, text("abcdefg"), "xx") for i in range(4000)]
    rare = [(None, text("mnopqrs"), "yy"), (9001, text("mnopqrs"), "yy"), (9001, text("mnopqrs"), "yy")]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    for bound in (100, 3):
        model = fit_languages(docs, sample_rows=bound)
        assert model.languages == ("xx", "yy") and (model.bits & 2).any()
        ask = spark.createDataFrame([(None, text("mnopqrs") * 2), (1, text("mnopqrs") * 2), (1, text("abcdefg")), (None, text("abcdefg"))], "doc_id long, text string")
        found = sorted(((r.doc_id, r.lang_pred) for r in identify_language(ask, model).collect()), key=repr)
        assert found == [(1, "xx"), (1, "yy"), (None, "xx"), (None, "yy")]


def test_language_filter_of_more_languages_than_bits(spark):
    """Languages beyond one integer of bits use the next one."""
    rows = [(i, "".join(chr(0x4E00 + 40 * i + k) for k in range(30)) + " " + "".join(chr(0x4E00 + 40 * i + k) for k in range(30)) * 3, f"l{i:02}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs)
    assert model.bits.shape[1] == 2
    assert identify_language(docs, model).join(docs, "doc_id").where("lang <> lang_pred").isEmpty()


def test_a_filter_forgets_no_member_and_corrects_false_positives():
    bits = np.zeros((1 << 12, 1), np.int64)
    for where in slots_of(grams("some words of a language"), len(bits)):
        bits[where] |= 1
    bits[np.random.default_rng(1).random(len(bits)) < 0.3] |= 2
    model = LanguageFilter(("a", "b"), bits)
    scores = model.scores("some words of a language", model.false_rates())
    assert scores[0] == pytest.approx(1.0) and scores[1] < 0.35


def naive_alignment(item, passage):
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_table():
    rng = random.Random(2)
    for _ in range(60):
        item, passage = ([rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert align(np.array(item), np.array(passage))[0] == naive_alignment(item, passage)


def test_leaks(spark, empty):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(3000)}"
    items = {i: [word() for _ in range(25 + i)] for i in range(12)}
    items[20] = ["rare", "pair"]
    docs, truth = [], {}
    for i in range(120):
        body = [word() for _ in range(rng.randrange(0, 300))]
        if i % 3 == 0:  # a third of all documents hold item 0, whole
            body[len(body) // 2 : len(body) // 2] = items[0]
            truth.setdefault(i, set()).add(0)
        if i % 4 == 1:
            k = 1 + i % 11
            copy = list(items[k])
            for _ in range(len(copy) // 8):  # edits, lost and added words
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[word()], [], [copy[at], word()]])
            body += copy
            truth.setdefault(i, set()).add(k)
        docs.append((i, " ".join(body).upper() if i % 2 else ", ".join(body)))
    docs += [(200, "a Rare  pair!"), (201, None), (202, ""), (None, " ".join(items[0])), (203, " ".join(items[3][:8]))]
    truth[200] = {20}
    given = [(k, " ".join(v), "c") for k, v in items.items()] + [(30, None, "c"), (31, "", "c"), (32, "...", "c"), (None, "x y z w", "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("gram", F.lit(1)).withColumn("windows", F.lit(2))
    b = spark.createDataFrame(given, "item_id long, text string, words string")
    found = find_leaks(d, b)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
        assert 0.5 <= r.score <= 1
    assert got == truth
    assert found.where("item_id = 0 AND score < 1").isEmpty() and MATCH == 2
    assert find_leaks(d.union(d), b).count() == found.count()
    assert find_leaks(empty, b).count() == 0 and find_leaks(d, b.limit(0)).count() == 0


def test_leaks_of_an_exact_and_an_edited_copy_of_one_item(spark):
    """The copies themselves do not turn the n-grams that survive an edit into common ones."""
    items = {k: [f"v{k}x{i}" for i in range(40)] for k in (5, 6, 7, 8)}
    copies = {k: [f"y{i}" if i % k == k - 1 else w for i, w in enumerate(item)] for k, item in items.items()}
    docs = [(k, " ".join(item)) for k, item in items.items()] + [(10 * k, " ".join(["a", *copy, "b"])) for k, copy in copies.items()]
    docs += [(1, " ".join(items[5][:20])), (2, " ".join(items[5][:19]))]  # half an item, and less
    found = by_id(find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")))
    assert set(found) == {1, 5, 6, 7, 8, 50, 60, 70, 80} and found[1].score == 0.5
    for k, item in items.items():
        assert found[k].score == 1 and found[10 * k].item_id == k
        assert found[10 * k].score == naive_alignment(item, copies[k]) / (MATCH * len(item))


@pytest.mark.parametrize("every", [3, 4, 5, 6, 7, 8])
def test_recall_by_edit_rate(spark, every):
    """Copies with every k-th word replaced, lost or doubled by another, each beside an exact copy."""
    rng = random.Random(every)
    items = {i: [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 60))] for i in range(40)}
    edits = {"replaced": lambda w: ["zz"], "lost": lambda w: [], "added": lambda w: [w, "yy"]}
    docs, truth = [], {}
    for kind, (name, edit) in enumerate(edits.items()):
        if name != "replaced" and every == 3:
            continue
        for i, words in items.items():
            copy = [x for k, w in enumerate(words) for x in (edit(w) if k % every == every - 1 else [w])]
            body = [f"d{rng.randrange(9000)}" for _ in range(80)]
            doc = 1000 * (kind + 1) + i
            docs.append((doc, " ".join(body[:40] + copy + body[40:])))
            if naive_alignment(words, copy) / (MATCH * len(words)) >= 0.5:
                truth[doc] = i
    docs += [(i, " ".join(words)) for i, words in items.items()] + [(9000 + i, " ".join(f"d{rng.randrange(9000)}" for _ in range(80))) for i in range(50)]
    given = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), given).collect()}
    assert {(i, i) for i in items} <= set(found) and all(found[i, i] == 1 for i in items)
    copies = {k: s for k, s in found.items() if k[0] >= 1000}
    assert set(copies) <= set(truth.items()) and len(copies) >= 0.9 * len(truth) > 25


def test_a_common_phrase_aligns_no_passage(spark, monkeypatch):
    """Documents and items that share a phrase only: no passage is cut."""
    rng = random.Random(8)
    words = lambda n, name: [f"{name}{rng.randrange(5000)}" for _ in range(n)]
    phrase = ["the", "end", "of", "the", "day"]
    docs = [(i, " ".join(words(30, "d") + phrase + words(30, "d"))) for i in range(300)]
    written = {}
    real = decontaminate.materialise

    def kept(df, name):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(decontaminate, "materialise", kept)
    for shared in (20, 5):  # more items than a rare n-gram may have, and fewer
        written.clear()
        items = [(i, " ".join(words(10, "i") + phrase + words(10, "i"))) for i in range(shared)]
        found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert found.count() == 0 and written["leak-passages"].count() == 0


def test_items_that_share_all_their_words_are_found(spark):
    """Copies of one item under many ids, and one of few words: the rarest n-grams stay seeds."""
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(words)) for i in range(25)] + [(90, "w1 w2"), (91, "solo")]
    docs = [(1, " ".join(["a", *words, "b"])), (2, "x solo y"), (3, "w5 w6")]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, i) for i in range(25)} | {(1, 90), (2, 91)}


def plain_leaks(docs, items, least=0.5):
    """Every document against every item, each aligned whole."""
    number = {}
    cut = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))], int)
    given, out = [(i, cut(t)) for i, t in items], {}
    for d, text in docs:
        body = cut(text)
        for i, words in given:
            if len(words) and len(body) and (score := align(words, body)[0] / (MATCH * len(words))) >= least:
                out[d, i] = score
    return out


def test_the_query_equals_whole_alignments(spark, sf):
    """All documents and all items of the smallest tables, and some edited copies."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i, text in items[:8]:
        words = text.split()
        docs.append((50_000 + i, " ".join("edit" if k % 4 == 3 else w for k, w in enumerate(words))))
        docs.append((60_000 + i, " ".join(words[: 2 * len(words) // 3])))
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got, want = {(r.doc_id, r.item_id): r.score for r in found.collect()}, plain_leaks(docs, items)
    assert got == want and len([k for k in want if k[0] < 50_000]) > 0 and len(want) >= 16


def test_licenses(spark, nasty, empty):
    rng = random.Random(9)
    parts = ["MIT License", "mit-license", "the Apache", "LICENSE", "General public", "license", "gnu", "x", "é", "mİt license", "lİcense", "mit licenKe"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(80)]
    rows += [
        (100, "This work is licensed under the very GNU General Public License, version 3."),
        (101, "Permission is hereby granted, free of any charge, to any person obtaining one copy of this software and associated documentation"),
        (102, "redistribution and use in source"), (103, "mit license " * 3000), (104, None), (105, "MITLicense"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("words"), F.lit(2).alias("gram"), F.lit("c").alias("label"))
    for table in (docs, nasty):
        found = by_id(scan_licenses(table))
        for r in table.select("doc_id", "text").collect():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            hits = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            f = found[r.doc_id]
            starts = [k for k, _ in hits]
            assert (f.n_words, f.n_base, f.first_word, f.last_word, f.base_labels) == (
                len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))
            assert set(filter(None, f.base_labels.split(","))) <= set(f.labels.split(",")) and (f.score == 1.0 if hits else f.score < 1)
    found = by_id(scan_licenses(docs))
    assert found[100].labels == "gpl,gpl-notice" and found[101].labels == "mit-text" and 0.6 <= found[101].score < 1
    assert found[102].labels == "" and found[102].score == 0 and found[103].n_base == 3000
    assert scan_licenses(empty).count() == 0 and scan_licenses(docs.union(docs)).count() == 2 * docs.count()


def test_whole_license_texts(spark):
    """Every whole text, as it is and edited, with words lost and added; and one of 1,500 words."""
    rng = random.Random(11)
    long = " ".join(f"clause{i} of{rng.randrange(300)}" for i in range(750))
    texts = {**TEXTS, long: "long-text"}
    rows, want = [], {}
    for i, (text, label) in enumerate(texts.items()):
        w = template_words(text)
        noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((i, " ".join(noise(30) + w + noise(9))))
        want[i] = (label, 1.0)
        if len(w) >= 40:
            cut = [x for k, x in enumerate(w) if k % 31 != 30]
            added = [y for k, x in enumerate(cut) for y in ([x, "extra"] if k % 40 == 39 else [x])]
            rows.append((100 + i, ", ".join(noise(5) + added)))
            want[100 + i] = (label, None)
            rows.append((200 + i, " ".join(w[: len(w) // 2])))  # too little
    found = by_id(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), texts=texts))
    for i, (label, score) in want.items():
        assert label in found[i].labels.split(",")
        assert found[i].score == 1 if score else 0.6 <= found[i].score
    assert not any(texts[list(texts)[i - 200]] in r.labels.split(",") for i, r in found.items() if i >= 200)
    assert len(template_words(long)) == 1500
    with pytest.raises(ValueError):
        scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), texts={"one": "x"})


def test_license_scan_runs_no_python(nasty):
    plan = scan_licenses(nasty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
