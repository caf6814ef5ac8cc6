import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarani.llm.components import components
from sarani.llm.exact_dedup import exact_dedup
from sarani.llm.line_dedup import remove_spread_lines
from sarani.llm.near_dedup import near_components
from sarani.llm.prefix_free import corpus_order, repeated_windows
from sarani.llm.substring_dedup import merged, remove_repeated_runs
from sarani.llm import substring_dedup, suffix_dedup
from sarani.llm.suffix_dedup import remove_repeated_bytes
from tests_llm_helpers import by_id


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def ascii_lower(text):
    return text.encode().lower()


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_exact_dedup(nasty, weak, keep, pick):
    found = by_id(exact_dedup(nasty, keep=keep, **({"hash_of": lambda t: bytes([len(t) % 3])} if weak else {})))
    groups = defaultdict(list)
    texts = texts_of(nasty)
    for i, t in texts.items():
        groups[ascii_lower(t)].append(i)
    assert len(found) == len(texts)
    for i, t in texts.items():
        g = groups[ascii_lower(t)]
        assert tuple(found[i])[1:] == (pick(g), len(g), i == pick(g), hashlib.sha256(ascii_lower(t)).hexdigest())


def test_exact_dedup_of_null_and_repeated_ids(spark, empty):
    rows = [(None, "a"), (5, "A"), (5, "A"), (7, None), (8, "")]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest").collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in found) == [(-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (7, 8, 2, False), (8, 8, 2, True)]
    assert exact_dedup(empty).count() == 0


def shingle_sets(texts, size):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", ascii_lower(t))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    return sets


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_components(nasty, size, percent):
    sets = shingle_sets(texts_of(nasty), size)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    found = by_id(near_components(nasty, size=size, percent=percent))
    assert {i: tuple(r)[1:] for i, r in found.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert max(Counter(find(i) for i in sets).values()) > 10


def test_near_components_of_pages_from_one_pool(spark):
    """Pages of paragraphs from one pool, like each other but mostly not linked, in shared buckets."""
    rng = random.Random(21)
    pool = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(14)]
    rows = []
    for i in range(160):
        pages = rng.sample(pool, 10)
        rows.append((i, " ".join(sorted(pages))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = 0
    for a in sets:
        for b in sets:
            if a < b:
                shared, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                close += 60 * both <= 100 * shared < 80 * both
                if 100 * shared >= 80 * both:
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    found = {r.doc_id: r.component_id for r in near_components(docs, size=3, percent=80).collect()}
    assert found == {i: find(i) for i in sets} and close > 1000 and len(set(found.values())) > 5


def test_near_components_of_odd_rows(spark, empty):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (3, "A b c d"), (9, None)]
    found = near_components(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in found) == [(-1, 3, False), (3, 3, True), (4, 3, False), (4, 3, False), (9, 9, True)]
    assert near_components(empty).count() == 0


def test_near_components_hold_a_chain(spark):
    """Neighbours in the chain are linked, its ends are not."""
    rows = [(i, " ".join(f"w{k}" for k in range(i * 4, i * 4 + 100))) for i in range(12)]
    found = near_components(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85)
    assert {r.component_id for r in found.collect()} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 300), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}


def test_spread_lines(spark, empty):
    rows = []
    for i in range(40):
        lines = [f"own {i}", "everywhere", "", f"half {i % 2}" if i < 12 else "rest", "one site only" if i % 20 == 0 else f"x{i}", "everywhere"]
        rows.append((i, "\n".join(lines), f"s{i % 20}", "clash", "clash"))
    rows += [(50, None, "s1", "", ""), (51, "", None, "", ""), (52, "\n\n", "s2", "", ""), (53, "everywhere", None, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, site string, gone string")
    sites = defaultdict(set)
    for _, text, source, *_ in rows:
        for line in (text or "").split("\n"):
            if source:
                sites[line].add(source)
    for least in (2, 6, 7, 10):
        found = by_id(remove_spread_lines(docs, min_sites=least))
        for i, text, *_ in rows:
            lines = [] if text is None else text.split("\n")
            kept = [x for x in lines if not x.strip(" ") or len(sites[x]) < least]
            assert tuple(found[i])[1:] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert remove_spread_lines(empty).count() == 0


def test_spread_lines_runs_no_python(nasty):
    plan = remove_spread_lines(nasty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("limits", [{}, {"most_contents": 1}, {"shard_words": 1}])
def test_repeated_runs(nasty, limits):
    cut = {i: re.findall(rb"[^\x20\x09-\x0d]+", t.encode()) for i, t in texts_of(nasty).items()}
    for window in (12, 50):
        first = {}
        for i in sorted(cut):
            for k in range(len(cut[i]) - window + 1):
                first.setdefault(tuple(cut[i][k : k + window]), i)
        found = by_id(remove_repeated_runs(nasty, window=window, **limits))
        for i, w in cut.items():
            spans = merged((k, k + window) for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i)
            kept = [x for k, x in enumerate(w) if not any(a <= k < b for a, b in spans)]
            text = b" ".join(kept)
            assert tuple(found[i])[1:] == (len(w), len(w) - len(kept), hashlib.sha256(text).hexdigest(), text.decode(), [(a, b) for a, b in spans])
        assert sum(r.n_removed for r in found.values()) > 400


def test_repeated_runs_of_odd_rows(spark, empty):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(None, body), (2, body), (2, body), (3, body), (4, None)]
    found = remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in found) == [(-1, 60, 0), (2, 60, 0), (2, 60, 0), (3, 60, 60), (4, 0, 0)]
    assert remove_repeated_runs(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"most_contents": 1}, {"shard_bytes": 1}])
def test_repeated_bytes(nasty, limits):
    texts = {i: t.encode() for i, t in texts_of(nasty).items()}
    for window in (100, 400):
        seen = Counter(t[k : k + window] for t in texts.values() for k in range(len(t) - window + 1))
        found = by_id(remove_repeated_bytes(nasty, window=window, **limits))
        for i, t in texts.items():
            spans = merged((k, k + window) for k in range(len(t) - window + 1) if seen[t[k : k + window]] > 1)
            kept = b"".join(t[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(t)]))
            assert tuple(found[i])[1:] == (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [tuple(s) for s in spans])
        assert sum(r.n_removed for r in found.values()) > 2000


def test_repeated_bytes_of_odd_rows(spark, empty):
    body = " ".join(f"w{i}" for i in range(200))
    rows = [(None, body), (2, body), (3, None), (4, "x" * 399)]
    found = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in found) == [(-1, len(body)), (2, len(body)), (3, 0), (4, 0)]
    found = remove_repeated_bytes(spark.createDataFrame([(2, body), (2, "other " + body), (5, body[1:500])], "doc_id long, text string"), with_text=False).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(2, len(body)), (2, len(body)), (5, 499)]
    assert remove_repeated_bytes(empty).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_bytes(empty, window=20)


def test_windows_of_texts_that_count_more_than_once():
    texts = [b"a" * 120, bytes(range(100)), b"q" + bytes(range(99))]
    hit = {}
    for times in ([1, 1, 1], [1, 2, 1]):
        text, first = repeated_windows(texts, 100, times)
        hit[tuple(times)] = set(zip(text.tolist(), first.tolist()))
    periodic = {(0, k) for k in range(21)}
    assert hit == {(1, 1, 1): periodic, (1, 2, 1): periodic | {(1, 0)}}


def test_the_suffix_order_gives_all_removals(nasty, monkeypatch):
    """Without the shards nothing is removed: no other path decides below the limit of a shard."""
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert remove_repeated_bytes(nasty.select("doc_id", "text"), window=100, with_text=False).agg(F.sum("n_removed")).first()[0] == 0


def test_backward_search_gives_all_removed_runs(nasty, monkeypatch):
    """Without the index nothing is removed: no other path decides below the limit of a shard."""
    none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
    monkeypatch.setattr(substring_dedup, "Shard", lambda *_: SimpleNamespace(matches_of_smaller=lambda *_, **__: none))
    assert remove_repeated_runs(nasty.select("doc_id", "text"), with_text=False).agg(F.sum("n_removed")).first()[0] == 0


def test_corpus_order_is_the_order_of_bytes():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(97, 100, rng.integers(30, 200)).tolist()) for _ in range(5)]
    texts = [b"".join(parts[k] for k in rng.integers(0, 5, 9))[int(rng.integers(0, 20)) :] for _ in range(40)]
    text, offset, dictionary, parse = corpus_order(texts)
    assert len(text) > 1000
    order = np.lexsort((parse, dictionary))
    suffixes = [texts[text[k]][offset[k] :] for k in order]
    assert suffixes == sorted(suffixes)
    hit = set(zip(*(x.tolist() for x in repeated_windows(texts, 80))))
    all_windows = Counter(texts[i][k : k + 80] for i, k in zip(text, offset) if k + 80 <= len(texts[i]))
    assert hit == {(i, k) for i, k in zip(text.tolist(), offset.tolist()) if k + 80 <= len(texts[i]) and all_windows[texts[i][k : k + 80]] > 1}


def test_a_third_of_all_rows_in_one_group(spark):
    """Copies, near copies and shared passages in one group of a third of the rows."""
    hot = " ".join(f"h{i}" for i in range(80))
    rows = [(i, f"{hot} t{i}" if i % 3 == 0 else " ".join(f"d{i}x{k}" for k in range(70))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_components(docs, size=3, percent=85).where("kept").count() == 401
    assert remove_repeated_runs(docs, with_text=False).agg(F.sum("n_removed")).first()[0] == 199 * 80
    assert remove_repeated_bytes(docs, window=200, with_text=False).where("n_removed > 0").count() == 200
