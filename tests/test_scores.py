import functools
import random
from collections import Counter

from pyspark.sql import functions as F

from sarani.functions.subsequence import common_length, common_places
from sarani.operators import evaluate as ev


def lists(spark, pairs):
    rows = [(i, g, p) for i, (g, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id int, gold array<string>, pred array<string>")


def test_bag_overlap_equals_counters(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abce") for _ in range(rng.randrange(9))])
             for _ in range(60)] + [([], [])]
    got = {r.id: (r.gold, r.predicted, r.correct) for r in ev.bag_overlap(lists(spark, pairs), ["id"], "gold", "pred").collect()}
    for i, (g, p) in enumerate(pairs):
        assert got[i] == (len(g), len(p), sum((Counter(g) & Counter(p)).values()))


def test_bag_overlap_of_nulls_and_files(spark, tmp_path):
    lists(spark, [(None, ["a"]), (["a", None, None], ["a", None]), (["b"] * 300, ["b"] * 200 + ["c"]), ([], None)]).write.parquet(str(tmp_path / "lists"))
    read = spark.read.parquet(str(tmp_path / "lists"))
    overlap = ev.bag_overlap(read, ["id"], "gold", "pred")
    assert sorted(map(tuple, overlap.collect())) == [(0, 0, 1, 0), (1, 3, 2, 2), (2, 300, 201, 200), (3, 0, 0, 0)]
    assert "Exchange" not in overlap._jdf.queryExecution().executedPlan().toString()


def test_micro_prf(spark):
    df = spark.createDataFrame([("a", 4, 2, 1), ("a", 2, 2, 1), ("b", 0, 0, 0)], "k string, gold int, predicted int, correct int")
    got = {r.k: r for r in ev.micro_prf(df, ["k"]).collect()}
    assert (got["a"].precision, round(got["a"].recall, 6), round(got["a"].f1, 6)) == (0.5, 0.333333, 0.4)
    assert got["b"].precision is None and got["b"].f1 is None


def test_match_scores(spark):
    df = spark.createDataFrame([("A", "a"), ("b", "b"), ("c", "d"), (" e", "e")], "p string, r string")
    assert tuple(ev.match_scores(df, "p", "r").first()) == (0.5, 0.25)
    assert df.agg(F.avg(ev.exact_match(F.col("p"), F.col("r")))).first()[0] == 0.5


def test_bootstrap_lies_around_the_mean(spark):
    df = spark.range(5000).withColumn("v", (F.col("id") % 4 == 0).cast("int"))
    low, mid, high = ev.bootstrap_mean(df, "v", "id").first()
    assert low < 0.25 < high and abs(mid - 0.25) < 0.005
    spread = (0.25 * 0.75 / 5000) ** 0.5
    assert 2.5 * spread < high - low < 5.5 * spread


def test_bootstrap_equals_a_plain_loop(spark):
    """Record by record, replicate by replicate, with a null value, on fewer replicates."""
    import hashlib
    import statistics

    def spread(h):
        for factor, shift in ((1103515245, 15), (1597334677, 13), (1181783497, 16)):
            h = h * factor % (2**31 - 1)
            h ^= h >> shift
        return h

    rng, means = random.Random(1), []
    values = {i: None if i == 7 else rng.random() for i in range(300)}
    for b in range(1, 201):
        total = weights = 0
        for i, v in values.items():
            if v is not None:
                k = int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:8], 16) % (2**31 - 1)
                u = spread(spread(k) ^ (b * 2654435 % (2**31 - 1))) / 2**31
                w = sum(u >= p for p in ev.POISSON_ONE)
                total, weights = total + w * v, weights + w
        means.append(total / weights)
    df = spark.createDataFrame(list(values.items()), "id long, v double")
    low, mid, high = ev.bootstrap_mean(df, "v", "id", 200).first()
    assert abs(mid - statistics.median(means)) < 1e-9 and min(means) < low < mid < high < max(means)
    true = statistics.stdev([v for v in values.values() if v is not None]) / 299**0.5
    assert 0.85 * true < statistics.stdev(means) < 1.15 * true


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def union_places(a, b):
    t, i, j, out = lcs_table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def texts(n):
    rng = random.Random(n)
    line = lambda: " ".join(rng.choice(["ab", "Cd", "é", "বই", "x1", "y"]) for _ in range(rng.randrange(12)))
    return ["\n".join(line() for _ in range(rng.randrange(1, 4))) for _ in range(40)]


def words(text):
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())


def f(hits, gold, pred):
    return 2 * hits / (gold + pred) if hits else 0.0


def test_rouge_against_plain_tables(spark):
    refs, preds = texts(1), texts(2)
    df = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(zip(refs, preds))], "id int, ref string, pred string")
    got = {
        r.id: (r.l, r.s)
        for r in df.select("id", ev.rouge_l(F.col("pred"), F.col("ref")).alias("l"),
                           ev.rouge_lsum(F.col("pred"), F.col("ref")).alias("s")).collect()
    }
    grams = {n: {r.id: r[f"rouge{n}"] for r in ev.rouge_n(df, ["id"], "pred", "ref", n).collect()} for n in (1, 2)}
    for i, (r, p) in enumerate(zip(refs, preds)):
        a, b = words(r), words(p)
        assert abs(got[i][0] - f(lcs_table(a, b)[-1][-1], len(a), len(b))) < 1e-9
        left_r, left_p, hits = Counter(a), Counter(b), 0
        for line in (words(x) for x in r.split("\n")):
            places = functools.reduce(set.union, [union_places(line, words(x)) for x in p.split("\n")], set())
            for k in sorted(places):
                if left_r[line[k]] > 0 and left_p[line[k]] > 0:
                    hits += 1
                    left_r[line[k]] -= 1
                    left_p[line[k]] -= 1
        assert abs(got[i][1] - f(hits, len(a), len(b))) < 1e-9
        for n in (1, 2):
            ga, gb = (Counter(zip(*[w[k:] for k in range(n)])) for w in (a, b))
            assert abs(grams[n][i] - f(sum((ga & gb).values()), sum(ga.values()), sum(gb.values()))) < 1e-9


def test_long_texts_are_compared_whole(spark):
    a, b = " ".join(f"w{i}" for i in range(5000)), " ".join(f"w{i}" for i in range(4000, 9000))
    df = spark.createDataFrame([(a, b)], "ref string, pred string")
    assert abs(df.select(ev.rouge_l(F.col("pred"), F.col("ref"))).first()[0] - 0.2) < 1e-9


def test_subsequences_of_letters_and_across_blocks(spark):
    """Lists shorter and longer than a block of bits, against plain tables."""
    rng = random.Random(12)
    pairs = [(list("pcse"), list("pxse")), ([], ["a"]), (["a"], [])]
    pairs += [([rng.choice("abcdef") for _ in range(n)], [rng.choice("abcdeg") for _ in range(m)]) for n, m in [(5, 9), (61, 62), (62, 63), (63, 125), (130, 64), (200, 190), (1, 70)]]
    pairs += [(["x"] * 150, ["x"] * 130), ([f"w{i}" for i in range(140)], [f"w{i}" for i in range(100, 240)])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a array<string>, b array<string>")
    got = df.select("id", common_length(F.col("a"), F.col("b")).alias("n"), common_places(F.col("a"), F.col("b")).alias("places")).collect()
    for r in got:
        a, b = pairs[r.id]
        assert r.n == lcs_table(a, b)[-1][-1] and {i - 1 for i in r.places} == union_places(a, b)
    assert got[0].n == 3


def test_leaderboard(spark):
    df = spark.createDataFrame([("m", "bn_test_rows", 0.12345)], "model string, cell string, score double")
    row = ev.leaderboard(df, ["bn_test_rows", "hi_test_rows"]).first()
    assert row.bn_test_rows == 12.35 and row.hi_test_rows is None


def test_missing_texts_are_wrong(spark):
    df = spark.createDataFrame([("a b", "a b"), (None, "a"), ("a", None)], "p string, r string")
    row = ev.match_scores(df, "p", "r").first()
    assert (row.exact_match, row.accuracy) == (0.3333, 0.3333)
    one = df.select(ev.exact_match(F.col("p"), F.col("r")).alias("e"), ev.rouge_l(F.col("p"), F.col("r")).alias("l"), ev.rouge_lsum(F.col("p"), F.col("r")).alias("s"))
    assert [tuple(r) for r in one.collect()] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
