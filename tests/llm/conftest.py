import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as columns of the input.
CLASHES = ["n", "hash", "h", "set_hash", "low", "high", "words", "keys", "word", "site", "gone", "place", "gram", "inner", "k1", "bits", "payload", "refers_to", "kept"]


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def nasty_texts():
    """Texts with nulls, empty and long ones, copies, near copies, shared passages and junk."""
    rng = random.Random(7)
    passage, block = words(rng, 70), words(rng, 160)
    base = [words(rng, 120) for _ in range(12)]
    near = []
    for _ in range(12):
        w = base[0].split()
        w[rng.randrange(len(w))] = f"x{rng.randrange(5)}"
        near.append(" ".join(w))
    texts = [None, "", " ", "\n\n", "One", "one two", "ONE TWO", "a" * 3000, "a b " * 900, "é" * 500, "naïve Straße İK日本 語\u0085x"]
    texts += base + base[:4] + [base[1].upper(), base[2].title()] + near
    texts += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(6)] + [f"{block[i:]} {words(rng, 9)}" for i in (0, 3, 40)]
    texts += [words(rng, 30) + " " + passage[: len(passage) // 2], words(rng, 20_000), f"{passage} {passage}", "tick tock " * 100]
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="session")
def nasty(spark):
    """The texts as documents with columns whose names clash with inner ones."""
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], [f"s{i % 14}", None][i % 15 == 0], len(t or "")) for i, t in enumerate(nasty_texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

