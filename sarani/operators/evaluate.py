"""Scores of predictions: bags of rows, columns and cells, exact match, ROUGE, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sarani.functions.linear import parse_by_language, parse_linearised
from sarani.functions.once import compute_once, let
from sarani.functions.subsequence import common_length, common_places
from sarani.functions.text import strip_text

MERSENNE = (1 << 31) - 1  # a prime; hashes of the bootstrap stay below it

PARTS = ("rows", "columns", "cells")

# Words of a text for ROUGE.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}]+"


def common_items(one: Column, other: Column) -> Column:
    """Size of the multiset intersection of two lists, inside the record.

    Both lists are sorted into one; a fold counts the run of each item on either side and adds
    the smaller count when the next item begins.
    """
    side = lambda c, n: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("item"), F.lit(n).alias("side")))
    start = F.struct(
        F.lit(None).cast("string").alias("item"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).cast("bigint").alias("common"),
    )

    def step(state, x):
        same = x["item"].eqNullSafe(state["item"])
        first = (x["side"] == 0).cast("int")
        kept = lambda c: F.when(same, state[c]).otherwise(0)
        return F.struct(
            x["item"].alias("item"), (kept("left") + first).alias("left"), (kept("right") + 1 - first).alias("right"),
            (state["common"] + F.when(same, F.lit(0)).otherwise(F.least(state["left"], state["right"]))).cast("bigint").alias("common"),
        )

    merged = F.array_sort(F.concat(side(one, 0), side(other, 1)))
    # Lists without a common item need no count.
    folded = F.aggregate(merged, start, step, lambda e: (e["common"] + F.least(e["left"], e["right"])).cast("bigint"))
    return F.when(F.coalesce(F.arrays_overlap(one, other), F.lit(True)), folded).otherwise(F.lit(0).cast("bigint"))


def _length(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


def bag_overlap(df: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    """Per record the sizes of two lists and of their multiset intersection; nothing is shuffled.

    A null list is an empty one, null items are items. Rows that repeat a key stay rows.
    """
    sized = [_length(F.col(gold)).alias("gold"), _length(F.col(pred)).alias("predicted")]
    return df.select(*keys, *sized, common_items(F.col(gold), F.col(pred)).alias("correct"))


def table_overlap(df: DataFrame, keys: list[str], lang: str | Column, gold: str = "target", pred: str = "prediction",
                  parts: tuple[str, ...] = PARTS) -> DataFrame:
    """`bag_overlap` of rows, columns and cells of linear tables; one record per key and part.

    Texts are compared in lower case, stripped. `lang` is one language, or a column of their codes.
    """
    read = lambda c: parse_linearised(c, lang) if isinstance(lang, str) else parse_by_language(c, F.col("_lang"))
    parsed = compute_once(
        df.select(*keys, *([] if isinstance(lang, str) else [lang.alias("_lang")]), F.lower(strip_text(F.col(gold))).alias("_gt"), F.lower(strip_text(F.col(pred))).alias("_pt")),
        _g=read(F.col("_gt")),
        _p=read(F.col("_pt")),
    )
    lists = F.array(
        *[
            F.struct(F.lit(p).alias("part"), F.col(f"_g.{p}").alias("g"), F.col(f"_p.{p}").alias("p"))
            for p in parts
        ]
    )
    long = parsed.select(*keys, F.inline(lists))
    return bag_overlap(long, [*keys, "part"], "g", "p")


def micro_prf(overlap: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of the summed counts; null where a sum is zero."""
    sums = overlap.groupBy(*(groups or [])).agg(
        F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted"), F.sum("correct").alias("correct")
    )
    p = F.try_divide(F.col("correct"), F.col("predicted"))
    r = F.try_divide(F.col("correct"), F.col("gold"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def exact_match(pred: Column, ref: Column) -> Column:
    """1 or 0: stripped texts are equal; a missing text is wrong."""
    return F.coalesce((strip_text(pred) == strip_text(ref)).cast("double"), F.lit(0.0))


def match_scores(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Share of equal texts, without and with regard to case, rounded to 4 digits.

    A record whose prediction or reference is missing counts as wrong.
    """
    p, r = F.col(pred), F.col(ref)
    share = lambda equal: F.round(F.avg(F.coalesce(equal.cast("double"), F.lit(0.0))), 4)
    return df.agg(share(F.lower(p) == F.lower(r)).alias("exact_match"), share(p == r).alias("accuracy"))


def _spread_bits(h: Column) -> Column:
    """A number below 2^31 scrambled by products and shifts that any SQL engine repeats."""
    for factor, shift in ((1103515245, 15), (1597334677, 13), (1181783497, 16)):
        h = (h * F.lit(factor).cast("bigint")) % F.lit(MERSENNE).cast("bigint")
        h = h.bitwiseXOR(F.shiftrightunsigned(h, shift))
    return h


def bootstrap_mean(df: DataFrame, column: str, key: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Low, mid and high value of the bootstrap distribution of a mean.

    A replicate draws every record 0, 1, 2, ... times by Poisson(1). The draw follows from seed,
    key and replicate, so it repeats after a lost task; records are expected to differ in their key.
    The sums of a replicate are added up where the records are: each task sends one row per
    replicate, however many records it has. Null values are left out.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint") % MERSENNE
    records = df.select(F.col(column).cast("double").alias("v"), number.alias("k")).where("v IS NOT NULL")
    drawn = records.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = _spread_bits(_spread_bits(F.col("k")).bitwiseXOR(F.col("b").cast("bigint") * 2654435 % MERSENNE)) / F.lit(float(1 << 31))
    drawn = drawn.select("b", "v", u.alias("u"))
    # Poisson(1) distribution function at 0, 1, 2, ...
    weight = F.when(F.col("u") < POISSON_ONE[0], 0)
    for n, limit in enumerate(POISSON_ONE[1:], 1):
        weight = weight.when(F.col("u") < limit, n)
    weighed = drawn.select("b", "v", weight.otherwise(len(POISSON_ONE)).alias("w"))
    means = weighed.groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    shares = F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return means.agg(shares.alias("_q")).select(
        F.col("_q")[0].alias("low"), F.col("_q")[1].alias("mid"), F.col("_q")[2].alias("high")
    )


def _poisson_one(last: int = 12) -> list[float]:
    term, total, out = 0.36787944117144233, 0.0, []
    for k in range(last + 1):
        total += term
        out.append(round(total, 12))
        term /= k + 1
    return out


POISSON_ONE = _poisson_one()


def rouge_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of a word list as texts."""

    def grams(w):
        count = F.size(w) - (n - 1)
        return F.when(
            count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(w, i, n), " "))
        )

    return F.coalesce(let(words, grams), F.array().cast("array<string>"))


def rouge_n(df: DataFrame, keys: list[str], pred: str, ref: str, n: int) -> DataFrame:
    """F measure of the n-gram overlap per record."""
    grams = df.select(
        *keys,
        ngrams(rouge_words(F.col(ref)), n).alias("_g"),
        ngrams(rouge_words(F.col(pred)), n).alias("_p"),
    )
    overlap = bag_overlap(grams, keys, "_g", "_p")
    score = 2 * F.col("correct") / (F.col("gold") + F.col("predicted"))
    return overlap.select(
        *keys, F.when(F.col("correct") > 0, score).otherwise(F.lit(0.0)).alias(f"rouge{n}")
    )


def _f_measure(hits: Column, gold: Column, pred: Column) -> Column:
    return F.when(hits > 0, 2.0 * hits / (gold + pred)).otherwise(F.lit(0.0))


def rouge_l(pred: Column, ref: Column) -> Column:
    """F measure of the longest common subsequence of words; 0 where a text is missing."""
    score = lambda r, p: _f_measure(common_length(r, p), F.size(r), F.size(p))
    found = let(rouge_words(ref), lambda r: let(rouge_words(pred), lambda p: F.when(F.arrays_overlap(r, p), score(r, p))))
    return F.coalesce(found, F.lit(0.0))


def rouge_lsum(pred: Column, ref: Column) -> Column:
    """F measure of the union of line-wise longest common subsequences; 0 where a text is missing.

    Per line of the reference the places that any line of the prediction has in common with it; a
    word counts as often as the prediction has it, at the most.
    """
    lines = lambda c: F.filter(F.transform(F.split(c, "\n", -1), rouge_words), lambda words: F.size(words) > 0)

    def union(line, others):
        places = F.array_distinct(F.flatten(F.transform(others, lambda other: common_places(line, other))))
        return F.transform(places, lambda i: F.get(line, i - 1))

    def score(refs, preds):
        found = F.flatten(F.transform(refs, lambda line: union(line, preds)))
        said = F.flatten(preds)
        return _f_measure(common_items(found, said), F.size(F.flatten(refs)), F.size(said))

    return F.coalesce(let(lines(ref), lambda r: let(lines(pred), lambda p: score(r, p))), F.lit(0.0))


def leaderboard(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Model by `cell` (language, split, part) with scores in percent, two digits."""
    return (
        scores.groupBy("model").pivot("cell", columns).agg(F.round(100 * F.first("score"), 2))
    )
