"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sarani.functions.linear import linearise, linearise_by_language, parse_linearised
from sarani.functions.once import compute_once
from sarani.operators.evaluate import (
    PARTS, bootstrap_mean, exact_match, leaderboard, match_scores, micro_prf, rouge_l, rouge_lsum, rouge_n,
    table_overlap,
)
from sarani.plans.checks import CORPUS
from sarani.plans.registry import query
from sarani.sources.star import corpus_tables, load

# Every prediction lacks each fifth row, and each fourth table another first header; each
# seventh table is right but for its case, each eleventh quite right.
_PREDICTIONS = f"""
{CORPUS},
numbered AS (SELECT *, CAST(REGEXP_EXTRACT(table_id, '[0-9]+$') AS BIGINT) AS k FROM corpus),
predictions AS (
  SELECT table_id, k, header, trows, 'm' || (k % 3) AS model,
    CASE WHEN k % 2 = 0 THEN 'bn' ELSE 'hi' END AS lang,
    CASE WHEN k % 5 = 0 THEN 'test' ELSE 'validation' END AS split,
    CASE WHEN k % 4 = 0 AND k % 7 <> 0 AND k % 11 <> 0 THEN ['other'] || header[2:] ELSE header END AS pheader,
    CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN trows
         ELSE LIST_FILTER(trows, LAMBDA r, i: (i + k) % 5 <> 0) END AS prows
  FROM numbered
)"""


def predictions(spark, d, lang=None):
    """Linear gold and predicted tables of one language, or of the two by turns."""
    k = F.regexp_extract("table_id", "[0-9]+$", 0).cast("bigint")
    code = F.when(F.col("k") % 2 == 0, "bn").otherwise("hi") if lang is None else F.lit(lang)
    t = corpus_tables(spark, d).withColumn("k", k).withColumn("lang", code)
    whole = (F.col("k") % 7 == 0) | (F.col("k") % 11 == 0)
    other = F.concat(F.array(F.lit("other")), F.slice("header", F.lit(2), F.size("header")))
    header = F.when((F.col("k") % 4 == 0) & ~whole, other).otherwise(F.col("header"))
    rows = F.when(whole, F.col("rows")).otherwise(
        F.filter("rows", lambda r, i: (i + 1 + F.col("k")) % 5 != 0)
    )
    line = lambda h, r: linearise_by_language(h, r, F.col("lang")) if lang is None else linearise(h, r, lang)
    t = compute_once(t, target=line(F.col("header"), F.col("rows")), _pred=line(header, rows))
    return t.select(
        "table_id", "k", F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("model"), "lang",
        F.when(F.col("k") % 5 == 0, F.lit("test")).otherwise(F.lit("validation")).alias("split"), "target",
        F.when(F.col("k") % 7 == 0, F.upper("_pred")).otherwise(F.concat("_pred", F.lit(" "))).alias("prediction"),
    )


@query("parse_linearised", f"""
WITH {CORPUS}
SELECT table_id,
  ARRAY_TO_STRING(LIST_TRANSFORM(trows, LAMBDA r: ARRAY_TO_STRING(r, ' | ')), ';') AS rows,
  ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(1, LEN(header) + 1), LAMBDA j:
    ARRAY_TO_STRING([header[j]] || LIST_TRANSFORM(trows, LAMBDA r: r[j]), ' | ')), ';') AS columns,
  ARRAY_TO_STRING(FLATTEN(trows), ';') AS cells
FROM corpus""")
def parse_linearised_query(spark, d):
    t = corpus_tables(spark, d)
    parsed = t.withColumn("_p", parse_linearised(linearise(F.col("header"), F.col("rows"), "bn"), "bn"))
    return parsed.select("table_id", *[F.array_join(f"_p.{p}", ";").alias(p) for p in ("rows", "columns", "cells")])


_ITEMS = {
    "rows": "LIST_TRANSFORM({r}, LAMBDA x: LOWER(ARRAY_TO_STRING(x, ' | ')))",
    "columns": "LIST_TRANSFORM(RANGE(1, LEN({h}) + 1), LAMBDA j: LOWER(ARRAY_TO_STRING([{h}[j]] || LIST_TRANSFORM({r}, LAMBDA x: x[j]), ' | ')))",
    "cells": "LIST_TRANSFORM(FLATTEN({r}), LAMBDA x: LOWER(x))",
}


def _overlap_cte(part: str) -> str:
    gold, pred = _ITEMS[part].format(h="header", r="trows"), _ITEMS[part].format(h="pheader", r="prows")
    return f"""
items_{part} AS (
  SELECT table_id, item, SUM(g) AS g, SUM(p) AS p FROM (
    SELECT table_id, UNNEST({gold}) AS item, 1 AS g, 0 AS p FROM predictions
    UNION ALL SELECT table_id, UNNEST({pred}), 0, 1 FROM predictions) GROUP BY table_id, item),
overlap_{part} AS (
  SELECT table_id, '{part}' AS part, CAST(SUM(g) AS BIGINT) AS gold, CAST(SUM(p) AS BIGINT) AS predicted,
         CAST(SUM(LEAST(g, p)) AS BIGINT) AS correct FROM items_{part} GROUP BY table_id)"""


def _register_overlap(part):
    @query(
        f"bag_overlap_{part}",
        f"WITH {_PREDICTIONS},{_overlap_cte(part)} SELECT table_id, gold, predicted, correct FROM overlap_{part}",
    )
    def run(spark, d):
        return table_overlap(predictions(spark, d, "bn"), ["table_id"], "bn", parts=(part,)).drop("part")


for _part in _ITEMS:
    _register_overlap(_part)

_ALL_OVERLAPS = ",".join(_overlap_cte(p) for p in _ITEMS) + """,
every AS (SELECT * FROM overlap_rows UNION ALL SELECT * FROM overlap_columns UNION ALL SELECT * FROM overlap_cells)"""


@query("micro_prf", f"""
WITH {_PREDICTIONS},{_ALL_OVERLAPS},
sums AS (SELECT part, SUM(gold) AS g, SUM(predicted) AS p, SUM(correct) AS c FROM every GROUP BY part)
SELECT part, CAST(g AS BIGINT) AS gold, CAST(p AS BIGINT) AS predicted, CAST(c AS BIGINT) AS correct,
  ROUND(c / p, 6) AS precision, ROUND(c / g, 6) AS recall, ROUND(2.0::DOUBLE * NULLIF(c, 0) / (g + p), 6) AS f1 FROM sums""")
def micro_prf_query(spark, d):
    scores = micro_prf(table_overlap(predictions(spark, d, "bn"), ["table_id"], "bn"), ["part"])
    return scores.select(
        "part", "gold", "predicted", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


@query("exact_match", f"""
WITH {_PREDICTIONS}
SELECT model, COUNT(*) AS n, ROUND(AVG(CASE WHEN k % 11 = 0 AND k % 7 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_match
FROM predictions GROUP BY model""")
def exact_match_query(spark, d):
    p = predictions(spark, d, "bn")
    return p.groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.avg(exact_match(F.col("prediction"), F.col("target"))), 6).alias("exact_match")
    )


@query("em_ignore_case", """
SELECT ROUND(AVG(CASE WHEN LOWER(a.text) = LOWER(b.text) THEN 1.0 ELSE 0.0 END), 4) AS exact_match,
       ROUND(AVG(CASE WHEN a.text = b.text THEN 1.0 ELSE 0.0 END), 4) AS accuracy
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN LOWER(text) WHEN doc_id % 3 = 1 THEN text ELSE text || '.' END AS text FROM documents) a
JOIN documents b USING (doc_id)""")
def em_ignore_case(spark, d):
    third = F.col("doc_id") % 3
    pred = F.when(third == 0, F.lower("text")).when(third == 1, F.col("text")).otherwise(F.concat("text", F.lit(".")))
    return match_scores(load(spark, d, "documents").withColumn("prediction", pred), "prediction", "text")


def _spread_sql(h: str) -> str:
    for factor, shift in ((1103515245, 15), (1597334677, 13), (1181783497, 16)):
        h = f"(SELECT xor(q, q >> {shift}) FROM (SELECT ({h}) * {factor} % 2147483647 AS q))"
    return h


# Distribution function of Poisson(1) at 0, 1, 2, ...
_POISSON = "(SELECT LIST(p ORDER BY n) FROM (SELECT n, ROUND(SUM(EXP(-1.0::DOUBLE) / GAMMA(n + 1.0::DOUBLE)) OVER (ORDER BY n), 12) AS p FROM RANGE(13) t(n)))"


@query("bootstrap_mean", f"""
WITH records AS (
  SELECT CAST(quality AS DOUBLE) AS v, CAST('0x' || SUBSTR(MD5('42|' || doc_id), 1, 8) AS BIGINT) % 2147483647 AS k
  FROM labels WHERE quality IS NOT NULL),
drawn AS (
  SELECT b, v, {_spread_sql(f"xor({_spread_sql('k')}, CAST(b AS BIGINT) * 2654435 % 2147483647)")} / 2147483648.0::DOUBLE AS u
  FROM records, RANGE(1, 1001) t(b)),
weighted AS (SELECT b, v, LEN(LIST_FILTER({_POISSON}, LAMBDA p: u >= p)) AS w FROM drawn),
means AS (SELECT b, SUM(w * v) / SUM(w) AS m FROM weighted GROUP BY b)
SELECT ROUND(QUANTILE_CONT(m, 0.025), 6) AS low, ROUND(QUANTILE_CONT(m, 0.5), 6) AS mid, ROUND(QUANTILE_CONT(m, 0.975), 6) AS high
FROM means""")
def bootstrap_mean_query(spark, d):
    out = bootstrap_mean(load(spark, d, "labels"), "quality", "doc_id")
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


def turn_pairs(spark, d):
    """Each turn with the next one: an equi-join, so a very long conversation is spread."""
    c = load(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("pred"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("pred").alias("ref"))
    return c.join(nxt, ["conv_id", "turn"])


def _rouge_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    grams = f"LIST_TRANSFORM(RANGE(1, LEN(w) - {n} + 2), LAMBDA i: {gram})"
    words = r"REGEXP_EXTRACT_ALL(LOWER({c}), '[\pL\pM\pN]+')"
    return f"""
WITH pairs AS (
  SELECT a.conv_id, a.turn, {words.format(c='a.text')} AS pw, {words.format(c='b.text')} AS rw
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
grams AS (
  SELECT conv_id, turn, {grams.replace('(w)', '(pw)').replace('w[', 'pw[')} AS p,
         {grams.replace('(w)', '(rw)').replace('w[', 'rw[')} AS r FROM pairs),
counts AS (
  SELECT conv_id, turn, g, SUM(p) AS p, SUM(r) AS r FROM (
    SELECT conv_id, turn, UNNEST(p) AS g, 1 AS p, 0 AS r FROM grams
    UNION ALL SELECT conv_id, turn, UNNEST(r), 0, 1 FROM grams) GROUP BY ALL),
sums AS (SELECT conv_id, turn, SUM(p) AS p, SUM(r) AS r, SUM(LEAST(p, r)) AS c FROM counts GROUP BY ALL)
SELECT pairs.conv_id, pairs.turn, ROUND(CASE WHEN c > 0 THEN 2.0::DOUBLE * c / (p + r) ELSE 0.0::DOUBLE END, 6) AS rouge{n}
FROM pairs LEFT JOIN sums USING (conv_id, turn)"""


def _register_rouge(n):
    @query(f"rouge{n}", _rouge_sql(n))
    def run(spark, d):
        scores = rouge_n(turn_pairs(spark, d), ["conv_id", "turn"], "pred", "ref", n)
        return scores.select("conv_id", "turn", F.round(f"rouge{n}", 6).alias(f"rouge{n}"))


for _n in (1, 2):
    _register_rouge(_n)


# The table of the longest common subsequence, one row per word of the prediction: each
# place holds the best of the places up to it.
_LCS = r"""
WITH RECURSIVE pairs AS (
  SELECT a.conv_id, a.turn, REGEXP_EXTRACT_ALL(LOWER(a.text), '[\pL\pM\pN]+') AS pw,
         REGEXP_EXTRACT_ALL(LOWER(b.text), '[\pL\pM\pN]+') AS rw
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
steps AS (
  SELECT conv_id, turn, 0 AS i, LIST_TRANSFORM(rw, LAMBDA x: 0) AS best FROM pairs
  UNION ALL
  SELECT conv_id, turn, i, LIST_TRANSFORM(RANGE(1, LEN(c) + 1), LAMBDA j: LIST_MAX(c[1:j])) FROM (
    SELECT conv_id, turn, i + 1 AS i, LIST_TRANSFORM(RANGE(1, LEN(rw) + 1), LAMBDA j:
        CASE WHEN rw[j] = pw[i + 1] THEN COALESCE(best[j - 1], 0) + 1 ELSE best[j] END) AS c
    FROM steps JOIN pairs USING (conv_id, turn) WHERE i < LEN(pw)))
SELECT conv_id, turn, ROUND(CASE WHEN best[LEN(rw)] > 0 THEN 2.0::DOUBLE * best[LEN(rw)] / (LEN(pw) + LEN(rw))
                            ELSE 0.0::DOUBLE END, 6) AS rouge_l
FROM steps JOIN pairs USING (conv_id, turn) WHERE i = LEN(pw)"""


@query("rouge_l", _LCS)
def rouge_l_query(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(rouge_l(F.col("pred"), F.col("ref")), 6).alias("rouge_l"))


# Tables of every line of the reference with every line of the prediction, and the walk through
# each from its end; the words at the places walked through on a match, each as often as the
# prediction has it at most, are the hits.
_LSUM = r"""
WITH RECURSIVE pairs AS (
  SELECT a.conv_id, a.turn, a.text AS pred, b.text AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
rl AS (
  SELECT conv_id, turn, li, REGEXP_EXTRACT_ALL(LOWER(line), '[\pL\pM\pN]+') AS rw
  FROM (SELECT conv_id, turn, UNNEST(STRING_SPLIT(ref, CHR(10))) AS line, UNNEST(RANGE(LEN(STRING_SPLIT(ref, CHR(10))))) AS li FROM pairs)),
pl AS (
  SELECT conv_id, turn, lj, REGEXP_EXTRACT_ALL(LOWER(line), '[\pL\pM\pN]+') AS pw
  FROM (SELECT conv_id, turn, UNNEST(STRING_SPLIT(pred, CHR(10))) AS line, UNNEST(RANGE(LEN(STRING_SPLIT(pred, CHR(10))))) AS lj FROM pairs)),
t(conv_id, turn, li, lj, i, best) AS (
  SELECT conv_id, turn, li, lj, 0, LIST_TRANSFORM(pw, LAMBDA x: 0) FROM rl JOIN pl USING (conv_id, turn)
  UNION ALL
  SELECT conv_id, turn, li, lj, i, LIST_TRANSFORM(RANGE(1, LEN(c) + 1), LAMBDA j: LIST_MAX(c[1:j])) FROM (
    SELECT conv_id, turn, li, lj, i + 1 AS i, LIST_TRANSFORM(RANGE(1, LEN(pw) + 1), LAMBDA j:
        CASE WHEN pw[j] = rw[i + 1] THEN COALESCE(best[j - 1], 0) + 1 ELSE best[j] END) AS c
    FROM t JOIN rl USING (conv_id, turn, li) JOIN pl USING (conv_id, turn, lj) WHERE i < LEN(rw))),
w(conv_id, turn, li, lj, i, j, hit) AS (
  SELECT conv_id, turn, li, lj, LEN(rw), LEN(pw), CAST(NULL AS BIGINT) FROM rl JOIN pl USING (conv_id, turn)
  UNION ALL
  SELECT conv_id, turn, li, lj, CASE WHEN same OR NOT back THEN i - 1 ELSE i END, CASE WHEN same OR back THEN j - 1 ELSE j END, CASE WHEN same THEN i END
  FROM (
    SELECT w.conv_id, w.turn, w.li, w.lj, w.i, w.j, rw[w.i] = pw[w.j] AS same, COALESCE(x.best[w.j - 1], 0) > COALESCE(y.best[w.j], 0) AS back
    FROM w JOIN rl USING (conv_id, turn, li) JOIN pl USING (conv_id, turn, lj)
    JOIN t x ON x.conv_id = w.conv_id AND x.turn = w.turn AND x.li = w.li AND x.lj = w.lj AND x.i = w.i
    JOIN t y ON y.conv_id = w.conv_id AND y.turn = w.turn AND y.li = w.li AND y.lj = w.lj AND y.i = w.i - 1
    WHERE w.i > 0 AND w.j > 0)),
places AS (SELECT DISTINCT conv_id, turn, li, hit FROM w WHERE hit IS NOT NULL),
found AS (SELECT conv_id, turn, rw[hit] AS word, COUNT(*) AS n FROM places JOIN rl USING (conv_id, turn, li) GROUP BY ALL),
said AS (SELECT conv_id, turn, word, COUNT(*) AS n FROM (SELECT conv_id, turn, UNNEST(pw) AS word FROM pl) GROUP BY ALL),
hits AS (SELECT conv_id, turn, SUM(LEAST(f.n, s.n)) AS hits FROM found f JOIN said s USING (conv_id, turn, word) GROUP BY ALL),
sizes AS (
  SELECT conv_id, turn, (SELECT SUM(LEN(rw)) FROM rl WHERE rl.conv_id = pairs.conv_id AND rl.turn = pairs.turn)
    + (SELECT SUM(LEN(pw)) FROM pl WHERE pl.conv_id = pairs.conv_id AND pl.turn = pairs.turn) AS n FROM pairs)
SELECT conv_id, turn, ROUND(COALESCE(2.0::DOUBLE * hits / n, 0.0::DOUBLE), 6) AS rouge_lsum FROM sizes LEFT JOIN hits USING (conv_id, turn)"""


@query("rouge_lsum", _LSUM)
def rouge_lsum_query(spark, d):
    return turn_pairs(spark, d).select(
        "conv_id", "turn", F.round(rouge_lsum(F.col("pred"), F.col("ref")), 6).alias("rouge_lsum")
    )


LEADERBOARD = [
    f"{lang}_{split}_{part}" for lang in ("bn", "hi") for split in ("validation", "test")
    for part in ("table", "rows", "columns", "cells")
]

_PIVOT = ", ".join(f"ROUND(100 * MAX(CASE WHEN cell = '{c}' THEN score END), 2) AS {c}" for c in LEADERBOARD)


@query("leaderboard_pivot", f"""
WITH {_PREDICTIONS},{_ALL_OVERLAPS},
scores AS (
  SELECT model, lang || '_' || split || '_' || part AS cell, 2.0::DOUBLE * NULLIF(SUM(correct), 0) / SUM(gold + predicted) AS score
  FROM every JOIN predictions USING (table_id) GROUP BY ALL
  UNION ALL
  SELECT model, lang || '_' || split || '_table', AVG(CASE WHEN k % 11 = 0 AND k % 7 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  FROM predictions GROUP BY ALL)
SELECT model, {_PIVOT} FROM scores GROUP BY model""")
def leaderboard_pivot(spark, d):
    """Both languages and all scores from one pass over the predictions."""
    keys = ["model", "lang", "split"]
    p = predictions(spark, d)
    em = exact_match(F.col("prediction"), F.col("target"))
    overlap = table_overlap(p.withColumn("em", em), [*keys, "table_id", "em"], F.col("lang"))
    sums = micro_prf(overlap, [*keys, "part"]).select(*keys, "part", F.col("f1").alias("score"))
    # Every table has a row per part; the match is counted with one of them.
    match = overlap.where(F.col("part") == PARTS[0]).groupBy(*keys).agg(F.avg("em").alias("score"))
    scores = sums.unionByName(match.select(*keys, F.lit("table").alias("part"), "score"))
    cell = F.concat_ws("_", "lang", "split", "part").alias("cell")
    return leaderboard(scores.select("model", cell, "score"), LEADERBOARD)
