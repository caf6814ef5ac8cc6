"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sarani.llm.agenda import sp_encode
from sarani.llm.bpe import bpe_encode
from sarani.llm.common import LOWER, UPPER
from sarani.llm.conversations import damaged, repair_conversations
from sarani.llm.decontaminate import find_leaks
from sarani.llm.exact_dedup import exact_dedup
from sarani.llm.hard_negatives import hard_negatives
from sarani.llm.language import fit_languages, held_out, identify_language
from sarani.llm.license_scan import BASE, TEXTS, gram_size, scan_licenses, template_words
from sarani.llm.line_dedup import remove_spread_lines
from sarani.llm.near_dedup import near_components
from sarani.llm.substring_dedup import remove_repeated_runs
from sarani.llm.suffix_dedup import remove_repeated_bytes
from sarani.llm.warc import warc_round_trip
from sarani.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


NORM = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


@query("op6_exact_dedup", f"""
WITH t AS (SELECT doc_id, {NORM} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), word_vocabulary(), with_ids=False)


@query("op7_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1 AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM h
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(~held_out()))
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op5_near_dedup", rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({NORM}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 2), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
c AS (SELECT doc_id, least(min(other), doc_id) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), size=3, percent=85)


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_line_dedup", r"""
WITH d AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
s AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
k AS (SELECT doc_id, count(*) AS n_lines, count(s.line) AS n_removed,
  string_agg(CASE WHEN s.line IS NULL THEN l.line END, chr(10) ORDER BY place) AS kept FROM l LEFT JOIN s ON l.line = s.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_spread_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _license_values() -> str:
    listed = [(p, label, "true") for p, label in BASE.items()] + [(p, label, "false") for p, label in TEXTS.items()]
    return ",\n  ".join(f"('{' '.join(template_words(p))}', '{label}', {base}, {gram_size(template_words(p))})" for p, label, base in listed)


@query("op2_license_scan", rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({NORM}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
p(phrase, label, is_base, k) AS (VALUES
  {_license_values()}),
t AS (
  SELECT phrase, label, is_base, k, len(ws) - k + 1 AS grams, i - 1 AS spot, ws[i:i + k - 1] AS g
  FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, string_split(phrase, ' ') AS ws FROM p))),
known AS (SELECT DISTINCT list_extract(g, 1) AS w FROM t),
g AS (
  SELECT r, k, ws[i:i + k - 1] AS g, i - 1 AS place
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) JOIN (VALUES (2), (4)) s(k) ON i <= len(ws) - k + 1 WHERE ws[i] IN (SELECT w FROM known)),
v AS (
  SELECT r, phrase, label, is_base, k, grams, place - spot AS diagonal, list_distinct(list(spot)) AS held, min(place) AS low, max(place) AS high
  FROM g JOIN t USING (k, g) GROUP BY ALL),
m AS (
  SELECT *, sum(opens) OVER (PARTITION BY r, phrase ORDER BY diagonal) AS span FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, phrase ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS opens FROM v)),
s AS (
  SELECT r, label, is_base, k, grams, max(len(held) / grams) AS one, len(list_distinct(flatten(list(held)))) / grams AS merged,
    max(high) - min(low) + k AS length, count(*) FILTER (len(held) = grams) AS complete,
    min(diagonal) FILTER (len(held) = grams) AS first, max(diagonal) FILTER (len(held) = grams) AS last
  FROM m GROUP BY r, phrase, label, is_base, k, grams, span),
f AS (
  SELECT *, is_base AND complete > 0 AS whole, greatest(one, CASE WHEN length <= 1.5 * (grams + k - 1) THEN merged ELSE 0 END) AS share FROM s),
e AS (
  SELECT r, sum(complete) FILTER (whole) AS n_base, min(first) FILTER (whole) AS first_word, max(last) FILTER (whole) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR (NOT is_base AND share >= 0.6)) AS labels,
    max(CASE WHEN whole THEN 1.0 WHEN NOT is_base AND share >= 0.6 THEN share ELSE 0.0 END) AS score
  FROM f GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN e USING (r)
""")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup", r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
n AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
o AS (SELECT h, min(doc_id) AS owner FROM n GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM n JOIN o USING (h) WHERE owner < doc_id),
k AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS w FROM d),
r AS (
  SELECT k.doc_id, count(gone.k) AS n_removed, string_agg(CASE WHEN gone.k IS NULL THEN w END, ' ' ORDER BY k.k) AS kept
  FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.k = gone.k GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_runs(table(spark, sf_dir, "documents"), with_text=False)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), with_text=False)


@query("op11_hard_negatives", """
WITH t AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM t a JOIN t b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
q AS (
  SELECT r, anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5)
SELECT q.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY q.r, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM q JOIN p ON p.r = q.r AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY q.r, positive_id ORDER BY score DESC, id) <= 3
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 50 == 0)


@query("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_encode(table(spark, sf_dir, "documents"), piece_vocabulary(), with_ids=False, check=True)


@query("op13_conversation_repair", r"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, role, text, list_reduce(
    list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda s, c: list_reduce([xor(s, c), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS h
  FROM conversations),
f AS (SELECT conv_id, turn, role, text, xor(h, 4294967295) % 20 AS fault FROM b),
d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN fault = 0 THEN [] WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f),
k AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM d JOIN k ON d.conv_id IS NOT DISTINCT FROM k.conv_id),
m AS (
  SELECT c, turn, role, text, i, left(role, 1) AS first, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
    CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
inserts(a, s, cost, edits, made) AS (VALUES
  (0, 0, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, '', ''), (1, 2, 3, 'I', chr(10) || 'user:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', chr(10) || 'user:')),
moves(s, first, e, edit, role) AS (VALUES
  (0, 's', 1, 'K', ''), (0, 'u', 2, 'K', ''), (1, 'u', 2, 'K', ''), (3, 'u', 2, 'K', ''), (2, 'a', 3, 'K', ''),
  (0, '', 2, 'R', 'user'), (1, '', 2, 'R', 'user'), (3, '', 2, 'R', 'user'), (2, '', 3, 'R', 'assistant'),
  (0, '', 0, 'D', ''), (1, '', 1, 'D', ''), (2, '', 2, 'D', ''), (3, '', 3, 'D', '')),
w(c, i, a, way) AS (
  SELECT c, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'made': ''} FROM k
  UNION ALL
  SELECT w.c, m.i, v.e, min({
    'cost': (way.cost + n.cost + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END)::BIGINT,
    'audit': way.audit || n.edits || edit,
    'made': way.made || n.made || CASE edit WHEN 'K' THEN chr(10) || m.role || ':' || text WHEN 'R' THEN chr(10) || v.role || ':' || text ELSE '' END})
  FROM w JOIN m ON m.c = w.c AND m.i = w.i + 1 JOIN inserts n ON n.a = w.a
  JOIN moves v ON v.s = n.s AND (edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR v.first = m.first)))
  GROUP BY w.c, m.i, v.e),
z AS (
  SELECT w.c, min({'cost': way.cost + n.cost, 'audit': way.audit || n.edits, 'made': way.made || n.made}) AS way
  FROM w JOIN inserts n ON n.a = w.a AND n.s IN (0, 3)
  WHERE w.i = (SELECT coalesce(max(m.i), 0) FROM m WHERE m.c = w.c) GROUP BY w.c),
g AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(way.cost AS BIGINT) AS cost, way.audit AS audit, sha256(substr(way.made, 2)) AS repaired_sha256
FROM k JOIN z USING (c) LEFT JOIN g USING (c)
""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), times=F.col("times"))
