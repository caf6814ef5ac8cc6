"""Shared parts of the check SQL, stated over the star tables themselves."""

from __future__ import annotations

from sarani.operators.templates import TEMPLATES

CORPUS = """
corpus_rows AS (
  SELECT 'part_' || (p_partkey // 20) AS table_id, 'part' AS title,
         ['name', 'brand', 'type', 'size', 'price'] AS header,
         CAST(p_partkey % 20 AS INTEGER) AS row_no,
         [p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)] AS vals
  FROM part
  UNION ALL
  SELECT 'customer_' || (c_custkey // 25), 'customer', ['name', 'nation', 'segment', 'balance'],
         CAST(c_custkey % 25 AS INTEGER),
         [c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment, CAST(c_acctbal AS VARCHAR)]
  FROM customer
  UNION ALL
  SELECT 'supplier_' || (s_suppkey // 10), 'supplier', ['name', 'nation', 'balance'],
         CAST(s_suppkey % 10 AS INTEGER), [s_name, CAST(s_nationkey AS VARCHAR), CAST(s_acctbal AS VARCHAR)]
  FROM supplier
),
corpus AS (
  SELECT table_id, ANY_VALUE(title) AS title, ANY_VALUE(header) AS header,
         LIST(vals ORDER BY row_no) AS trows, COUNT(*) AS n_rows
  FROM corpus_rows GROUP BY table_id
),
cells AS (
  SELECT table_id, row_no, CAST(UNNEST(RANGE(LEN(vals))) AS INTEGER) AS col_no,
         UNNEST(header) AS header, UNNEST(vals) AS value
  FROM corpus_rows
),
columns_of AS (
  SELECT table_id, col_no, header, BOOL_AND(REGEXP_FULL_MATCH(value, '\\pN+')) AS is_numeric
  FROM cells GROUP BY table_id, col_no, header
),
numeric_of AS (
  SELECT table_id, COALESCE(LIST(col_no ORDER BY col_no) FILTER (is_numeric), []) AS numcols
  FROM columns_of GROUP BY table_id
)"""

# The text each template must give: slots by number, {w} the table, {L1} a literal.
PATTERNS = {
    1: "select {1} from {w} where {2} = {L1}",
    2: "select abs({1}) from {w} where {2} = {L1}",
    3: "select count({1}) from {w} where {2} = {L1}",
    4: "select count(distinct{1}) from {w}",
    5: "select sum({1}) from {w} where {2} = {L1}",
    6: "select min({1}) from {w} where {2} = {L1}",
    7: "select max({1}) from {w} where {2} = {L1}",
    8: "select avg({1}) from {w} where {2} = {L1}",
    9: "select {1} from {w} order by {2} desc limit 1",
    10: "select {1} from {w} group by {1} order by count(*) desc limit 1",
    11: "select {1} from {w} where {2} between {L1} and {L2}",
    12: "select {1} from {w} where {2} like {L1}",
    13: "select ( select {1} from {w} where {2} = {L1} ) - ( select {1} from {w} where {2} = {L2} )",
    14: "select {1} from {w} where {2} in ( select {2} from {w} where {3} = {L1} )",
    15: "select {1} from {w} where {2} = {L1} union select {1} from {w} where {3} = {L2}",
    16: "select {1} from {w} where {2} = {L1} intersect select {1} from {w} where {3} = {L2}",
    17: "select {1} from {w} where {2} = {L1} except select {1} from {w} where {3} = {L2}",
    18: "select {1} from {w} where id = {L1}",
    19: "select {1} from {w} group by {1} order by count(*) desc limit 1",
    20: "select {1} from {w} where {2} = {L1} and {3} = {L2}",
    21: "select {1} from {w} where {2} = {L1} or {3} = {L2}",
    22: "select {1} from {w} where not {2} = {L1}",
    23: "select {1} from {w} where {2} not in ( select {2} from {w} where {3} = {L1} )",
    24: "select {1} from {w} order by {2} asc limit 3",
    25: "select sum({1}) from {w} group by {2}",
    26: "select count(*) from {w} group by {1}",
    27: "select {1} from {w} group by {1} having count(*) > 1",
    28: "select subtract({1},{2}) from {w} where {3} = {L1}",
}


def _template_row(t: dict) -> str:
    slots, places, owners = [], [], []
    last = None
    for i, token in enumerate(t["tokens"]):
        if token["kind"] == "Column":
            if token["value"] not in slots:
                slots.append(token["value"])
            last = slots.index(token["value"]) + 1
        elif "Literal" in token["kind"]:
            places.append(i)
            owners.append(last or 0)
    numeric = ["number" in s for s in slots]
    texts = ", ".join(f"'{s}'" for s in slots)
    flags = ", ".join(str(n) for n in numeric)
    return (
        f"({t['template_id']}, '{t['family']}', '{t['func']}', '{PATTERNS[t['template_id']]}', [{texts}], [{flags}], "
        f"{places}::INTEGER[], {owners}::INTEGER[], {any(numeric)}, {' id ' in PATTERNS[t['template_id']]})"
    )


TEMPLATE_VALUES = """
templates(template_id, family, func, pattern, slots, slotnum, litpos, litslot, numeric, has_id) AS (
  VALUES """ + ",\n  ".join(_template_row(t) for t in TEMPLATES) + "\n)"


def _draw(part: str) -> str:
    return f"CAST('0x' || SUBSTR(MD5('42|' || table_id || '|' || template_id || '|' || {part}), 1, 8) AS BIGINT)"


BOUND = f"""{CORPUS},
{TEMPLATE_VALUES},
pairs AS (
  SELECT * FROM corpus JOIN numeric_of USING (table_id) CROSS JOIN templates
  WHERE NOT has_id AND (NOT numeric OR LEN(numcols) > 0)
),
with_cols AS (
  SELECT *, LIST_TRANSFORM(slots, LAMBDA s, i: CASE WHEN slotnum[i]
      THEN numcols[1 + {_draw('s')} % LEN(numcols)]
      ELSE CAST({_draw('s')} % LEN(header) AS INTEGER) END) AS slot_cols
  FROM pairs
),
with_lits AS (
  SELECT *, LIST_TRANSFORM(litpos, LAMBDA p, k:
      trows[1 + {_draw('p')} % n_rows][1 + slot_cols[litslot[k]]]) AS lits
  FROM with_cols
),
bound AS (
  SELECT *, REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(pattern,
      '{{w}}', '`' || table_id || '`'),
      '{{1}}', '`' || header[1 + slot_cols[1]] || '`'),
      '{{2}}', COALESCE('`' || header[1 + slot_cols[2]] || '`', '')),
      '{{3}}', COALESCE('`' || header[1 + slot_cols[3]] || '`', '')),
      '{{L1}}', COALESCE('"' || REPLACE(lits[1], '"', '""') || '"', '')),
      '{{L2}}', COALESCE('"' || REPLACE(lits[2], '"', '""') || '"', '')) AS sql
  FROM with_lits
)"""

OPENED = f"""{BOUND},
opened AS (
  SELECT table_id, template_id, family, func, lits,
         v[1 + slot_cols[1]] AS s1, v[1 + slot_cols[2]] AS s2, v[1 + slot_cols[3]] AS s3,
         CAST(row_no AS INTEGER) AS row_no
  FROM (SELECT *, UNNEST(RANGE(n_rows)) AS row_no, UNNEST(trows) AS v FROM bound)
)"""

_N1 = "TRY_CAST(s1 AS DOUBLE)"


def _num(x: str) -> str:
    return f"CAST(ROUND({x}, 4) AS VARCHAR)"


# Answers of each family from `opened`.
FAMILY_SQL = {
    "project_where": f"""
SELECT table_id, template_id, row_no, CASE WHEN func = 'abs' THEN {_num(f'ABS({_N1})')} ELSE s1 END AS value
FROM opened WHERE family = 'project_where' AND s2 = lits[1]""",
    "count_where": """
SELECT table_id, template_id, CAST(0 AS INTEGER) AS row_no, CAST(COUNT(*) FILTER (s2 = lits[1]) AS VARCHAR) AS value
FROM opened WHERE family = 'count_where' GROUP BY table_id, template_id""",
    "count_distinct": """
SELECT table_id, template_id, CAST(0 AS INTEGER) AS row_no, CAST(COUNT(DISTINCT s1) AS VARCHAR) AS value
FROM opened WHERE family = 'count_distinct' GROUP BY table_id, template_id""",
    "numeric_agg": f"""
SELECT table_id, template_id, CAST(0 AS INTEGER) AS row_no,
       CASE func WHEN 'sum' THEN {_num(f'SUM({_N1})')} WHEN 'min' THEN {_num(f'MIN({_N1})')}
                 WHEN 'max' THEN {_num(f'MAX({_N1})')} ELSE {_num(f'AVG({_N1})')} END AS value
FROM opened WHERE family = 'numeric_agg' AND s2 = lits[1] GROUP BY table_id, template_id, func""",
    "superlative": """
SELECT table_id, template_id, CAST(0 AS INTEGER) AS row_no, s1 AS value
FROM opened WHERE family = 'superlative'
QUALIFY ROW_NUMBER() OVER (PARTITION BY table_id, template_id ORDER BY TRY_CAST(s2 AS DOUBLE) DESC, row_no) = 1""",
    "most_frequent": """
SELECT table_id, template_id, CAST(0 AS INTEGER) AS row_no, s1 AS value
FROM opened WHERE family = 'most_frequent' GROUP BY table_id, template_id, s1
QUALIFY ROW_NUMBER() OVER (PARTITION BY table_id, template_id ORDER BY COUNT(*) DESC, s1) = 1""",
    "between": """
SELECT table_id, template_id, row_no, s1 AS value FROM opened
WHERE family = 'between'
  AND TRY_CAST(s2 AS DOUBLE) BETWEEN TRY_CAST(lits[1] AS DOUBLE) AND TRY_CAST(lits[2] AS DOUBLE)""",
    "like": """
SELECT table_id, template_id, row_no, s1 AS value FROM opened WHERE family = 'like' AND s2 LIKE lits[1]""",
    "difference": f"""
SELECT table_id, template_id, CAST(0 AS INTEGER) AS row_no,
       {_num(f'MAX({_N1}) FILTER (s2 = lits[1]) - MAX({_N1}) FILTER (s2 = lits[2])')} AS value
FROM opened WHERE family = 'difference' GROUP BY table_id, template_id
HAVING COUNT(*) FILTER (s2 = lits[1]) <= 1 AND COUNT(*) FILTER (s2 = lits[2]) <= 1""",
    "in_subquery": """
SELECT table_id, template_id, row_no, s1 AS value FROM opened o
WHERE family = 'in_subquery' AND EXISTS (
  SELECT 1 FROM opened i WHERE i.family = 'in_subquery' AND i.table_id = o.table_id
     AND i.template_id = o.template_id AND i.s3 = i.lits[1] AND i.s2 = o.s2)""",
    "set_operation": """
SELECT DISTINCT table_id, template_id, CAST(0 AS INTEGER) AS row_no, value FROM (
  SELECT table_id, template_id, func, s1 AS value, BOOL_OR(s2 = lits[1]) AS a, BOOL_OR(s3 = lits[2]) AS b
  FROM opened WHERE family = 'set_operation' GROUP BY table_id, template_id, func, s1)
WHERE CASE func WHEN 'union' THEN a OR b WHEN 'intersect' THEN a AND b ELSE a AND NOT b END""",
    "bool_where": """
SELECT table_id, template_id, row_no, s1 AS value FROM opened WHERE family = 'bool_where'
  AND CASE func WHEN 'and' THEN s2 = lits[1] AND s3 = lits[2] WHEN 'or' THEN s2 = lits[1] OR s3 = lits[2] ELSE s2 <> lits[1] END""",
    "not_in": """
SELECT table_id, template_id, row_no, s1 AS value FROM opened o
WHERE family = 'not_in' AND NOT EXISTS (
  SELECT 1 FROM opened i WHERE i.family = 'not_in' AND i.table_id = o.table_id
     AND i.template_id = o.template_id AND i.s3 = i.lits[1] AND i.s2 = o.s2)""",
    "lowest_k": """
SELECT table_id, template_id, CAST(rank - 1 AS INTEGER) AS row_no, value FROM (
  SELECT table_id, template_id, s1 AS value,
    ROW_NUMBER() OVER (PARTITION BY table_id, template_id ORDER BY TRY_CAST(s2 AS DOUBLE), row_no) AS rank
  FROM opened WHERE family = 'lowest_k') WHERE rank <= 3""",
    "group_agg": f"""
SELECT table_id, template_id, CAST(0 AS INTEGER) AS row_no,
  CASE func WHEN 'sum' THEN {_num(f'SUM({_N1})')} ELSE CAST(COUNT(*) AS VARCHAR) END AS value
FROM opened WHERE family = 'group_agg' GROUP BY table_id, template_id, func, CASE func WHEN 'sum' THEN s2 ELSE s1 END""",
    "having": """
SELECT table_id, template_id, CAST(0 AS INTEGER) AS row_no, s1 AS value
FROM opened WHERE family = 'having' GROUP BY table_id, template_id, s1 HAVING COUNT(*) > 1""",
    "subtract": f"""
SELECT table_id, template_id, row_no, {_num(f'{_N1} - TRY_CAST(s2 AS DOUBLE)')} AS value
FROM opened WHERE family = 'subtract' AND s3 = lits[1]""",
}

ANSWERS = OPENED + ",\nanswers AS (" + "\nUNION ALL".join(f"({s})" for s in FAMILY_SQL.values()) + ")"

# The selected expression of a pair's SQL text, a bare column without backticks.
ANSWER_HEADER = """CASE WHEN b.func = 'abs' OR b.family = 'count_where'
      THEN REGEXP_EXTRACT(b.sql, '^select (.*?) from ', 1)
      WHEN b.family = 'difference' THEN SUBSTR(b.sql, 8)
      WHEN b.family IN ('count_distinct', 'numeric_agg', 'group_agg', 'subtract') THEN REGEXP_EXTRACT(b.sql, '^select (.*?) from ', 1)
      ELSE b.header[1 + b.slot_cols[1]] END"""
