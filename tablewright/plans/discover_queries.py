"""Queries for detection, inference and drift (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import discover as dis
from tablewright.operators.discover import DeclaredField
from tablewright.operators.profile import long_values
from tablewright.plans.file_queries import CUSTOMER_LAYOUT, CUSTOMER_LINE_SQL
from tablewright.plans.profile_queries import ORDER_TEXT, ORDER_TEXT_SQL, order_text
from tablewright.plans.registry import query
from tablewright.plans.sqltext import union_all
from tablewright.sources.layouts import render_fixed_width

DOC_LINES_SQL = """dl AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"""


def document_lines(t):
    return t.documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def score_sql(name: str, c: str, one: str, two: float, some: float) -> str:
    return f"""CASE WHEN count(DISTINCT {c}) = 1 AND min({c}) > 0 THEN {one} WHEN count(DISTINCT {c}) <= 2 AND min({c}) > 0 THEN {two} WHEN max({c}) > 0 THEN {some} ELSE 0 END AS {name}"""


FORMAT_BODY_SQL = f"""c AS (SELECT file, content, length(content) - length(replace(content, '|', '')) AS np, length(content) - length(replace(content, ',', '')) AS nc,
 length(content) - length(replace(content, chr(9), '')) AS nt, length(content) AS n FROM {{lines}} WHERE content <> ''),
s AS (SELECT file, count(*) AS line_count, {score_sql('p', 'np', '0.95', 0.75, 0.5)}, {score_sql('cs', 'nc', 'CASE WHEN max(np) = 0 THEN 0.9 ELSE 0.6 END', 0.7, 0.4)}, {score_sql('t', 'nt', '0.9', 0.7, 0.4)},
 CASE WHEN count(*) < 3 THEN 0 WHEN count(DISTINCT n) = 1 THEN CASE WHEN max(np + nc + nt) > 0 THEN 0.3 ELSE 0.85 END WHEN count(DISTINCT n) <= 2 THEN 0.6 ELSE 0.2 END AS f FROM c GROUP BY file),
fmt AS (SELECT file, CASE WHEN greatest(p, cs, t, f) <= 0.5 THEN 'unknown' WHEN p = greatest(p, cs, t, f) THEN 'pipe_delimited' WHEN cs = greatest(p, cs, t, f) THEN 'csv' WHEN t = greatest(p, cs, t, f) THEN 'tsv' ELSE 'fixed_width' END AS format,
 greatest(p, cs, t, f)::DOUBLE AS confidence, line_count FROM s)"""


@query("D01_detect_format", f"WITH {DOC_LINES_SQL}, {FORMAT_BODY_SQL.format(lines='dl')} SELECT * FROM fmt")
def _(t):
    return dis.detect_format(document_lines(t))


# A corpus of every format: one file per customer nation and kind.
CORPUS_SQL = f"""co AS (SELECT CAST(c_nationkey AS VARCHAR) || '-' || kind AS file, c_custkey AS line,
 CASE kind WHEN 'pipe' THEN CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || CAST(c_acctbal AS VARCHAR) WHEN 'csv' THEN CAST(c_custkey AS VARCHAR) || ',' || c_mktsegment
  WHEN 'tsv' THEN c_name || chr(9) || CASE WHEN c_custkey % 3 = 0 THEN chr(9) ELSE '' END || CAST(c_custkey AS VARCHAR) ELSE {CUSTOMER_LINE_SQL} END AS content
 FROM customer, (VALUES ('pipe'), ('csv'), ('tsv'), ('fixed')) k(kind))"""


def corpus(t):
    k = F.col("c_custkey").cast("string")
    fixed = render_fixed_width(t.customer, CUSTOMER_LAYOUT, keep=["c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment"])
    texts = {
        "pipe": F.concat_ws("|", k, F.col("c_name"), F.col("c_acctbal").cast("string")),
        "csv": F.concat_ws(",", k, F.col("c_mktsegment")),
        "tsv": F.concat(F.col("c_name"), F.lit("\t"), F.when(F.col("c_custkey") % 3 == 0, "\t").otherwise(""), k),
        "fixed": F.col("value"),
    }
    entries = F.array(*[F.struct(F.concat(F.col("c_nationkey").cast("string"), F.lit(f"-{n}")).alias("file"), c.alias("content")) for n, c in texts.items()])
    return fixed.select(F.col("c_custkey").alias("line"), F.inline(entries))


@query("D01_detect_format_corpus", f"WITH {CORPUS_SQL}, {FORMAT_BODY_SQL.format(lines='co')} SELECT * FROM fmt")
def _(t):
    return dis.detect_format(corpus(t))


@query("D02_modal_column_count", f"""WITH {DOC_LINES_SQL}, m AS (SELECT file, len(string_split(content, ',')) AS n, count(*) AS k, min(line) AS first_line FROM dl GROUP BY ALL)
SELECT file, CAST(arg_max(n, (k, -first_line)) AS BIGINT) AS column_count FROM m GROUP BY file""")
def _(t):
    return dis.modal_column_count(document_lines(t), ",")


SPANS_SQL = f"""r AS (SELECT c_custkey % 4 AS file, c_custkey AS line, {CUSTOMER_LINE_SQL} AS content FROM customer),
u AS (SELECT file, i FROM (SELECT file, content, unnest(range(0, length(content))) AS i FROM r) WHERE substring(content, i + 1, 1) <> ' ' GROUP BY file, i),
g AS (SELECT file, i, i - row_number() OVER (PARTITION BY file ORDER BY i) AS run FROM u),
sp AS (SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY min(i)) AS INTEGER) AS field_number, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + 1 AS INTEGER) AS "end" FROM g GROUP BY file, run)"""


def rendered(t):
    lines = render_fixed_width(t.customer, CUSTOMER_LAYOUT, keep=["c_custkey"])
    return lines.select((F.col("c_custkey") % 4).alias("file"), F.col("c_custkey").alias("line"), F.col("value").alias("content"))


@query("D03_infer_boundaries", f"WITH {SPANS_SQL} SELECT * FROM sp")
def _(t):
    return dis.infer_boundaries(rendered(t))


@query("D04_infer_types", union_all(*[f"""SELECT '{c}' AS column_name, CASE WHEN bool_and(regexp_full_match({c}, '(19|20)[0-9]{{6}}')) THEN 'date'
 WHEN bool_and(regexp_full_match({c}, '[+-]?[0-9]+(\\.[0-9]+)?')) THEN 'number' ELSE 'string' END AS data_type FROM {ORDER_TEXT_SQL}""" for c in ORDER_TEXT]))
def _(t):
    return dis.infer_types(long_values(order_text(t)), ["column_name"])


@query("D05_infer_mapping", f"""WITH {CORPUS_SQL}, {FORMAT_BODY_SQL.format(lines='co')},
u AS (SELECT file, i FROM (SELECT file, content, unnest(range(0, length(content))) AS i FROM co JOIN fmt USING (file) WHERE format = 'fixed_width') WHERE substring(content, i + 1, 1) <> ' ' GROUP BY file, i),
g AS (SELECT file, i, i - row_number() OVER (PARTITION BY file ORDER BY i) AS run FROM u),
sp AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY min(i)) AS fno, min(i) AS lo, max(i) + 1 AS hi FROM g GROUP BY file, run),
cells AS (SELECT file, fno, trim(substring(content, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT))) AS v, lo, hi FROM sp JOIN co USING (file)
 UNION ALL SELECT file, fno, trim(v, ' ' || chr(9)), NULL, NULL FROM (SELECT file, unnest(string_split(content, d)) AS v, generate_subscripts(string_split(content, d), 1) AS fno, cnt FROM (
   SELECT co.file, content, CASE format WHEN 'pipe_delimited' THEN '|' WHEN 'csv' THEN ',' ELSE chr(9) END AS d, cnt FROM co JOIN fmt USING (file) JOIN (
    SELECT file, arg_max(n, (k, -first_line)) AS cnt FROM (SELECT file, len(string_split(content, CASE format WHEN 'pipe_delimited' THEN '|' WHEN 'csv' THEN ',' ELSE chr(9) END)) AS n, count(*) AS k, min(line) AS first_line
     FROM co JOIN fmt USING (file) GROUP BY ALL) GROUP BY file) USING (file) WHERE format NOT IN ('fixed_width', 'unknown'))) WHERE fno <= cnt)
SELECT file, any_value(format) AS format, CAST(fno AS INTEGER) AS field_number, 'FIELD_' || lpad(CAST(fno AS VARCHAR), 3, '0') AS name,
 CASE WHEN bool_and(regexp_full_match(v, '(19|20)[0-9]{{6}}')) FILTER (v <> '') THEN 'date' WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?')) FILTER (v <> '') THEN 'number' ELSE 'string' END AS data_type,
 CAST(any_value(lo) AS INTEGER) AS position, CAST(any_value(hi - lo) AS INTEGER) AS length FROM cells JOIN fmt USING (file) GROUP BY file, fno""")
def _(t):
    return dis.infer_mapping(corpus(t))


EVENT_LINES_SQL = """el AS (SELECT user_id % 5 AS file, event_id AS line, upper(left(event_type, 3)) || CAST(1000 + user_id AS VARCHAR) || CAST(value AS VARCHAR) AS content FROM events)"""
CAND_SQL = f"""{EVENT_LINES_SQL}, sz AS (SELECT file, count(*) AS total, min(length(content)) AS shortest FROM el GROUP BY file),
gr AS (SELECT p.p AS position, n.n AS length FROM range(1, 12) p(p), range(1, 7) n(n)),
cn AS (SELECT file, position, length, substring(content, position, length) AS v, count(*) AS k FROM el, gr WHERE length(content) >= position + length - 1 GROUP BY ALL),
rp AS (SELECT file, position, length, count(*) AS d, sum(k) AS covered, min(v) AS lo, max(v) AS hi FROM cn WHERE k >= 2 GROUP BY ALL),
cd AS (SELECT file, CAST(position AS INTEGER) AS position, CAST(length AS INTEGER) AS length, d AS distinct_values, round((covered / total)::DOUBLE, 4) AS confidence, lo AS least_value, hi AS greatest_value
 FROM rp JOIN sz USING (file) WHERE d BETWEEN 2 AND 8 AND position + length - 1 <= shortest AND covered * 2 >= total)"""


def event_lines(t):
    content = F.concat(F.upper(F.left("event_type", F.lit(3))), (F.col("user_id") + 1000).cast("string"), F.col("value").cast("string"))
    return t.events.select((F.col("user_id") % 5).alias("file"), F.col("event_id").alias("line"), content.alias("content"))


@query("D06_detect_discriminator", f"WITH {CAND_SQL} SELECT * FROM cd")
def _(t):
    return dis.detect_discriminator(event_lines(t), max_position=dis.MAX_POSITION)


@query("D06_best_discriminator", f"""WITH {CAND_SQL} SELECT file, position, length, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, distinct_values DESC, position, length DESC) AS rn FROM cd) WHERE rn = 1""")
def _(t):
    return dis.best_discriminator(dis.detect_discriminator(event_lines(t), max_position=dis.MAX_POSITION))


# The customer layout as declared by somebody who got some starts wrong.
DRIFTED = [DeclaredField("key", 1, 10), DeclaredField("name", 9, 20), DeclaredField("nation", 31, 3), DeclaredField("balance", 30, 12), DeclaredField("segment", 56, 12), DeclaredField("far", 150, 5)]


def field_drift_sql(f) -> str:
    return f"""SELECT s.file, '{f.name}' AS name, {f.start} AS expected_start, CAST(arg_max(st.p, (st.k, -st.p)) AS INTEGER) AS actual_start, {f.length} AS expected_length,
 CASE WHEN abs(arg_max(st.p, (st.k, -st.p)) - {f.start}) > 5 THEN 'error' ELSE 'warning' END AS severity, 'position' AS reason
 FROM (SELECT file, count(*) AS total, count(*) FILTER (trim(substring(content, {f.start}, 1)) = '') AS blank FROM r GROUP BY file) s JOIN st ON st.file = s.file
 WHERE blank > total * 0.8 AND st.p BETWEEN {f.start} - 15 AND {f.start} + 14 AND st.p <> {f.start} GROUP BY s.file, total HAVING max(st.k) > total * 0.5"""


DRIFT_SQL = f"""WITH {SPANS_SQL}, st AS (SELECT file, p, count(*) AS k FROM (SELECT file, content, unnest(range(1, length(content) + 1)) AS p FROM r)
 WHERE substring(content, p, 1) <> ' ' AND (p = 1 OR substring(content, p - 1, 1) = ' ') GROUP BY file, p) {union_all(*[field_drift_sql(f) for f in DRIFTED])}"""


@query("D07_fixed_width_drift", DRIFT_SQL)
def _(t):
    return dis.fixed_width_drift(rendered(t), DRIFTED)


HEADS_SQL = f"""{DOC_LINES_SQL}, hd AS (SELECT file, list_transform(string_split(arg_min(content, line) FILTER (trim(content) <> ''), ' '), lambda c: trim(c)) AS c FROM dl GROUP BY file),
hh AS (SELECT file, c, len(list_filter(c, lambda x: x <> '' AND NOT regexp_full_match(x, '-*[.]*[0-9][0-9.]*'))) > 0 AS header FROM hd WHERE c IS NOT NULL)"""
EXPECTED = ["the", "The", "un", "de", "la", "in"]
EXPECTED_SQL = "[" + ", ".join(f"'{x}'" for x in EXPECTED) + "]"
DELIMITED_SQL = f"""WITH {HEADS_SQL} SELECT file, CAST(len(c) AS INTEGER) AS actual_columns, x AS name, 'error' AS severity, 'column_missing' AS reason FROM (SELECT file, c, unnest(list_filter({EXPECTED_SQL}, lambda x: NOT list_contains(c, x))) AS x FROM hh WHERE header)
UNION ALL SELECT file, CAST(n AS INTEGER), x, 'warning', 'unexpected_column' FROM (SELECT file, len(c) AS n, unnest(list_distinct(list_filter(c, lambda x: x <> '' AND NOT list_contains({EXPECTED_SQL}, x)))) AS x FROM hh WHERE header)
UNION ALL SELECT file, CAST(len(c) AS INTEGER), '_column_count', 'error', 'column_count_mismatch' FROM hh WHERE NOT header AND len(c) <> {len(EXPECTED)}"""


@query("D08_delimited_drift", DELIMITED_SQL)
def _(t):
    return dis.delimited_drift(document_lines(t), EXPECTED, " ")


@query("D09_drift_report", f"SELECT file, name, severity, reason FROM ({DRIFT_SQL})")
def _(t):
    mapping = {"format": "fixed_width", "fields": [{"name": f.name, "position": f.start, "length": f.length} for f in DRIFTED]}
    return dis.drift_report(rendered(t), mapping)


PIPE_HEADS_SQL = HEADS_SQL.replace("string_split(arg_min(content, line) FILTER (trim(content) <> ''), ' ')", "string_split(replace(arg_min(content, line) FILTER (trim(content) <> ''), ' ', '|'), '|')")
PIPE_SQL = DELIMITED_SQL.replace(HEADS_SQL, PIPE_HEADS_SQL)


@query("D09_drift_report_pipe", f"""SELECT file, name, severity, reason FROM ({PIPE_SQL})
UNION ALL SELECT doc_id, NULL, 'skipped', 'too_short' FROM documents WHERE trim(replace(text, chr(10), '')) = ''""")
def _(t):
    lines = document_lines(t).withColumn("content", F.replace("content", F.lit(" "), F.lit("|")))
    return dis.drift_report(lines, {"format": "pipe", "fields": [{"name": n} for n in EXPECTED]})


@query("D06_wide_discriminator", f"WITH {CAND_SQL.replace('range(1, 12)', 'range(1, (SELECT max(shortest) + 1 FROM sz))')} SELECT * FROM cd")
def _(t):
    return dis.detect_discriminator(event_lines(t), max_position=None)


@query("D09_drift_report_other", f"""WITH {DOC_LINES_SQL}, k AS (SELECT file, count(*) FILTER (trim(content) <> '') AS n FROM dl GROUP BY file)
SELECT file, CAST(NULL AS VARCHAR) AS name, 'skipped' AS severity, 'unsupported_format' AS reason FROM k""")
def _(t):
    return dis.drift_report(document_lines(t), {"format": "xml", "fields": [{"name": "a"}]})
