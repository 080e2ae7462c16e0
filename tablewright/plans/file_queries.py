"""Queries for sources and sinks (S) and fixed-width layout checks (L).

Text files are derived from the shared tables inside the query and written to
the shared scratch folder, so the scans run on real files of any size.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import functions as F

from tablewright.functions.pictures import picture_holds
from tablewright.operators import layout as lay
from tablewright.operators.rules import FieldRule, validate
from tablewright.plans.registry import query
from tablewright.plans.rule_queries import LINE, PRICING_RULES, line_id
from tablewright.plans.sqltext import union_all
from tablewright.session import scratch_folder
from tablewright.sources import database, delimited, files, layouts, sinks
from tablewright.sources.layouts import LayoutField
from tablewright.sources.rows import number_file_rows, number_rows

CUSTOMER_LAYOUT = layouts.layout_from_mapping({
    "fields": [
        {"name": "c_custkey", "length": 10},
        {"name": "c_name", "length": 20},
        {"name": "c_nationkey", "length": 3},
        {"name": "c_acctbal", "length": 12},
        {"name": "c_mktsegment", "length": 12},
    ]
})
CUSTOMER_LINE_SQL = """rpad(left(CAST(c_custkey AS VARCHAR), 10), 10, ' ') || rpad(left(c_name, 20), 20, ' ') || rpad(left(CAST(c_nationkey AS VARCHAR), 3), 3, ' ')
 || rpad(left(CAST(c_acctbal AS VARCHAR), 12), 12, ' ') || rpad(left(c_mktsegment, 12), 12, ' ')"""
PARSED_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"""


@query("S01_scan_delimited", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def _(t):
    folder = scratch_folder(t.spark, "delimited")
    rows = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    delimited.write_delimited(rows, folder, header=False)
    return delimited.scan_delimited(t.spark, folder, ["id", "name", "segment"]).drop("_malformed")


@query("S02_scan_fixed_width", PARSED_SQL)
def _(t):
    folder = scratch_folder(t.spark, "fixed")
    layouts.write_fixed_width(t.customer, CUSTOMER_LAYOUT, folder)
    return layouts.scan_fixed_width(t.spark, folder, CUSTOMER_LAYOUT)


@query("S03_layout_from_mapping", PARSED_SQL)
def _(t):
    return layouts.slice_fields(layouts.render_fixed_width(t.customer, CUSTOMER_LAYOUT), CUSTOMER_LAYOUT)


@query("S06_with_row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS _row FROM orders")
def _(t):
    return number_rows(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "_row")


@query("S06_file_row_number", "SELECT count(*) AS lines, CAST(0 AS BIGINT) AS misnumbered_files FROM orders")
def _(t):
    folder = scratch_folder(t.spark, "lines")
    t.orders.orderBy("o_orderkey").select(F.col("o_orderkey").cast("string")).write.text(folder)
    per_file = number_file_rows(t.spark.read.text(folder)).groupBy("_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("_row").alias("lo"), F.max("_row").alias("hi"), F.sum("_row").alias("s"))
    wrong = ~((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("s") * 2 == F.col("n") * (F.col("n") + 1)))
    return per_file.agg(F.sum("n").alias("lines"), F.count_if(wrong).alias("misnumbered_files"))


@query("S07_scan_jdbc_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def _(t):
    return database.project_table(t.orders, ["o_orderkey", "o_totalprice"], "o_totalprice > 400000")


@query("S08_scan_jdbc_query", """SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000""")
def _(t):
    sql = "SELECT o_orderkey, c_name FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > :least"
    return database.query_views(t.spark, sql, {"orders": t.orders, "customer": t.customer}, {"least": 300000})


@query("S07_range_splits", """WITH b AS (SELECT min(o_orderdate) AS lo, date_diff('day', min(o_orderdate), max(o_orderdate)) AS width FROM orders),
c AS (SELECT i, CAST(lo AS DATE) + CAST(width * i // 7 AS INTEGER) AS cut FROM b, range(1, 7) r(i)),
s AS (SELECT (SELECT count(*) FROM c WHERE o_orderdate >= cut) AS split FROM orders)
SELECT CAST(i AS INTEGER) AS split, CAST(count(s.split) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS claimed_twice FROM range(0, 7) r(i) LEFT JOIN s ON s.split = i GROUP BY i""")
def _(t):
    dated = t.orders.select(F.col("o_orderdate").cast("date").alias("o_orderdate"))
    splits = database.range_splits("o_orderdate", *database.key_bounds(dated, "o_orderdate"), 7)
    return database.split_balance(dated, splits)


@query("S08_remainder_splits", """WITH q AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_returnflag = 'R' THEN -l_orderkey ELSE l_orderkey END AS k FROM lineitem),
s AS (SELECT coalesce(abs(k) % 12, 0) AS split FROM q)
SELECT CAST(i AS INTEGER) AS split, CAST(count(s.split) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS claimed_twice FROM range(0, 12) r(i) LEFT JOIN s ON s.split = i GROUP BY i""")
def _(t):
    sql = "SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_returnflag = 'R' THEN -l_orderkey ELSE l_orderkey END AS k FROM {lineitem}"
    rows = database.query_views(t.spark, sql, {"lineitem": t.lineitem})
    return database.split_balance(rows, database.remainder_splits("k", 12))


@query("S09_sample_table", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(t):
    return database.first_rows(t.customer, 10, [F.desc("c_acctbal"), "c_custkey"]).select("c_custkey", "c_name")


@query("S10_write_delimited", """SELECT CAST(p_partkey AS VARCHAR) || '|' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END || '|' || p_brand AS value FROM part""")
def _(t):
    folder = scratch_folder(t.spark, "export")
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")), "p_brand")
    delimited.write_delimited(rows, folder, header=False)
    return t.spark.read.text(folder)


@query("S11_write_fixed_width", f"SELECT {CUSTOMER_LINE_SQL} AS value FROM customer")
def _(t):
    return layouts.render_fixed_width(t.customer, CUSTOMER_LAYOUT)


def exported(t, name, jobs):
    folder = scratch_folder(t.spark, name)
    sinks.export_tables(jobs, folder)
    lines = [
        t.spark.read.option("header", "true").csv(f"{folder}/{table}", sep="|").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table_name"), "rows")
        for table in jobs
    ]
    return lines[0].unionByName(lines[1])


@query("S12_export_tables", "SELECT 'part' AS table_name, count(*) AS rows FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def _(t):
    return exported(t, "tables", {"part": t.part, "supplier": t.supplier})


@query("S13_table_stats", """SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS column_names FROM part""")
def _(t):
    return database.table_stats(t.part)


@query("S14_file_inventory", "SELECT count(*) AS line_count, 'ok' AS note, CAST(0 AS BIGINT) AS not_hashed FROM customer")
def _(t):
    folder = scratch_folder(t.spark, "inventory")
    layouts.render_fixed_width(t.customer, CUSTOMER_LAYOUT).write.text(folder)
    inventory = files.file_inventory(t.spark, folder, "part-*")
    filled = F.when(F.col("size_bytes") > 0, F.col("note"))
    return inventory.agg(F.sum("line_count").alias("line_count"), F.max(filled).alias("note"), F.count_if((F.col("size_bytes") > 0) & (F.col("sha256_status") != "hashed")).alias("not_hashed"))


@query("S15_extract_error_rows", f"""SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.08, false)
 OR NOT coalesce(l_quantity < 50, false) OR NOT coalesce(l_returnflag IN ('A','N'), false) OR NOT coalesce(l_discount >= l_tax, false)
 OR ({LINE}) IN (SELECT {LINE} FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.08 AND l_quantity < 50 AND l_returnflag IN ('A','N') AND l_discount >= l_tax))""")
def _(t):
    v = validate(t.lineitem, PRICING_RULES, line_id())
    return files.extract_error_rows(t.lineitem, v, line_id()).select("l_orderkey", "l_linenumber", "l_discount")


LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) AS dl"


def document_lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content")).withColumn("line", (F.col("line") + 1).cast("bigint"))


@query("S16_grep_files", f"SELECT doc_id, line, content FROM {LINES_SQL} WHERE contains(content, 'ation')")
def _(t):
    return files.grep_lines(document_lines(t), "ation")


@query("S16_grep_totals", f"SELECT count(*) AS total_matches, count(DISTINCT doc_id) AS matched_files, count(*) > 100 AS truncated FROM {LINES_SQL} WHERE contains(content, 'ation')")
def _(t):
    return files.hit_totals(files.grep_lines(document_lines(t), "ation"), 100, "doc_id")


@query("S16_grep_page", f"SELECT doc_id, line FROM {LINES_SQL} WHERE contains(content, 'ation') ORDER BY doc_id, line LIMIT 100")
def _(t):
    return files.top_hits(files.grep_lines(document_lines(t), "ation"), 100, ("doc_id", "line")).select("doc_id", "line")


@query("S16_grep_folder", "SELECT count(*) AS hits FROM customer WHERE contains(c_mktsegment, 'BUILD')")
def _(t):
    folder = scratch_folder(t.spark, "grep")
    layouts.render_fixed_width(t.customer, CUSTOMER_LAYOUT).write.text(folder)
    return files.grep_files(t.spark, folder, "BUILD", "part-*").agg(F.count(F.lit(1)).alias("hits"))


@query("S17_grep_archives", f"SELECT CAST(doc_id AS VARCHAR) || '.zip' AS archive, 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS file, line FROM {LINES_SQL} WHERE contains(content, 'ation') AND doc_id % 2 = 0")
def _(t):
    def zipped(batches):
        # Handed on in small batches; an archive at a time is held as Python objects.
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, archives = batch.slice(start, 256), []
                for n, body in zip(part.column("name"), part.column("text"), strict=True):
                    buffer = io.BytesIO()
                    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr(n.as_py(), body.as_py() or "")
                    archives.append(buffer.getvalue())
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(archives, pa.binary())], names=["path", "content"])

    doc = F.col("doc_id").cast("string")
    member = F.concat(F.when(F.col("doc_id") % 2 == 0, "doc-").otherwise("other-"), doc, F.lit(".txt"))
    documents = t.documents.select(F.concat(doc, F.lit(".zip")).alias("path"), member.alias("name"), "text")
    archives = documents.mapInArrow(zipped, "path string, content binary")
    return files.search_archives(archives, "ation", "doc-*").select("archive", "file", "line")


@query("S14_streamed_digests", "SELECT count(*) AS lines, CAST(0 AS BIGINT) AS differing FROM customer")
def _(t):
    """Digests made from streams equal those made from whole contents."""
    folder = scratch_folder(t.spark, "inventory")
    layouts.render_fixed_width(t.customer, CUSTOMER_LAYOUT).repartition(3).write.text(folder)
    whole = files.file_inventory(t.spark, folder, "part-*").select("file", "line_count", "sha256")
    streamed = files.file_inventory(t.spark, folder, "part-*", in_one_piece=0).select("file", F.col("sha256").alias("streamed"))
    return whole.join(streamed, "file").agg(F.sum("line_count").alias("lines"), F.count_if(~F.col("sha256").eqNullSafe(F.col("streamed"))).alias("differing"))


@query("S17_grep_written_archives", f"SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS file, line FROM {LINES_SQL} WHERE contains(content, 'ation') AND doc_id % 2 = 0")
def _(t):
    """The documents of a batch share an archive in a folder, which is then searched."""
    folder = scratch_folder(t.spark, "archives")

    def written(batches):
        for n, batch in enumerate(batches):
            store, path = FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{TaskContext.get().partitionId()}-{n}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    z.writestr(name, text)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    member = F.concat(F.when(F.col("doc_id") % 2 == 0, "doc-").otherwise("other-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    t.documents.select(member.alias("name"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(written, "n long").agg(F.sum("n")).collect()
    return files.grep_archives(t.spark, folder, "ation", "*.zip", "doc-*").select("file", "line")


ISSUE_RULES = [
    FieldRule("acct_positive", "c_acctbal", ">", value=0),
    FieldRule("segment_known", "c_mktsegment", "in", values=("BUILDING", "MACHINERY"), severity="warning"),
]
ISSUES_SQL = union_all(
    """SELECT CAST(c_custkey AS BIGINT) AS row_number, 'c_acctbal' AS field, 'BR_ACCT_POSITIVE_FIELD' AS code, 'error' AS severity,
 'acct_positive (got: ' || CAST(c_acctbal AS VARCHAR) || ')' AS message FROM customer WHERE NOT c_acctbal > 0""",
    """SELECT CAST(c_custkey AS BIGINT), 'c_mktsegment', 'BR_SEGMENT_KNOWN_FIELD', 'warning', 'segment_known (got: ' || c_mktsegment || ')'
 FROM customer WHERE c_mktsegment NOT IN ('BUILDING','MACHINERY')""")


def issues(t):
    return validate(t.customer, ISSUE_RULES, "c_custkey")


@query("S18_sort_issues", f"""SELECT row_number AS source_row, row_number() OVER (ORDER BY row_number, field, code, severity, message) AS index,
 severity, message FROM ({ISSUES_SQL})""")
def _(t):
    return sinks.sort_issues(issues(t))


SIDECAR_SQL = """SELECT kind, CAST(row_number AS VARCHAR) AS source_row, CAST(row_number() OVER (PARTITION BY kind ORDER BY row_number, field, code) AS VARCHAR) AS index,
 severity, {message} AS message FROM (SELECT *, CASE WHEN severity = 'error' THEN 'errors' ELSE 'warnings' END AS kind FROM ({issues}))"""


def sidecars(t, redact):
    """What the written files hold."""
    folder = scratch_folder(t.spark, "issues")
    sinks.write_issues(issues(t), folder, redact)
    parts = [t.spark.read.csv(f"{folder}/{kind}", header=True).withColumn("kind", F.lit(kind)) for kind in ("errors", "warnings")]
    return parts[0].unionByName(parts[1])


@query("S18_write_issues", SIDECAR_SQL.format(message="message", issues=ISSUES_SQL))
def _(t):
    return sidecars(t, False)


@query("S18_write_redacted", SIDECAR_SQL.format(message="CASE field WHEN 'c_acctbal' THEN 'acct_positive: c_acctbal = [REDACTED]' ELSE 'segment_known: c_mktsegment = [REDACTED]' END", issues=ISSUES_SQL))
def _(t):
    return sidecars(t, True)


# Several files with equal row numbers: orders by status, numbered within each.
PARTED_SQL = """(SELECT o_orderstatus AS part, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS line, o_orderkey, o_totalprice, o_custkey FROM orders)"""
PARTED_RULES = [FieldRule("price_cap", "o_totalprice", "<=", value=200000), FieldRule("odd_customer", "o_custkey", "<", value=100, severity="warning")]
PARTED_ISSUES_SQL = f"""(SELECT part, line, 'price_cap (got: ' || CAST(o_totalprice AS VARCHAR) || ')' AS message FROM {PARTED_SQL} WHERE o_totalprice > 200000
 UNION ALL SELECT part, line, 'odd_customer (got: ' || CAST(o_custkey AS VARCHAR) || ')' FROM {PARTED_SQL} WHERE o_custkey >= 100)"""


def parted_orders(t):
    """Orders as they would come from one file per status; row numbers start at 0 in each."""
    rows = t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice", "o_custkey")
    numbered = number_rows(rows, ["o_orderstatus", "o_orderkey"], "_place")
    begin = numbered.groupBy("o_orderstatus").agg(F.min("_place").alias("_first"))
    return numbered.join(begin, "o_orderstatus").select(F.col("o_orderstatus").alias("_file"), (F.col("_place") - F.col("_first")).alias("_row"), "o_orderkey", "o_totalprice", "o_custkey")


@query("S15_extract_error_rows_of_files", f"""SELECT part AS _file, line AS _row, o_orderkey FROM {PARTED_SQL} WHERE o_totalprice > 200000""")
def _(t):
    rows = parted_orders(t)
    found = validate(rows, PARTED_RULES[:1])
    return files.extract_error_rows(rows, found).select("_file", "_row", "o_orderkey")


@query("S15_error_rows_with_headers", f"""SELECT part AS _file, line AS _row, o_orderkey FROM {PARTED_SQL} WHERE o_totalprice > 200000 OR line = 0""")
def _(t):
    rows = parted_orders(t)
    return files.extract_error_rows(rows, validate(rows, PARTED_RULES[:1]), header_row=0).select("_file", "_row", "o_orderkey")


@query("L09_affected_rows_of_files", f"""SELECT part AS _file, line AS row_number, count(*) AS issue_count, string_agg(message, '; ' ORDER BY message) AS messages FROM {PARTED_ISSUES_SQL} GROUP BY part, line""")
def _(t):
    found = lay.affected_rows(validate(parted_orders(t), PARTED_RULES))
    return found.withColumn("messages", F.array_join("messages", "; "))


@query("L09_affected_summary_of_files", f"""SELECT count(*) AS total_affected_rows, round(count(*)::DOUBLE * 100.0 / (SELECT count(*) FROM orders), 2) AS affected_row_pct
 FROM (SELECT DISTINCT part, line FROM {PARTED_ISSUES_SQL})""")
def _(t):
    rows = parted_orders(t)
    return lay.affected_summary(validate(rows, PARTED_RULES), t.orders.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("S19_batch_expected_outputs", "SELECT 'big' AS table_name, count(*) AS rows FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'done', count(*) FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    jobs = {name: database.query_views(t.spark, sql, {"orders": t.orders}) for name, sql in (
        ("big", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 400000"),
        ("done", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F'"))}
    return exported(t, "expected", jobs)


# ------------------------------------------------------------------- layouts
# Document lines as records that should have 120 characters.
@query("L01_length_summary", f"""SELECT count(*) AS total_lines, count(*) FILTER (length(content) = 120) AS correct_lines,
 count(*) FILTER (length(content) <> 120) AS incorrect_lines, CAST(120 AS BIGINT) AS expected_length FROM {LINES_SQL}""")
def _(t):
    return lay.length_summary(document_lines(t).withColumnRenamed("content", "value"), 120)


WIDE = [LayoutField(f"f{i:02d}", 1 + 10 * i, 10) for i in range(12)]
CUT_SQL = " || ".join(f"CASE WHEN {f.end} > n THEN '{f.name}, ' ELSE '' END" for f in WIDE)


@query("L01_row_length", f"""SELECT doc_id, line AS row_number, CASE WHEN length(content) < 120 THEN 'FW_LEN_002' ELSE 'FW_LEN_003' END AS issue_code,
 CAST(length(content) AS INTEGER) AS actual_length FROM {LINES_SQL} WHERE length(content) <> 120""")
def _(t):
    lines = document_lines(t).select("doc_id", F.col("line").alias("_row"), F.col("content").alias("value"))
    return lay.length_issues(lines, WIDE, keep=["doc_id"]).select("doc_id", "row_number", "issue_code", "actual_length")


@query("L01_row_length_report", f"""WITH i AS (SELECT doc_id * 10000 + line AS row_number, length(content) AS n FROM {LINES_SQL} WHERE length(content) <> 120)
SELECT CAST(row_number AS BIGINT) AS row_number, CAST(n AS INTEGER) AS actual_length, greatest((SELECT count(*) FROM i) - 200, 0) AS omitted FROM i ORDER BY row_number LIMIT 200""")
def _(t):
    lines = document_lines(t).select((F.col("doc_id") * 10000 + F.col("line")).alias("_row"), F.col("content").alias("value"))
    return lay.length_issue_report(lay.length_issues(lines, WIDE)).select("row_number", "actual_length", "omitted")


@query("L02_length_diagnostics", f"""SELECT doc_id, row_number, CASE WHEN n > 120 THEN '__TRAILING_DATA__' ELSE rtrim({CUT_SQL}, ', ') END AS field,
 CASE WHEN n > 120 THEN substring(content, 121) END AS trailing
FROM (SELECT doc_id, line AS row_number, content, length(content) AS n FROM {LINES_SQL}) WHERE n <> 120""")
def _(t):
    lines = document_lines(t).select("doc_id", F.col("line").alias("_row"), F.col("content").alias("value"))
    return lay.length_issues(lines, WIDE, keep=["doc_id"]).select("doc_id", "row_number", "field", "trailing")


@query("L03_uniform_length", f"""SELECT doc_id, CAST(min(length(content)) AS INTEGER) AS min_length, CAST(max(length(content)) AS INTEGER) AS max_length, count(*) AS lines,
 min(length(content)) = max(length(content)) AS uniform FROM {LINES_SQL} GROUP BY doc_id""")
def _(t):
    return lay.uniform_length(document_lines(t).withColumnRenamed("content", "value"), ["doc_id"])


# Rendered values of orders and line items against pictures.
PICTURES = [("xxx", "XXX"), ("day", "CCYYMMDD"), ("n5", "9(5)"), ("s5", "S9(5)"), ("dec", "+9(6)V9(2)"), ("xn", "X(15)"), ("an", "A(15)"), ("any", "??")]
PICTURE_ROWS_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'USA' ELSE 'U5' END AS xxx,
 CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y') || '1340' ELSE strftime(o_orderdate, '%Y%m%d') END AS day,
 lpad(CAST(o_orderkey % 20000 AS VARCHAR), CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 5 END, '0') AS n5,
 CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '*' END || lpad(CAST(o_custkey % 10000 AS VARCHAR), 5, '0') AS s5,
 CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '+' END || lpad(CAST(CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS VARCHAR), 8, '0') AS dec,
 o_orderpriority AS xn, CASE WHEN o_orderkey % 2 = 0 THEN 'Order kind' ELSE 'Order2' END AS an, o_orderstatus AS any FROM orders) AS pr"""


def picture_rows(t):
    k = F.col("o_orderkey")
    n5 = (k % 20000).cast("string")
    return t.orders.select(
        "o_orderkey", F.when(k % 3 == 0, "USA").otherwise("U5").alias("xxx"),
        F.when(k % 5 == 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("1340"))).otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"),
        F.when(k % 7 == 0, F.lpad(n5, 4, "0")).otherwise(F.lpad(n5, 5, "0")).alias("n5"),
        F.concat(F.when(k % 2 == 0, "-").otherwise("*"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 5, "0")).alias("s5"),
        F.concat(F.when(k % 4 == 0, "").otherwise("+"), F.lpad(F.bround(F.col("o_totalprice") * 100, 0).cast("bigint").cast("string"), 8, "0")).alias("dec"),
        F.col("o_orderpriority").alias("xn"), F.when(k % 2 == 0, "Order kind").otherwise("Order2").alias("an"), F.col("o_orderstatus").alias("any"),
    )


SHAPES = {"xxx": "[A-Za-z]{3}", "day": "[0-9]{8}", "n5": "[0-9]{5}", "s5": "[+-]?[0-9]{5}", "dec": "[+-][0-9]{8}", "xn": "[A-Za-z0-9 ]*", "an": "[A-Za-z ]*"}


@query("L04_picture_format", "SELECT o_orderkey, " + ", ".join(
    f"regexp_full_match({n}, '{SHAPES[n]}')" + (f" AND try_strptime({n}, '%Y%m%d') IS NOT NULL" if n == "day" else "") + f" AS {n}" if n in SHAPES else f"true AS {n}"
    for n, _ in PICTURES) + f" FROM {PICTURE_ROWS_SQL}")
def _(t):
    return picture_rows(t).select("o_orderkey", *[picture_holds(F.col(n), p).alias(n) for n, p in PICTURES])


@query("L04_picture_digits_only", f"SELECT o_orderkey, regexp_full_match(day, '[0-9]{{8}}') AS day FROM {PICTURE_ROWS_SQL}")
def _(t):
    return picture_rows(t).select("o_orderkey", picture_holds(F.col("day"), "CCYYMMDD", digits_only=True).alias("day"))


STRICT_LAYOUT = [
    LayoutField("status", 1, 1, valid_values=("F", "O"), required=True),
    LayoutField("priority", 2, 15, picture="A(15)"),
    LayoutField("note", 17, 8, picture="CCYYMMDD", required=True),
]
STRICT_ROWS_SQL = """(SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'HIGH' ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN '20251340' ELSE strftime(o_orderdate, '%Y%m%d') END AS note FROM orders) AS sr"""


def strict_rows(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.when(k % 3 == 0, "HIGH").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, "20251340").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("note"))


STRICT = {
    "FW_REQ_001": ["SELECT o_orderkey AS row_number, 'note' AS field, 'FW_REQ_001' AS issue_code FROM {r} WHERE note IS NULL"],
    "FW_VAL_001": ["SELECT o_orderkey, 'status', 'FW_VAL_001' FROM {r} WHERE status NOT IN ('F','O')"],
    "FW_FMT_001": ["SELECT o_orderkey, 'priority', 'FW_FMT_001' FROM {r} WHERE NOT regexp_full_match(priority, '[A-Za-z ]*')",
                   "SELECT o_orderkey, 'note', 'FW_FMT_001' FROM {r} WHERE note IS NOT NULL AND try_strptime(note, '%Y%m%d') IS NULL"],
}


def strict_sql(*codes):
    return union_all(*[q.replace("{r}", STRICT_ROWS_SQL) for c in codes for q in STRICT[c]])


@query("L05_strict_valid_values", "SELECT o_orderkey AS row_number, 'status' AS field, 'FW_VAL_001' AS issue_code FROM orders WHERE o_orderstatus NOT IN ('F','O')")
def _(t):
    return lay.strict_fixed_width(strict_rows(t), STRICT_LAYOUT[:1], "format", "o_orderkey").select("row_number", "field", "issue_code")


@query("L06_strict_fixed_width", strict_sql("FW_REQ_001", "FW_VAL_001", "FW_FMT_001"))
def _(t):
    return lay.strict_fixed_width(strict_rows(t), STRICT_LAYOUT, "all", "o_orderkey").select("row_number", "field", "issue_code")


@query("L06_strict_basic", strict_sql("FW_REQ_001"))
def _(t):
    return lay.strict_fixed_width(strict_rows(t), STRICT_LAYOUT, "basic", "o_orderkey").select("row_number", "field", "issue_code")


@query("L06_strict_summary", f"""SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(DISTINCT row_number) FROM ({strict_sql('FW_REQ_001', 'FW_VAL_001', 'FW_FMT_001')})) AS invalid_records,
 (SELECT count(*) FROM ({strict_sql('FW_FMT_001').replace("SELECT o_orderkey, 'priority', 'FW_FMT_001'", "SELECT o_orderkey", 1).replace("SELECT o_orderkey, 'note', 'FW_FMT_001'", "SELECT o_orderkey", 1)} UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F','O'))) AS format_errors""")
def _(t):
    return lay.strict_summary(strict_rows(t), STRICT_LAYOUT)


# Customer lines with some cut, some with wrong segments or blank names.
ALIGN_LAYOUT = [
    LayoutField("key", 1, 10, picture="9(10)"),
    LayoutField("name", 11, 20, required=True),
    LayoutField("nation", 31, 3, picture="9(2)"),
    LayoutField("segment", 34, 12, valid_values=("BUILDING", "MACHINERY", "HOUSEHOLD")),
]
ALIGN_SQL = """(SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN left(l, 40) WHEN c_custkey % 9 = 1 THEN l || 'XY' ELSE l END AS value FROM (
 SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 11 = 0 THEN 9 ELSE 10 END, '0') || CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END ||
  CASE WHEN c_custkey % 7 = 0 THEN repeat(' ', 20) ELSE rpad(c_name, 20, ' ') END || rpad(CAST(c_nationkey AS VARCHAR), 3, ' ') || rpad(c_mktsegment, 12, ' ') AS l FROM customer)) AS al"""


def align_lines(t):
    k = F.col("c_custkey")
    key = F.when(k % 11 == 0, F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit("x"))).otherwise(F.lpad(k.cast("string"), 10, "0"))
    line = F.concat(key, F.when(k % 7 == 0, " " * 20).otherwise(F.rpad("c_name", 20, " ")), F.rpad(F.col("c_nationkey").cast("string"), 3, " "), F.rpad("c_mktsegment", 12, " "))
    rows = t.customer.select(k.alias("_row"), line.alias("line"))
    value = F.when(F.col("_row") % 9 == 0, F.left("line", F.lit(40))).when(F.col("_row") % 9 == 1, F.concat("line", F.lit("XY"))).otherwise(F.col("line"))
    return rows.select("_row", value.alias("value"))


FIRST_BAD_SQL = f"""SELECT c_custkey AS row_number, CASE
  WHEN NOT regexp_full_match(trim(substring(value, 1, 10)), '[0-9]{{10}}') THEN 'invalid_format/key/1'
  WHEN trim(substring(value, 11, 20)) = '' THEN 'required_empty/name/11'
  WHEN NOT regexp_full_match(trim(substring(value, 31, 3)), '[0-9]{{2}}') THEN 'invalid_format/nation/31'
  WHEN length(substring(value, 34, 12)) < 12 THEN 'field_truncated/segment/34'
  WHEN trim(substring(value, 34, 12)) NOT IN ('BUILDING','MACHINERY','HOUSEHOLD') THEN 'invalid_value/segment/34'
  WHEN length(value) <> 45 THEN 'line_length_mismatch//45' END AS issue FROM {ALIGN_SQL}"""


@query("L07_first_misalignment", f"SELECT * FROM ({FIRST_BAD_SQL}) WHERE issue IS NOT NULL")
def _(t):
    found = lay.first_misalignment(align_lines(t), ALIGN_LAYOUT)
    return found.select("row_number", F.concat_ws("/", "reason", F.coalesce("field", F.lit("")), "offset").alias("issue"))


@query("L07_misalignment_summary", f"""WITH f AS ({FIRST_BAD_SQL}) SELECT (SELECT count(*) FROM {ALIGN_SQL}) AS total_lines,
 (SELECT count(*) FROM {ALIGN_SQL} WHERE length(value) = 45) AS correct_lines, (SELECT count(*) FROM {ALIGN_SQL} WHERE length(value) <> 45) AS incorrect_lines,
 CAST(45 AS BIGINT) AS expected_length, (SELECT count(issue) FROM f) AS misaligned_rows, (SELECT count(*) FROM f WHERE issue NOT LIKE 'line_length%') AS rows_with_field_errors""")
def _(t):
    return lay.misalignment_summary(align_lines(t), ALIGN_LAYOUT)


@query("L08_issue_code_summary", f"SELECT code AS issue_code, count(*) AS issues FROM ({ISSUES_SQL}) GROUP BY code")
def _(t):
    return lay.issue_code_summary(issues(t))


@query("L09_affected_summary", f"""SELECT count(DISTINCT row_number) AS total_affected_rows, round(count(DISTINCT row_number)::DOUBLE * 100.0 / (SELECT count(*) FROM customer), 2) AS affected_row_pct
 FROM ({ISSUES_SQL})""")
def _(t):
    return lay.affected_summary(issues(t), t.customer.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("L09_first_affected", f"""SELECT row_number, count(*) AS issue_count, string_agg(message, '; ' ORDER BY message) AS messages FROM ({ISSUES_SQL})
 GROUP BY row_number ORDER BY row_number LIMIT 100""")
def _(t):
    return lay.first_affected(issues(t)).withColumn("messages", F.array_join("messages", "; "))


@query("L09_worst_rows", f"""SELECT row_number, count(*) AS issue_count FROM ({ISSUES_SQL})
 GROUP BY row_number ORDER BY issue_count DESC, row_number LIMIT 20""")
def _(t):
    return lay.worst_rows(issues(t)).select("row_number", "issue_count")
