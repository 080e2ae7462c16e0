"""Queries for record types (M) and multi-record scans (S04, S05).

Orders are headers and line items are details of one batch per order key; the
declared totals are right except where ``o_orderkey % 50 = 0``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import record_types as rt
from tablewright.operators.record_types import RecordLayout, RecordType
from tablewright.operators.rules import FieldRule
from tablewright.plans.registry import query
from tablewright.plans.sqltext import union_all
from tablewright.session import scratch_folder, written_once
from tablewright.sources.layouts import LayoutField
from tablewright.sources.records import parse_all, scan_multi_record, scan_record_layouts

BATCH = ["batch"]

BATCHES_SQL = """
n AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(28,2))) AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey),
h AS (SELECT o_orderkey AS batch, CAST(coalesce(n, 0) + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS declared,
 CAST(coalesce(q, 0) + CASE WHEN o_orderkey % 50 = 1 THEN 0.25 ELSE 0 END AS VARCHAR) AS total, coalesce(flag, 'A') AS flag FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
d AS (SELECT l_orderkey AS batch, l_linenumber, CAST(l_quantity AS VARCHAR) AS amount, l_returnflag AS flag FROM lineitem),
x AS (SELECT batch, declared, total, flag FROM h WHERE batch % 20 <> 3)"""


def batches(t):
    """Header (row 0), details (rows 1..) and trailer (row 1000) per order."""
    sums = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(28,2)")).alias("q"), F.min("l_returnflag").alias("f"))
    k = F.col("o_orderkey")
    heads = t.orders.join(sums, k == F.col("l_orderkey"), "left").select(
        k.alias("batch"),
        (F.coalesce("n", F.lit(0)) + F.when(k % 50 == 0, 1).otherwise(0)).cast("string").alias("declared"),
        (F.coalesce("q", F.lit(0).cast("decimal(28,2)")) + F.when(k % 50 == 1, F.lit("0.25").cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)"))).cast("string").alias("total"),
        F.coalesce("f", F.lit("A")).alias("flag"),
    )
    nothing = F.lit(None).cast("string")

    def end_row(name, row, flag):
        return F.struct(F.lit(name).alias("_record_type"), row.cast("bigint").alias("_row"), "declared", "total", flag.alias("flag"), nothing.alias("amount"))

    header = end_row("header", F.lit(0), F.col("flag"))
    trailer = end_row("trailer", F.when(F.col("batch") % 30 == 7, -1).otherwise(1000), F.when(F.col("batch") % 25 == 0, "Z").otherwise(F.col("flag")))
    # Both ends of an order from one pass over its totals.
    ends = heads.select("batch", F.inline(F.when(F.col("batch") % 20 != 3, F.array(header, trailer)).otherwise(F.array(header))))
    detail = t.lineitem.select(
        F.col("l_orderkey").alias("batch"), F.lit("detail").alias("_record_type"), F.col("l_linenumber").cast("bigint").alias("_row"),
        nothing.alias("declared"), nothing.alias("total"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("string").alias("amount"))
    # Written once, as the records of a scanned file would be.
    return written_once(ends.unionByName(detail))


def shown(df):
    return df.select("batch", "rule_id", "row_number", "field", "value", "issue_code")


def shown_sql(check, row, field, value, source):
    return f"""SELECT batch, 'CT_{check}' AS rule_id, CAST({row} AS BIGINT) AS row_number, '{field}' AS field, {value} AS value,
 'CT_{check.upper().replace('_', '-')}' AS issue_code FROM {source}"""


EVENT_TYPES = [RecordType("clicks", "click"), RecordType("views", "view", expect="at_least_one"), RecordType("opening", position="first", expect="exactly_one"),
               RecordType("buys", "purchase", expect="exactly_one"), RecordType("refunds", "refund", expect="at_least_one")]
EVENT_KIND_SQL = """CASE WHEN event_id = (SELECT min(event_id) FROM events) THEN 'opening' WHEN event_type = 'click' THEN 'clicks' WHEN event_type = 'view' THEN 'views'
 WHEN event_type = 'purchase' THEN 'buys' WHEN event_type = 'refund' THEN 'refunds' END"""


def event_records(t):
    rows = t.events.select(F.col("event_id").alias("_row"), "event_type", "user_id", "value")
    return rt.classify_records(rows.drop("value"), EVENT_TYPES, F.col("event_type"))


@query("M01_classify_records", f"SELECT event_id AS _row, {EVENT_KIND_SQL} AS _record_type FROM events")
def _(t):
    return event_records(t).select("_row", "_record_type")


@query("M01_classify_by_batch", """SELECT event_id AS _row, user_id, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'head'
 WHEN event_id = max(event_id) OVER (PARTITION BY user_id) THEN 'tail' WHEN event_type = 'click' THEN 'clicks' END AS _record_type FROM events""")
def _(t):
    types = [RecordType("head", position="first"), RecordType("tail", position="last"), RecordType("clicks", "click")]
    rows = t.events.select(F.col("event_id").alias("_row"), "user_id", "event_type")
    return rt.classify_records(rows, types, F.col("event_type"), ["user_id"]).select("_row", "user_id", "_record_type")


@query("M02_unknown_records", f"""SELECT event_id AS row_number, event_type AS value, 'warning' AS severity, 'CT_UNKNOWN' AS issue_code FROM events WHERE {EVENT_KIND_SQL} IS NULL""")
def _(t):
    return rt.unknown_records(event_records(t), F.col("event_type")).select("row_number", "value", "severity", "issue_code")


@query("M03_expect_cardinality", f"""WITH k AS (SELECT {EVENT_KIND_SQL} AS kind FROM events),
c AS (SELECT count(*) FILTER (kind = 'views') AS v, count(*) FILTER (kind = 'opening') AS o, count(*) FILTER (kind = 'buys') AS b, count(*) FILTER (kind = 'refunds') AS r FROM k)
SELECT 'views' AS field, CAST(v AS VARCHAR) AS value, 'CT_EXPECT_AT_LEAST_ONE' AS issue_code FROM c WHERE v < 1
UNION ALL SELECT 'opening', CAST(o AS VARCHAR), 'CT_EXPECT_EXACTLY_ONE' FROM c WHERE o <> 1
UNION ALL SELECT 'buys', CAST(b AS VARCHAR), 'CT_EXPECT_EXACTLY_ONE' FROM c WHERE b <> 1
UNION ALL SELECT 'refunds', CAST(r AS VARCHAR), 'CT_EXPECT_AT_LEAST_ONE' FROM c WHERE r < 1""")
def _(t):
    return rt.expect_cardinality(event_records(t), EVENT_TYPES).select("field", "value", "issue_code")


@query("M03_expect_per_batch", """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS b, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id)
SELECT user_id, 'buys' AS field, CAST(b AS VARCHAR) AS value FROM c WHERE b <> 1 UNION ALL SELECT user_id, 'errors', CAST(e AS VARCHAR) FROM c WHERE e < 1""")
def _(t):
    types = [RecordType("buys", "purchase", expect="exactly_one"), RecordType("errors", "error", expect="at_least_one")]
    rows = rt.classify_records(t.events.select(F.col("event_id").alias("_row"), "user_id", "event_type"), types, F.col("event_type"))
    return rt.expect_cardinality(rows, types, ["user_id"]).select("user_id", "field", "value")


@query("M04_per_type_validation", """SELECT event_id AS row_number, 'clicks' AS _record_type, 'click_cap' AS rule_id FROM events WHERE event_type = 'click' AND NOT value < 20
UNION ALL SELECT event_id, 'views', 'view_user' FROM events WHERE event_type = 'view' AND NOT user_id >= 20""")
def _(t):
    types = [RecordType("clicks", "click"), RecordType("views", "view")]
    rows = t.events.select(F.col("event_id").alias("_row"), "event_type", "user_id", F.col("value").alias("amount"))
    records = rt.classify_records(rows, types, F.col("event_type"))
    per_type = {"clicks": ([], [FieldRule("click_cap", "amount", "<", value=20)]), "views": ([], [FieldRule("view_user", "user_id", ">=", value=20)])}
    return rt.validate_per_type(records, per_type).select("row_number", "_record_type", "rule_id")


@query("M05_required_companion", f"WITH {BATCHES_SQL} " + shown_sql("required_companion", "0", "trailer", "CAST(NULL AS VARCHAR)", "h WHERE batch NOT IN (SELECT batch FROM x)"))
def _(t):
    return shown(rt.required_companion(batches(t), "header", "trailer", BATCH))


@query("M05_required_companion_table", f"""WITH k AS (SELECT {EVENT_KIND_SQL} AS kind FROM events)
SELECT 'refunds' AS field FROM (SELECT count(*) FILTER (kind = 'views') AS a, count(*) FILTER (kind = 'refunds') AS b FROM k) WHERE a > 0 AND b = 0""")
def _(t):
    return rt.required_companion(event_records(t), "views", "refunds").select("field")


@query("M06_header_trailer_count", f"WITH {BATCHES_SQL} " + shown_sql(
    "header_trailer_count", "0", "declared", "declared", "h LEFT JOIN n ON l_orderkey = batch WHERE CAST(declared AS BIGINT) <> coalesce(n, 0)"))
def _(t):
    return shown(rt.header_trailer_count(batches(t), "header", "declared", "detail", BATCH))


@query("M07_header_trailer_sum", f"WITH {BATCHES_SQL} " + shown_sql(
    "header_trailer_sum", "0", "total", "total", "x LEFT JOIN n ON l_orderkey = batch WHERE abs(CAST(total AS DOUBLE) - coalesce(q, 0)::DOUBLE) > 1e-9"))
def _(t):
    return shown(rt.header_trailer_sum(batches(t), "trailer", "total", "detail", ["amount"], BATCH))


@query("M08_header_detail_consistent", f"WITH {BATCHES_SQL} " + shown_sql(
    "header_detail_consistent", "l_linenumber", "flag", "d_flag", "(SELECT d.batch, l_linenumber, d.flag AS d_flag FROM d JOIN h USING (batch) WHERE d.flag <> h.flag)"))
def _(t):
    return shown(rt.header_detail_consistent(batches(t), "flag", "flag", batch=BATCH))


@query("M09_header_trailer_match", f"WITH {BATCHES_SQL} " + shown_sql(
    "header_trailer_match", "0", "flag/flag", "flag || ' vs Z'", "x WHERE batch % 25 = 0"))
def _(t):
    return shown(rt.header_trailer_match(batches(t), "flag", "flag", batch=BATCH))


@query("M10_type_sequence", f"""WITH {BATCHES_SQL}, s AS (SELECT batch FROM x WHERE batch % 30 = 7)
{shown_sql('type_sequence', '0', 'record_type_sequence', "CASE WHEN batch IN (SELECT batch FROM d) THEN 'trailer,header,detail' ELSE 'trailer,header' END", 's')}""")
def _(t):
    return shown(rt.type_sequence(batches(t), ["header", "detail", "trailer"], BATCH))


@query("M10_type_sequence_table", """WITH f AS (SELECT event_type, min(event_id) AS first_at FROM events WHERE event_type IN ('click','error','purchase','view') GROUP BY event_type),
s AS (SELECT string_agg(event_type, ',' ORDER BY first_at) AS seen FROM f) SELECT seen AS value FROM s WHERE seen <> 'view,click,error,purchase'""")
def _(t):
    rows = t.events.select(F.col("event_id").alias("_row"), F.col("event_type").alias("_record_type"))
    return rt.type_sequence(rows, ["view", "click", "error", "purchase"]).select("value")


@query("M11_expect_count", f"""WITH {BATCHES_SQL}, c AS (SELECT batch, count(*) FILTER (k = 'd') AS n FROM (SELECT batch, 'h' AS k FROM h UNION ALL SELECT batch, 'd' FROM d) GROUP BY batch)
{shown_sql('expect_count', '0', 'row_count', 'CAST(n AS VARCHAR)', 'c WHERE n <> 4')}""")
def _(t):
    return shown(rt.expect_count(batches(t), "detail", 4, BATCH))


@query("M12_batch_scoped", f"""WITH {BATCHES_SQL} SELECT rule_id, count(*) AS violations FROM (
 {shown_sql("required_companion", "0", "trailer", "CAST(NULL AS VARCHAR)", "h WHERE batch NOT IN (SELECT batch FROM x)")}
 UNION ALL {shown_sql("header_trailer_count", "0", "declared", "declared", "h LEFT JOIN n ON l_orderkey = batch WHERE CAST(declared AS BIGINT) <> coalesce(n, 0)")}
 UNION ALL {shown_sql("header_trailer_match", "0", "flag/flag", "flag", "x WHERE batch % 25 = 0")}) GROUP BY rule_id""")
def _(t):
    b = batches(t)
    all_checks = (
        rt.required_companion(b, "header", "trailer", BATCH)
        .unionByName(rt.header_trailer_count(b, "header", "declared", "detail", BATCH))
        .unionByName(rt.header_trailer_match(b, "flag", "flag", batch=BATCH))
    )
    return all_checks.groupBy("rule_id").agg(F.count(F.lit(1)).alias("violations"))


RECORD_FILE = {
    "discriminator": {"position": 1, "length": 3},
    "record_types": {"header": {"match": "HEA", "expect": "exactly_one"}, "detail": {"match": "DET"}, "trailer": {"match": "TRA", "expect": "exactly_one"}},
    "cross_type_rules": [
        {"check": "required_companion", "when_type": "header", "requires_type": "trailer", "message": "a trailer is due", "severity": "warning"},
        {"check": "header_trailer_count", "record_type": "header", "trailer_field": "declared"},
        {"check": "header_trailer_sum", "record_type": "trailer", "trailer_field": "total", "count_of": "detail", "sum_of": ["amount"], "message": "totals are off"},
        {"check": "header_trailer_match", "header_field": "flag", "trailer_field": "flag", "severity": "info"},
        {"check": "expect_count", "record_type": "detail", "exactly": 4, "message": "four lines are due"},
    ],
}


@query("M13_rules_from_file", f"""WITH {BATCHES_SQL}, c AS (SELECT h.batch, coalesce(n, 0) AS n FROM h LEFT JOIN n ON l_orderkey = h.batch)
SELECT batch, 'CT_required_companion' AS rule_id, 'warning' AS severity, CAST(NULL AS VARCHAR) AS value, 'a trailer is due' AS message FROM h WHERE batch NOT IN (SELECT batch FROM x)
UNION ALL SELECT batch, 'CT_header_trailer_count', 'error', declared, 'header.declared counts ' || declared || ', detail rows there: ' || coalesce(n, 0)
 FROM h LEFT JOIN n ON l_orderkey = batch WHERE CAST(declared AS BIGINT) <> coalesce(n, 0)
UNION ALL SELECT batch, 'CT_header_trailer_sum', 'error', total, 'totals are off' FROM x LEFT JOIN n ON l_orderkey = batch WHERE CAST(total AS DECIMAL(28,2)) <> coalesce(q, 0)
UNION ALL SELECT batch, 'CT_header_trailer_match', 'info', flag || ' vs Z', 'header flag is ' || flag || ', trailer flag is Z' FROM x WHERE batch % 25 = 0
UNION ALL SELECT batch, 'CT_expect_count', 'error', CAST(n AS VARCHAR), 'four lines are due' FROM c WHERE n <> 4""")
def _(t):
    types, disc = rt.record_types_from_dict(RECORD_FILE)
    lines = batches(t).withColumn("value", F.concat(F.upper(F.substring("_record_type", 1, 3)), F.lit(" "), F.col("batch").cast("string"))).drop("_record_type")
    records = rt.classify_records(lines, types, disc, BATCH)
    return rt.check_across_types(records, RECORD_FILE["cross_type_rules"], BATCH).select("batch", "rule_id", "severity", "value", "message")


# ---------------------------------------------------------- multi-record files
@query("S04_scan_multi_record", union_all(
    "SELECT 'detail' AS _record_type, CAST(l_linenumber AS VARCHAR) AS line, CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY ALL",
    "SELECT 'header', CAST(NULL AS VARCHAR), CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY ALL"))
def _(t):
    folder = scratch_folder(t.spark, "records")
    heads = t.orders.select(F.concat(F.lit("HDR"), F.lpad(F.col("o_orderkey").cast("string"), 12, " ")).alias("value"))
    details = t.lineitem.select(F.concat(F.lit("DTL"), F.lpad(F.col("l_orderkey").cast("string"), 12, " "), F.lpad(F.col("l_linenumber").cast("string"), 3, " ")).alias("value"))
    heads.unionByName(details).write.text(folder)
    lines = scan_multi_record(t.spark, folder, [RecordType("header", "HDR"), RecordType("detail", "DTL")], 1, 3)
    fields = parse_all(lines, {"header": [LayoutField("id", 4, 12)], "detail": [LayoutField("id", 4, 12), LayoutField("line", 16, 3)]})
    return fields.groupBy("_record_type", "line", "id").agg(F.count(F.lit(1)).alias("n"))


LAYOUTS = [RecordLayout("priced", discriminator=(1, 1, "P")), RecordLayout("also_priced", discriminator=(2, 1, "P")), RecordLayout("short", length=6),
           RecordLayout("rest", default=True)]


@query("S05_scan_v2_layouts", """WITH l AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'P' || p_name WHEN p_partkey % 4 = 1 THEN 'PP' || p_name WHEN p_partkey % 4 = 2 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0')
  ELSE '?' || p_name || '?' END AS value FROM part)
SELECT CASE WHEN value LIKE 'PP%' THEN NULL WHEN value LIKE 'P%' THEN 'priced' WHEN value LIKE '_P%' THEN 'also_priced' WHEN length(value) = 6 THEN 'short' ELSE 'rest' END AS _record_type,
 CASE WHEN value LIKE 'PP%' THEN 'priced,also_priced' END AS _ambiguous, count(*) AS n FROM l GROUP BY ALL""")
def _(t):
    folder = scratch_folder(t.spark, "layouts")
    k = F.col("p_partkey")
    value = (
        F.when(k % 4 == 0, F.concat(F.lit("P"), "p_name")).when(k % 4 == 1, F.concat(F.lit("PP"), "p_name"))
        .when(k % 4 == 2, F.lpad(k.cast("string"), 6, "0")).otherwise(F.concat(F.lit("?"), "p_name", F.lit("?")))
    )
    t.part.select(value).write.text(folder)
    return scan_record_layouts(t.spark, folder, LAYOUTS).groupBy("_record_type", "_ambiguous").agg(F.count(F.lit(1)).alias("n"))
