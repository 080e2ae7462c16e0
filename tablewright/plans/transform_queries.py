"""Queries for mappings (P), transforms (T), masking (K) and expected-vs-actual (C12, C13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import cleanup, masking
from tablewright.functions import transforms as tf
from tablewright.operators import compare
from tablewright.operators.mapping import (
    FieldMapping,
    Mapping,
    Target,
    apply_mapping,
    map_columns,
    mask_columns,
    mask_delimited,
    mask_fixed_width,
    transform_by_record_type,
    transform_rows,
)
from tablewright.operators.rules import FieldRule, GroupRule, validate
from tablewright.operators.violations import redact_issues
from tablewright.plans.file_queries import CUSTOMER_LAYOUT
from tablewright.plans.registry import query
from tablewright.session import scratch_folder
from tablewright.sources import layouts
from tablewright.sources.rows import number_rows


def column_query(name, table, key, sql_expr, build):
    """One transformed column next to its key."""

    @query(name, f"SELECT {key}, {sql_expr} AS result FROM {table}")
    def _(t, table=table, key=key, build=build):
        return getattr(t, table).select(key, build().alias("result"))


@query("P01_map_columns", "SELECT c_custkey AS customer_id, c_name AS full_name, c_acctbal AS balance FROM customer")
def _(t):
    m = Mapping("customer", (FieldMapping("c_custkey", "customer_id"), FieldMapping("c_name", "full_name"), FieldMapping("c_acctbal", "balance")))
    return map_columns(t.customer, m)


column_query("P03_trim", "part", "p_partkey", "trim('  ' || p_name || ' ')", lambda: cleanup.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))))
column_query("P04_upper", "part", "p_partkey", "upper(p_name)", lambda: cleanup.upper(F.col("p_name")))
column_query("P05_lower", "part", "p_partkey", "lower(p_brand)", lambda: cleanup.lower(F.col("p_brand")))
column_query("P06_substring", "part", "p_partkey", "substring(p_name, 3, 4)", lambda: cleanup.substring(F.col("p_name"), 2, 4))
column_query("P06_substring_open", "part", "p_partkey", "substring(p_name, 3)", lambda: cleanup.substring(F.col("p_name"), 2))
column_query("P07_replace", "customer", "c_custkey", "replace(c_name, '#0', '-')", lambda: cleanup.replace(F.col("c_name"), "#0", "-"))
column_query("P08_cast_number", "events", "event_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END",
             lambda: cleanup.cast_number(F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.regexp_extract("props", "([0-9]+)", 1))))
column_query("P09_cast_date", "orders", "o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END",
             lambda: F.date_format(cleanup.cast_date(F.when(F.col("o_orderkey") % 5 == 0, "2020-13-45").otherwise(F.date_format("o_orderdate", "yyyyMMdd")), "yyyyMMdd"), "yyyy-MM-dd"))
column_query("P10_cast_string", "orders", "o_orderkey", "CAST(o_totalprice AS VARCHAR)", lambda: cleanup.cast_string(F.col("o_totalprice")))


@query("P11_apply_mapping", """SELECT c_custkey AS id, upper(trim(c_mktsegment)) AS segment, replace(substring(c_name, 1, 12), 'Customer', 'Cust') AS short_name,
 try_cast(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS balance FROM customer""")
def _(t):
    m = Mapping("customer", (
        FieldMapping("c_custkey", "id"),
        FieldMapping("c_mktsegment", "segment", steps=(("trim", {}), ("upper", {}))),
        FieldMapping("c_name", "short_name", steps=(("substring", {"start": 0, "length": 12}), ("replace", {"old": "Customer", "new": "Cust"}))),
        FieldMapping("c_acctbal", "balance", steps=(("cast", {"to_type": "string"}), ("cast", {"to_type": "number"}))),
    ))
    return apply_mapping(t.customer, m)


column_query("P12_fill_default", "orders", "o_orderkey", "CASE WHEN o_orderkey % 4 < 2 THEN 'NONE' ELSE o_orderpriority END",
             lambda: cleanup.fill_default(F.when(F.col("o_orderkey") % 4 == 0, "  ").when(F.col("o_orderkey") % 4 != 1, F.col("o_orderpriority")), "NONE"))

# --------------------------------------------------------------- transforms
column_query("T01_noop", "part", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END", lambda: tf.noop(F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))))
column_query("T02_default", "orders", "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'FB' ELSE o_orderstatus END",
             lambda: tf.default(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")), "FB"))
column_query("T03_blank", "supplier", "s_suppkey", "'AB0000'", lambda: tf.blank(6, "0", "AB"))
column_query("T03_blank_spaces", "supplier", "s_suppkey", "'    '", lambda: tf.blank(4))
column_query("T04_constant", "supplier", "s_suppkey", "'000'", lambda: tf.constant("000"))
column_query("T05_concat", "lineitem", "l_orderkey",
             "CASE WHEN length(CAST(l_orderkey AS VARCHAR)) >= 4 THEN CAST(l_orderkey AS VARCHAR) ELSE lpad(CAST(l_orderkey AS VARCHAR), 4, '0') END || l_returnflag || CAST(l_linenumber AS VARCHAR)",
             lambda: tf.concat((F.col("l_orderkey"), 4, "0"), F.col("l_returnflag"), F.col("l_linenumber")))
column_query("T06_field_map", "supplier", "s_suppkey", "s_name", lambda: tf.field_map("s_name"))


@query("T07_sequential", """SELECT c_custkey, CASE WHEN length(CAST(1000 + 5 * (rn - 1) AS VARCHAR)) >= 6 THEN CAST(1000 + 5 * (rn - 1) AS VARCHAR)
 ELSE lpad(CAST(1000 + 5 * (rn - 1) AS VARCHAR), 6, '0') END AS result FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer)""")
def _(t):
    rows = number_rows(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"])
    return rows.select("c_custkey", tf.pad_left((F.lit(1000) + F.lit(5) * (F.col("_row") - 1)).cast("string"), 6, "0").alias("result"))


ROUNDED = "CAST(round_even(c_acctbal * 100, 0) AS BIGINT)"
column_query("T08_numeric_format", "customer", "c_custkey",
             f"CASE WHEN {ROUNDED} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({ROUNDED}) AS VARCHAR), 11, '0')",
             lambda: tf.numeric_format(F.col("c_acctbal"), 12, signed=True, decimals=2))
column_query("T08_numeric_format_half", "customer", "c_custkey",
             "CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE lpad(CAST(CAST(round_even(c_custkey + 0.5::DOUBLE, 0) AS BIGINT) AS VARCHAR), 8, '0') END",
             lambda: tf.numeric_format(F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise((F.col("c_custkey") + F.lit(0.5)).cast("string")), 8, default_value="0"))
column_query("T09_date_format", "orders", "o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN '00000000' ELSE strftime(o_orderdate, '%m/%d/%Y') END",
             lambda: tf.date_format(F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyyMMdd")), "yyyyMMdd", "MM/dd/yyyy", "00000000"))
column_query("T09_date_preset", "orders", "o_orderkey", "strftime(o_orderdate, '%Y%m%d')", lambda: tf.date_preset(F.date_format("o_orderdate", "yyyy-MM-dd"), "CCYYMMDD"))
column_query("T10_scale", "lineitem", "l_orderkey", "CAST(CAST(round_even(l_quantity * 0.25::DOUBLE, 1) AS DECIMAL(38,1)) AS VARCHAR)", lambda: tf.scale(F.col("l_quantity"), 0.25, 1))
column_query("T11_pad", "part", "p_partkey", "CASE WHEN length(p_name) >= 10 THEN p_name ELSE lpad(p_name, 10, '*') END", lambda: tf.pad(F.col("p_name"), 10, "*", "left"))
column_query("T12_truncate", "part", "p_partkey", "left(p_name, 4) || right(p_name, 3)", lambda: F.concat(tf.truncate(F.col("p_name"), 4), tf.truncate(F.col("p_name"), 3, True)))
column_query("T13_conditional", "orders", "o_orderkey",
             "CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'rush' ELSE o_orderpriority END",
             lambda: tf.conditional(tf.cond_eq(F.col("o_orderstatus"), "F"), tf.constant("done"),
                                    tf.conditional(tf.cond_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH "]), tf.constant("rush"), tf.field_map("o_orderpriority"))))
column_query("T14_cond_null", "orders", "o_orderkey", "o_orderkey % 3 = 0 OR o_orderkey % 3 = 1", lambda: tf.cond_null(F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 3 == 2, "x")))
column_query("T14_cond_not_null", "orders", "o_orderkey", "o_orderkey % 3 = 2", lambda: tf.cond_null(F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 3 == 2, "x"), True))
column_query("T15_cond_eq", "orders", "o_orderkey", "o_orderstatus <> 'F'", lambda: tf.cond_eq(F.concat("o_orderstatus", F.lit(" ")), "F", True))
column_query("T16_cond_in", "orders", "o_orderkey", "o_orderstatus NOT IN ('F','P')", lambda: tf.cond_in(F.col("o_orderstatus"), ["F", " P"], True))
column_query("T17_fit", "part", "p_partkey", "rpad(left(p_name, 9), 9, ' ')", lambda: tf.fit(F.col("p_name"), 9))

CUSTOMER_TARGETS = [
    Target("id", lambda: tf.pad_left(F.col("c_custkey"), 10, "0"), 10),
    Target("name", lambda: F.col("c_name"), 20),
    Target("balance", lambda: tf.numeric_format(F.col("c_acctbal"), 12, True, 2), 12),
    Target("segment", lambda: tf.conditional(tf.cond_eq(F.col("c_mktsegment"), "BUILDING"), tf.constant("BLD"), tf.field_map("c_mktsegment")), 5),
]
CUSTOMER_TARGET_SQL = f"""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS id, rpad(left(c_name, 20), 20, ' ') AS name,
 CASE WHEN {ROUNDED} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({ROUNDED}) AS VARCHAR), 11, '0') AS balance,
 rpad(left(CASE WHEN c_mktsegment = 'BUILDING' THEN 'BLD' ELSE c_mktsegment END, 5), 5, ' ') AS segment FROM customer"""


@query("T18_transform_row", CUSTOMER_TARGET_SQL)
def _(t):
    return transform_rows(t.customer, CUSTOMER_TARGETS, keep=["c_custkey"])


@query("T19_transform_by_record_type", """SELECT CASE WHEN event_type IN ('click','view') THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id,
 CASE WHEN event_type IN ('click','view') THEN NULL ELSE event_type END AS event_type,
 CASE event_type WHEN 'click' THEN 'C' || CAST(event_id AS VARCHAR) WHEN 'view' THEN lpad(CAST(user_id AS VARCHAR), 6, '0') END AS code,
 CASE event_type WHEN 'click' THEN rpad(CAST(user_id AS VARCHAR), 8, ' ') END AS who,
 CASE WHEN event_type IN ('click','view') THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
 CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' ELSE 'UNKNOWN' END AS _record_type FROM events""")
def _(t):
    return transform_by_record_type(
        t.events.select("event_id", "event_type", "user_id"), "event_type",
        {
            "click": ("clicks", [Target("code", lambda: tf.concat(F.lit("C"), F.col("event_id"))), Target("who", lambda: F.col("user_id"), 8)]),
            "view": ("views", [Target("code", lambda: tf.pad_left(F.col("user_id"), 6, "0"))]),
        },
    )


@query("T20_staging_transform", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS acct_num, c_mktsegment AS status_code, strftime(o_orderdate, '%Y%m%d') AS open_date,
 CASE WHEN o_totalprice IS NULL THEN lpad('0', 18, '0') ELSE lpad(CAST(CAST(round_even(o_totalprice, 0) AS BIGINT) AS VARCHAR), 18, '0') END AS total_due
FROM customer LEFT JOIN (SELECT o_custkey + 5 AS k, * FROM orders) o ON c_custkey = k""")
def _(t):
    # Shifted keys leave the first customers without a balance.
    balances = t.orders.select((F.col("o_custkey") + 5).alias("k"), "o_orderdate", "o_totalprice")
    rows = t.customer.join(balances, F.col("c_custkey") == F.col("k"), "left")
    return rows.select(
        tf.pad_left(F.col("c_custkey"), 16, "0").alias("acct_num"),
        F.col("c_mktsegment").alias("status_code"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("open_date"),
        tf.numeric_format(F.coalesce(F.col("o_totalprice"), F.lit(0.0)), 18).alias("total_due"),
    )


# ------------------------------------------------------- expected vs actual
def delivered(t):
    """The 'file': transformed customers with some wrong and some missing."""
    k = F.col("c_custkey")
    out = transform_rows(t.customer, CUSTOMER_TARGETS, keep=["c_custkey"])
    return out.filter(k % 50 != 7).withColumn("segment", F.when(k % 20 == 0, "WRONG").otherwise(F.col("segment")))


FILE_SQL = f"WITH e AS ({CUSTOMER_TARGET_SQL}), f AS (SELECT c_custkey, id, name, balance, CASE WHEN c_custkey % 20 = 0 THEN 'WRONG' ELSE segment END AS segment FROM e WHERE c_custkey % 50 <> 7)"


@query("C12_compare_db_to_file", f"""{FILE_SQL}, s AS (
SELECT (SELECT count(*) FROM e) AS total_rows_left, (SELECT count(*) FROM e ANTI JOIN f USING (c_custkey)) AS only_in_left, (SELECT count(*) FROM f ANTI JOIN e USING (c_custkey)) AS only_in_right,
 (SELECT count(*) FROM e JOIN f USING (c_custkey) WHERE e.segment <> f.segment) AS rows_with_differences)
SELECT *, CASE WHEN only_in_left + only_in_right + rows_with_differences = 0 THEN 'passed' ELSE 'failed' END AS status FROM s""")
def _(t):
    expected = transform_rows(t.customer, CUSTOMER_TARGETS, keep=["c_custkey"])
    s = compare.compare_status(compare.compare_summary(expected, delivered(t), ["c_custkey"]))
    return s.select("total_rows_left", "only_in_left", "only_in_right", "rows_with_differences", "status")


def mismatch(t):
    return compare.transform_mismatch(t.customer, CUSTOMER_TARGETS, delivered(t), ["c_custkey"], {"segment": "c_mktsegment", "name": "c_name"})


@query("C13_transform_mismatch", f"""{FILE_SQL}
SELECT c_custkey, field, source_value, transformed_value, file_value, file_value IS NOT NULL AND file_value = transformed_value AS match FROM (
 SELECT c.c_custkey, 'segment' AS field, c.c_mktsegment AS source_value, e.segment AS transformed_value, f.segment AS file_value
 FROM customer c JOIN e USING (c_custkey) LEFT JOIN f USING (c_custkey)
 UNION ALL SELECT c.c_custkey, 'name', c.c_name, e.name, f.name FROM customer c JOIN e USING (c_custkey) LEFT JOIN f USING (c_custkey))""")
def _(t):
    return mismatch(t)


@query("C13_mismatch_totals", f"""{FILE_SQL}, m AS (SELECT 'segment' AS field, coalesce(f.segment = e.segment, false) AS ok FROM e LEFT JOIN f USING (c_custkey)
 UNION ALL SELECT 'name', coalesce(f.name = e.name, false) FROM e LEFT JOIN f USING (c_custkey))
SELECT field, count(*) AS total, count(*) FILTER (ok) AS matched, count(*) FILTER (NOT ok) AS mismatched, round(count(*) FILTER (ok)::DOUBLE * 100.0 / count(*), 2) AS match_pct FROM m GROUP BY field""")
def _(t):
    return compare.mismatch_totals(mismatch(t))


# ------------------------------------------------------------------ masking
@query("K01_preserve", "SELECT c_custkey, c_name FROM customer")
def _(t):
    return mask_columns(t.customer.select("c_custkey", "c_name"), {"c_name": {"strategy": "preserve"}})


# The letters that are drawn can not be said in SQL; their shape and that equal values stay equal can.
EQUAL_STAYS_EQUAL = """(SELECT count(*) FROM (SELECT {value} FROM customer GROUP BY {value})) AS distinct_values, CAST(1 AS BIGINT) AS results_per_value"""


def results_per_value(rows):
    """Number of distinct inputs, and of results that the busiest of them has."""
    return rows.groupBy("value").agg(F.count_distinct("result").alias("n")).agg(F.count(F.lit(1)).alias("distinct_values"), F.max("n").alias("results_per_value"))


@query("K02_preserve_format", """SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape FROM customer""")
def _(t):
    masked = mask_columns(t.customer.select("c_custkey", "c_name"), {"c_name": {"strategy": "preserve_format"}}, seed=7)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("c_name", "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")
    return masked.select("c_custkey", shape.alias("shape"))


@query("K02_preserve_format_repeats", f"SELECT {EQUAL_STAYS_EQUAL.format(value='c_mktsegment')}")
def _(t):
    return results_per_value(t.customer.select(F.col("c_mktsegment").alias("value"), masking.preserve_format(F.col("c_mktsegment"), 7).alias("result")))


column_query("K03_deterministic_hash", "customer", "c_custkey", "left(repeat(upper(sha256(c_name)), 2), 70)", lambda: masking.deterministic_hash(F.col("c_name"), 70))
column_query("K03_hash_same_length", "customer", "c_custkey", "left(upper(sha256(c_name)), length(c_name))", lambda: masking.deterministic_hash(F.col("c_name")))


@query("K04_random_range", "SELECT c_custkey, true AS in_range, true AS whole FROM customer")
def _(t):
    masked = mask_columns(t.customer.select("c_custkey", "c_name"), {"c_name": {"strategy": "random_range", "min": 10, "max": 99}}, seed=3)
    return masked.select("c_custkey", F.col("c_name").cast("bigint").between(10, 99).alias("in_range"), F.col("c_name").rlike("^[0-9]+$").alias("whole"))


@query("K04_random_range_repeats", f"SELECT {EQUAL_STAYS_EQUAL.format(value='c_mktsegment')}")
def _(t):
    return results_per_value(t.customer.select(F.col("c_mktsegment").alias("value"), masking.random_range(F.col("c_mktsegment"), 10, 99, seed=3).alias("result")))


column_query("K05_redact", "customer", "c_custkey", "repeat(' ', length(c_name))", lambda: masking.redact(F.col("c_name")))
column_query("K05_redact_delimited", "customer", "c_custkey", "''", lambda: masking.redact(F.col("c_name"), fixed_width=False))


@query("K06_fake_name", "SELECT c_custkey, true AS known FROM customer")
def _(t):
    # Replacement names are the caller's: here those of the nations.
    names = [r.n_name for r in t.nation.select("n_name").distinct().orderBy("n_name").collect()]
    masked = mask_columns(t.customer.select("c_custkey", "c_name"), {"c_name": {"strategy": "fake_name", "names": names}}, seed=3)
    return masked.join(t.nation.select(F.col("n_name").alias("c_name"), F.lit(True).alias("hit")).distinct(), "c_name", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("known"))


@query("K06_fake_name_repeats", f"SELECT {EQUAL_STAYS_EQUAL.format(value='c_mktsegment')}")
def _(t):
    return results_per_value(t.customer.select(F.col("c_mktsegment").alias("value"), masking.fake_name(F.col("c_mktsegment"), ["NORTH", "SOUTH", "EAST"], seed=3).alias("result")))


# Files of customers, masked as they are: every line keeps its length or its number of fields.
MASK_SPEC = {"c_name": {"strategy": "redact"}, "c_acctbal": {"strategy": "deterministic_hash"}}


@query("K07_mask_fixed_width", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 57 AS length, repeat(' ', 20) AS name,
 left(upper(sha256(rpad(left(CAST(c_acctbal AS VARCHAR), 12), 12, ' '))), 12) AS balance, rpad(left(c_mktsegment, 12), 12, ' ') AS segment FROM customer""")
def _(t):
    folder = scratch_folder(t.spark, "mask")
    layouts.write_fixed_width(t.customer, CUSTOMER_LAYOUT, f"{folder}/in")
    mask_fixed_width(t.spark.read.text(f"{folder}/in"), CUSTOMER_LAYOUT, MASK_SPEC).write.text(f"{folder}/out")
    v = F.col("value")
    return t.spark.read.text(f"{folder}/out").select(
        F.rtrim(F.substring(v, 1, 10)).alias("c_custkey"), F.char_length(v).alias("length"), F.substring(v, 11, 20).alias("name"),
        F.substring(v, 34, 12).alias("balance"), F.substring(v, 46, 12).alias("segment"),
    )


@query("K08_mask_delimited", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 4 AS fields, '' AS name,
 left(upper(sha256(CAST(c_acctbal AS VARCHAR))), length(CAST(c_acctbal AS VARCHAR))) AS balance, c_mktsegment AS segment FROM customer""")
def _(t):
    folder = scratch_folder(t.spark, "mask")
    rows = t.customer.select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"), "c_mktsegment").alias("value"))
    rows.write.text(f"{folder}/in")
    mask_delimited(t.spark.read.text(f"{folder}/in"), ["c_custkey", "c_name", "c_acctbal"], MASK_SPEC).write.text(f"{folder}/out")
    cells = F.split("value", r"\|", -1)
    return t.spark.read.text(f"{folder}/out").select(cells[0].alias("c_custkey"), F.size(cells).alias("fields"), cells[1].alias("name"), cells[2].alias("balance"), cells[3].alias("segment"))


@query("K09_redact_messages", """SELECT CAST(c_custkey AS BIGINT) AS row_number, 'acct_positive: c_acctbal = [REDACTED]' AS message, '[REDACTED]' AS value FROM customer WHERE NOT c_acctbal > 0
 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'one_phone: c_nationkey = [REDACTED]', '[REDACTED]' FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'same_segment: c_mktsegment = [REDACTED]', '[REDACTED]' FROM customer
  WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING min(c_mktsegment) <> max(c_mktsegment))""")
def _(t):
    rules = [
        FieldRule("acct_positive", "c_acctbal", ">", value=0), GroupRule("one_phone", "unique", ("c_nationkey",)),
        GroupRule("same_segment", "consistent", ("c_nationkey",), target="c_mktsegment"),
    ]
    return redact_issues(validate(t.customer, rules, "c_custkey")).select("row_number", "message", "value")
