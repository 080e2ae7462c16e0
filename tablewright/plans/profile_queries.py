"""Queries for profiles and quality metrics (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import profile
from tablewright.operators.rules import FieldRule, validate
from tablewright.plans.registry import query
from tablewright.plans.rule_queries import CUSTOMER_TEXT_SQL, customer_text
from tablewright.plans.sqltext import union_all

LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_returnflag"]
# A projection with nulls and repeats, the same in both engines.
LINE_VIEW_SQL = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag FROM lineitem)"""


def line_view(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("flag"))


def quality_sql(source: str, columns: list[str]) -> str:
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    w = len(columns)
    return f"""
WITH m AS (SELECT count(*) AS n, {nulls} AS nulls FROM {source} s),
u AS (SELECT count(*) AS uniq FROM (SELECT DISTINCT * FROM {source} s))
SELECT n AS total_rows, CAST({w} AS BIGINT) AS total_columns, n * {w} AS total_cells, n * {w} - nulls AS filled_cells, nulls AS null_cells,
  round(((n * {w} - nulls) * 100.0 / (n * {w}))::DOUBLE, 2) AS completeness_pct, uniq AS unique_rows, n - uniq AS duplicate_rows,
  round((uniq * 100.0 / n)::DOUBLE, 2) AS uniqueness_pct,
  round(((n * {w} - nulls) * 100.0 / (n * {w}))::DOUBLE * 0.6 + (uniq * 100.0 / n)::DOUBLE * 0.4, 2) AS quality_score
FROM m, u"""


@query("Q01_quality_metrics_customer", quality_sql(CUSTOMER_TEXT_SQL.replace(" AS ct", ""), ["c_custkey", "c_nationkey", "c_name", "code"]))
def _(t):
    return profile.quality_metrics(customer_text(t))


@query("Q01_quality_metrics_lineitem", quality_sql(LINE_VIEW_SQL, ["l_orderkey", "l_linenumber", "flag"]))
def _(t):
    return profile.quality_metrics(line_view(t))


def column_profile_sql(source: str, columns: list[str]) -> str:
    return union_all(*[f"""
SELECT '{c}' AS column_name, count(*) AS total_values, count(*) - count({c}) AS null_count, count({c}) AS filled_count,
  round(count({c})::DOUBLE * 100.0 / count(*), 2) AS fill_rate_pct, count(DISTINCT {c}) AS unique_count,
  round(count(DISTINCT {c})::DOUBLE * 100.0 / count({c}), 2) AS unique_ratio_pct FROM {source}""" for c in columns])


@query("Q02_column_profile_customer", column_profile_sql(CUSTOMER_TEXT_SQL, ["c_custkey", "c_nationkey", "c_name", "code"]))
def _(t):
    return profile.column_profile(customer_text(t))


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]


@query("Q02_column_profile_lineitem", column_profile_sql("lineitem", LINEITEM))
def _(t):
    return profile.column_profile(t.lineitem)


@query("Q02_sample_values", union_all(*[
    f"SELECT * FROM (SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM customer ORDER BY value LIMIT 5)"
    for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]]))
def _(t):
    return profile.sample_values(t.customer)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("Q03_numeric_profile", union_all(*[f"""
SELECT '{c}' AS column_name, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
  round(stddev_samp({c}), 4) AS std_dev FROM lineitem""" for c in NUMERIC]))
def _(t):
    return profile.numeric_profile(t.lineitem, NUMERIC).withColumn("median", F.round("median", 4))


@query("Q04_string_profile", union_all(*[f"""
SELECT '{c}' AS column_name, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 2) AS avg_length
FROM documents""" for c in ["text", "lang", "source"]]))
def _(t):
    return profile.string_profile(t.documents, ["text", "lang", "source"])


ORDER_TEXT_SQL = """(SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderstatus,
 strftime(o_orderdate, '%Y%m%d') AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS shipped, strftime(o_orderdate, '%Y%m%d') AS plain_digits,
 CASE WHEN o_orderkey % 10 < 4 THEN 'soon' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS due_date, CAST(NULL AS VARCHAR) AS note FROM orders)"""


def order_text(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderstatus",
        F.date_format(d, "yyyyMMdd").alias("o_orderdate"), F.date_format(d, "yyyy-MM-dd").alias("shipped"),
        F.date_format(d, "yyyyMMdd").alias("plain_digits"),
        F.when(F.col("o_orderkey") % 10 < 4, "soon").otherwise(F.date_format(d, "MM/dd/yyyy")).alias("due_date"),
        F.lit(None).cast("string").alias("note"),
    )


def infer_sql(c: str) -> str:
    eight = f"(regexp_matches({c}, '^[0-9]{{8}}$') AND try_strptime({c}, '%Y%m%d') IS NOT NULL)"
    iso = f"(try_strptime({c}, '%Y-%m-%d') IS NOT NULL OR try_strptime({c}, '%m/%d/%Y') IS NOT NULL)"
    num = f"(try_cast({c} AS DOUBLE) IS NOT NULL)"
    dated = "true" if "date" in c else "false"
    return f"""SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'empty'
 WHEN {dated} AND (avg(CAST({eight} AS INT)) >= 0.8 OR avg(CAST({eight} OR {iso} AS INT)) >= 0.5) THEN 'datetime'
 WHEN bool_and({num}) THEN 'numeric' WHEN NOT {dated} AND bool_and({iso}) THEN 'datetime' ELSE 'string' END AS inferred_type
 FROM {ORDER_TEXT_SQL}"""


ORDER_TEXT = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "shipped", "plain_digits", "due_date", "note"]


@query("Q05_infer_column_type", union_all(*[infer_sql(c) for c in ORDER_TEXT]))
def _(t):
    return profile.infer_column_types(profile.long_values(order_text(t)))


def date_profile_sql(label: str, expr: str, source: str, as_of: str) -> str:
    def share(x):
        return f"round(({x})::DOUBLE * 100.0 / n, 2)"

    return f"""
SELECT '{label}' AS column_name, strftime(lo, '%Y-%m-%d %H:%M:%S') AS earliest_date, strftime(hi, '%Y-%m-%d %H:%M:%S') AS latest_date,
  CAST(floor((epoch_us(hi) - epoch_us(lo)) / 86400000000.0) AS BIGINT) AS date_range_days,
  ok AS valid_date_count, {share('ok')} AS valid_date_pct, n - ok AS invalid_date_count, {share('n - ok')} AS invalid_date_pct,
  fu AS future_date_count, {share('fu')} AS future_date_pct, nu AS null_date_count, {share('nu')} AS null_date_pct
FROM (SELECT min(d) AS lo, max(d) AS hi, count(d) AS ok, count(*) FILTER (d > TIMESTAMP '{as_of}') AS fu,
  count(*) FILTER (raw IS NULL) AS nu, count(*) AS n FROM (SELECT {expr} AS d, {label} AS raw FROM {source})) WHERE ok * 2 >= n"""


@query("Q06_date_profile_events", date_profile_sql("ts", "ts", "events", "2024-01-20 00:00:00"))
def _(t):
    return profile.date_profile(t.events, ["ts"], "2024-01-20 00:00:00")


@query("Q06_date_profile_orders", date_profile_sql("odate", "try_strptime(odate, '%Y%m%d')", """(SELECT CASE WHEN o_orderkey % 11 = 0
  THEN strftime(o_orderdate, '%Y') || '1340' WHEN o_orderkey % 11 = 1 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END AS odate
  FROM orders)""", "2000-01-01 00:00:00"))
def _(t):
    m = F.col("o_orderkey") % 11
    rows = t.orders.select(
        F.when(m == 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("1340")))
        .when(m != 1, F.date_format("o_orderdate", "yyyyMMdd")).alias("odate"),
        "o_orderstatus",
    )
    return profile.date_profile(rows, ["odate", "o_orderstatus"], "2000-01-01 00:00:00", {"odate": "yyyyMMdd", "o_orderstatus": "yyyyMMdd"})


FORMATS_SQL = """(SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%Y%m%d') AS packed,
 CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS dashed FROM orders)"""


@query("Q07_detect_date_formats", "SELECT * FROM (" + union_all(*[
    f"SELECT '{c}' AS column_name, '{label}' AS date_format, round(avg(CAST(try_strptime({c}, '{code}') IS NOT NULL AND regexp_matches({c}, '{shape}') AS INT)), 4) AS share FROM {FORMATS_SQL}"
    for c in ["iso", "us", "packed", "dashed"]
    for label, code, shape in [
        ("YYYY-MM-DD", "%Y-%m-%d", "^[0-9]{4}-"), ("MM/DD/YYYY", "%m/%d/%Y", "^[0-9]{2}/"), ("DD/MM/YYYY", "%d/%m/%Y", "^[0-9]{2}/"),
        ("YYYYMMDD", "%Y%m%d", "^[0-9]{8}$"), ("MM-DD-YYYY", "%m-%d-%Y", "^[0-9]{2}-"), ("DD-MM-YYYY", "%d-%m-%Y", "^[0-9]{2}-"),
        ("YYYY/MM/DD", "%Y/%m/%d", "^[0-9]{4}/")]]) + ") WHERE share > 0.8")
def _(t):
    d = F.col("o_orderdate")
    rows = t.orders.select(
        F.date_format(d, "yyyy-MM-dd").alias("iso"), F.date_format(d, "MM/dd/yyyy").alias("us"), F.date_format(d, "yyyyMMdd").alias("packed"),
        F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.date_format(d, "dd-MM-yyyy")).alias("dashed"),
    )
    return profile.detect_date_formats(rows, ["iso", "us", "packed", "dashed"])


@query("Q08_null_empty_counts", union_all(*[f"""
SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS empty_count,
 count(*) AS total_rows, round(count(*) FILTER ({c} IS NULL)::DOUBLE * 100.0 / count(*), 2) AS null_pct,
 round(count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '')::DOUBLE * 100.0 / count(*), 2) AS empty_pct FROM {CUSTOMER_TEXT_SQL}"""
    for c in ["c_custkey", "c_nationkey", "c_name", "code"]]))
def _(t):
    return profile.null_empty_counts(customer_text(t))


@query("Q08_null_empty_documents", union_all(*[f"""
SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS empty_count,
 count(*) AS total_rows, round(count(*) FILTER ({c} IS NULL)::DOUBLE * 100.0 / count(*), 2) AS null_pct,
 round(count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '')::DOUBLE * 100.0 / count(*), 2) AS empty_pct FROM documents"""
    for c in ["text", "lang", "source"]]))
def _(t):
    return profile.null_empty_counts(t.documents, ["text", "lang", "source"])


@query("Q09_duplicate_summary", """
WITH g AS (SELECT count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(sum(copies) AS BIGINT) AS total_rows, count(*) AS unique_rows, count(*) FILTER (copies > 1) AS duplicated_groups,
 max(copies) AS most_copies, CAST(sum(copies) - count(*) AS BIGINT) AS duplicate_rows,
 round((sum(copies) - count(*))::DOUBLE * 100.0 / sum(copies)::DOUBLE, 2) AS duplicate_pct FROM g""")
def _(t):
    return profile.duplicate_summary(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("Q10_validation_summary", """
WITH e AS (SELECT c_custkey, 'error' AS s FROM customer WHERE NOT coalesce(c_acctbal > 0, false)
 UNION ALL SELECT c_custkey, 'warning' FROM customer WHERE c_mktsegment <> 'BUILDING'
 UNION ALL SELECT c_custkey, 'error' FROM customer WHERE NOT c_nationkey BETWEEN 2 AND 22)
SELECT (SELECT count(*) FROM customer) AS total_rows,
 (SELECT count(*) FROM customer) - (SELECT count(DISTINCT c_custkey) FROM e WHERE s = 'error') AS valid_rows,
 (SELECT count(*) FROM e WHERE s = 'error') AS error_count, (SELECT count(*) FROM e WHERE s = 'warning') AS warning_count,
 (SELECT count(*) FROM e WHERE s = 'error') = 0 AS valid""")
def _(t):
    rules = [
        FieldRule("acct_positive", "c_acctbal", ">", value=0),
        FieldRule("segment", "c_mktsegment", "in", values=("BUILDING",), severity="warning"),
        FieldRule("nation", "c_nationkey", "range", min=2, max=22),
    ]
    return profile.validation_summary(t.customer, validate(t.customer, rules, "c_custkey"))
