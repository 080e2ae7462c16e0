"""Queries for run history (N14-N20) and expectations (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import expectations as ex
from tablewright.operators import gates, history
from tablewright.operators.expectations import Expectation
from tablewright.plans.registry import query
from tablewright.plans.sqltext import union_all
from tablewright.session import scratch_folder
from tablewright.sources.files import read_lines

AS_OF = "2024-01-25 00:00:00"
HIST_SQL = """hist AS (SELECT event_id AS run_id, event_type AS suite_name, ts AS run_timestamp, CASE WHEN value < 12 THEN 'PASS' WHEN value < 14 THEN 'PARTIAL' ELSE 'FAIL' END AS status,
 CASE WHEN event_id % 9 <> 0 THEN least(value * 4, 100) END AS quality_score, event_id % 8 AS pass_count, CAST(8 AS BIGINT) AS total_count, user_id AS invalid_rows, user_id * 2 + 100 AS total_rows FROM events)"""


def runs(t):
    v, k = F.col("value"), F.col("event_id")
    return t.events.select(
        k.alias("run_id"), F.col("event_type").alias("suite_name"), F.col("ts").alias("run_timestamp"),
        F.when(v < 12, "PASS").when(v < 14, "PARTIAL").otherwise("FAIL").alias("status"),
        F.when(k % 9 != 0, F.least(v * 4, F.lit(100.0))).alias("quality_score"),
        (k % 8).alias("pass_count"), F.lit(8).cast("bigint").alias("total_count"),
        F.col("user_id").alias("invalid_rows"), (F.col("user_id") * 2 + 100).alias("total_rows"),
    )


@query("N14_run_history_append", f"WITH {HIST_SQL} SELECT suite_name, count(*) AS runs FROM hist GROUP BY suite_name")
def _(t):
    folder = scratch_folder(t.spark, "history")
    h = runs(t)
    history.append_runs(h.filter("run_id % 2 = 0"), folder)
    history.append_runs(h.filter("run_id % 2 = 1"), folder)
    return t.spark.read.parquet(folder).groupBy("suite_name").agg(F.count(F.lit(1)).alias("runs"))


@query("N15_recent_runs", f"WITH {HIST_SQL} SELECT run_id, suite_name, status FROM hist ORDER BY run_timestamp DESC, run_id DESC LIMIT 20")
def _(t):
    return history.recent_runs(runs(t), 20).select("run_id", "suite_name", "status")


TREND_SQL = """SELECT strftime(run_timestamp, '%Y-%m-%d') AS date, count(*) AS total_runs, count(*) FILTER (status = 'PASS') AS pass_runs, count(*) FILTER (status <> 'PASS') AS fail_runs,
 round(avg(quality_score), 6) AS avg_quality_score, round((count(*) FILTER (status = 'PASS') * 100.0 / count(*))::DOUBLE, 2) AS pass_rate
 FROM hist WHERE run_timestamp >= TIMESTAMP '{as_of}' - INTERVAL {days} DAYS {more} GROUP BY 1"""


@query("N16_daily_trend", f"WITH {HIST_SQL} " + TREND_SQL.format(as_of=AS_OF, days=14, more=""))
def _(t):
    return history.daily_trend(runs(t), AS_OF, 14, digits=6)


@query("N16_daily_trend_suite", f"WITH {HIST_SQL} " + TREND_SQL.format(as_of=AS_OF, days=30, more="AND suite_name = 'click'"))
def _(t):
    return history.daily_trend(runs(t), AS_OF, 30, "click", digits=6)


@query("N17_suite_summary", f"""WITH {HIST_SQL}, s AS (SELECT suite_name, arg_max(status, run_timestamp) AS st, max(run_timestamp) AS last_run,
 avg((status = 'PASS')::INT) FILTER (run_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS) * 100 AS rate30, avg(quality_score) FILTER (run_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS) AS score30,
 avg((status = 'PASS')::INT) FILTER (run_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS) * 100 AS last7,
 avg((status = 'PASS')::INT) FILTER (run_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS AND run_timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS) * 100 AS prior7 FROM hist GROUP BY suite_name)
SELECT suite_name, CASE WHEN st = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS last_run_status, strftime(last_run, '%Y-%m-%d %H:%M:%S') AS last_run_at, round(rate30, 1) AS pass_rate_30d,
 round(score30, 1) AS avg_quality_score, CASE WHEN last7 - prior7 > 2 THEN 'up' WHEN prior7 - last7 > 2 THEN 'down' ELSE 'flat' END AS trend_direction FROM s""")
def _(t):
    return history.suite_summary(runs(t), AS_OF)


BASE_SQL = """avg(pass_count * 100.0::DOUBLE / total_count) OVER w AS bp, avg(quality_score) OVER w AS bq, avg(invalid_rows * 100.0::DOUBLE / total_rows) OVER w AS be, count(*) OVER w AS n"""


@query("N18_rolling_baseline", f"""WITH {HIST_SQL} SELECT suite_name, run_id, round(bp, 4) AS base_pass_rate, round(bq, 4) AS base_quality_score, round(be, 4) AS base_error_rate, n AS sample_size FROM (
 SELECT suite_name, run_id, {BASE_SQL} FROM hist WINDOW w AS (PARTITION BY suite_name ORDER BY run_timestamp, run_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""")
def _(t):
    b = history.rolling_baseline(runs(t))
    return b.select("suite_name", "run_id", *[F.round(c, 4).alias(c) for c in ("base_pass_rate", "base_quality_score", "base_error_rate")], "sample_size")


@query("N18_current_baselines", f"""WITH {HIST_SQL} SELECT suite_name, round(arg_max(bp, (run_timestamp, run_id)), 4) AS base_pass_rate, max(n) AS sample_size FROM (
 SELECT suite_name, run_id, run_timestamp, {BASE_SQL} FROM hist WINDOW w AS (PARTITION BY suite_name ORDER BY run_timestamp, run_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) GROUP BY suite_name""")
def _(t):
    return history.current_baselines(runs(t)).select("suite_name", F.round("base_pass_rate", 4).alias("base_pass_rate"), "sample_size")


@query("N19_deviation_alerts", f"""WITH {HIST_SQL}, b AS (SELECT *, {BASE_SQL} FROM hist WINDOW w AS (PARTITION BY suite_name ORDER BY run_timestamp, run_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (1 - invalid_rows / total_rows) * 100 AS cp, invalid_rows * 100.0::DOUBLE / total_rows AS ce FROM b WHERE n > 0)
SELECT suite_name, run_id, 'pass_rate' AS metric, round(bp, 6) AS baseline_value, round(cp, 6) AS current_value, round(cp - bp, 6) AS delta, 10.0::DOUBLE AS threshold FROM r WHERE cp - bp < -10
UNION ALL SELECT suite_name, run_id, 'quality_score', round(bq, 6), round(quality_score, 6), round(quality_score - bq, 6), 5.0::DOUBLE FROM r WHERE quality_score - bq < -5
UNION ALL SELECT suite_name, run_id, 'error_rate', round(be, 6), round(ce, 6), round(ce - be, 6), 20.0::DOUBLE FROM r WHERE ce - be > 20""")
def _(t):
    return history.deviation_alerts(runs(t), digits=6)


@query("N20_loader_metrics", """WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS loaded, count(*) FILTER (c_acctbal < 0) AS rejected FROM customer GROUP BY c_nationkey)
SELECT sum(loaded)::BIGINT AS rows_loaded, sum(rejected)::BIGINT AS rows_rejected, CAST(0 AS BIGINT) AS rows_discarded FROM g""")
def _(t):
    folder = scratch_folder(t.spark, "logs")
    counted = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("loaded"), F.count_if(F.col("c_acctbal") < 0).alias("rejected"))
    text = F.concat(
        F.lit("Table CUSTOMER:\n  "), F.col("loaded").cast("string"), F.lit(" Rows successfully loaded.\n  "),
        F.col("rejected").cast("string"), F.lit(" Rows not loaded due to data errors.\n"))
    # One log folder per nation, so that every log is a file of its own.
    counted.select(text.alias("value"), "c_nationkey").write.partitionBy("c_nationkey").text(folder)
    logs = read_lines(t.spark, folder)
    metrics = gates.loader_metrics(logs, max_rejected=3, file="_file")
    return metrics.agg(*[F.sum(c).alias(c) for c in ("rows_loaded", "rows_rejected", "rows_discarded")])


# ------------------------------------------------------------- expectations
SUITE = [
    Expectation("not_null", "status"), Expectation("in_set", "status", values=("O", "P")), Expectation("between", "o_totalprice", min=1000, max=450000, mostly=0.9),
    Expectation("between", "o_totalprice", min=1000, max=200000), Expectation("unique", "o_orderkey"), Expectation("unique", "o_custkey"), Expectation("row_count_between", min=1, max=1000),
]
EXPECT_SQL = {
    "not_null": ("not_null", "status", "o_orderkey % 9 = 0", "n", 1.0),
    "in_set": ("in_set", "status", "o_orderkey % 9 <> 0 AND o_orderstatus NOT IN ('O','P')", "n - count(*) FILTER (o_orderkey % 9 = 0)", 1.0),
    "between_mostly": ("between", "o_totalprice", "NOT o_totalprice BETWEEN 1000 AND 450000", "n", 0.9),
    "between": ("between", "o_totalprice", "NOT o_totalprice BETWEEN 1000 AND 200000", "n", 1.0),
}


def expect_sql(*names):
    return [
        f"""SELECT 'orders' AS target_id, '{k}' AS expectation_type, '{c}' AS column_name, (c - u) / c >= {m} AS success, u AS unexpected_count, n AS element_count
 FROM (SELECT count(*) FILTER ({bad}) AS u, count(*) AS n, {judged.replace('n -', 'count(*) -') if judged != 'n' else 'count(*)'} AS c FROM orders)"""
        for k, c, bad, judged, m in (EXPECT_SQL[x] for x in names)
    ]


def unique_sql(c):
    return f"""SELECT 'orders' AS target_id, 'unique' AS expectation_type, '{c}' AS column_name, coalesce(sum(k) FILTER (k > 1), 0) = 0 AS success,
 CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) AS unexpected_count, CAST(sum(k) AS BIGINT) AS element_count FROM (SELECT count(*) AS k FROM orders GROUP BY {c})"""


ROWS_SQL = "SELECT 'orders' AS target_id, 'row_count_between' AS expectation_type, CAST(NULL AS VARCHAR) AS column_name, count(*) BETWEEN 1 AND 1000 AS success, CAST(NULL AS BIGINT) AS unexpected_count, count(*) AS element_count FROM orders"


def expect_rows(t):
    return t.orders.withColumn("status", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")))


def suite_query(name, sql, picked):
    @query(name, sql)
    def _(t, picked=picked):
        return ex.run_suite(expect_rows(t), picked, "orders")


suite_query("E02_values_not_null", expect_sql("not_null")[0], SUITE[:1])
suite_query("E03_values_unique", union_all(unique_sql("o_orderkey"), unique_sql("o_custkey")) + " UNION ALL " + ROWS_SQL, SUITE[4:])
suite_query("E04_values_in_set", expect_sql("in_set")[0], SUITE[1:2])
suite_query("E05_values_between", union_all(*expect_sql("between_mostly", "between")), SUITE[2:4])
suite_query("E06_row_count_between", ROWS_SQL, SUITE[6:])


@query("E07_default_suite", union_all(
    """SELECT 'orders' AS target_id, 'columns_match' AS expectation_type, CAST(NULL AS VARCHAR) AS column_name, true AS success, CAST(NULL AS BIGINT) AS unexpected_count, count(*) AS element_count FROM orders""",
    *[f"SELECT 'orders', 'not_null', '{c}', count({c}) = count(*), count(*) - count({c}), count(*) FROM orders" for c in ("o_custkey", "o_orderkey")],
    unique_sql("o_orderkey"), "SELECT 'orders', 'row_count_between', NULL, count(*) >= 1, CAST(NULL AS BIGINT), count(*) FROM orders"))
def _(t):
    suite = ex.default_suite(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["o_custkey"], ["o_orderkey"])
    return ex.run_suite(t.orders, suite, "orders")


@query("E08_checkpoint_summary", "WITH r AS (" + union_all(*expect_sql("not_null", "in_set", "between_mostly", "between"), unique_sql("o_orderkey"), unique_sql("o_custkey"), ROWS_SQL,
    "SELECT 'customer', 'not_null', 'c_name', count(c_name) = count(*), count(*) - count(c_name), count(*) FROM customer") + """)
SELECT target_id, bool_and(success) OVER (PARTITION BY target_id) AS run_success, expectation_type, column_name, success, unexpected_count, element_count FROM r""")
def _(t):
    customer = ex.run_suite(t.customer, [Expectation("not_null", "c_name")], "customer")
    return ex.checkpoint_summary([ex.run_suite(expect_rows(t), SUITE, "orders"), customer])


# --------------------------------------------------------- expression rules
LINE_REF = "CAST(l_orderkey AS VARCHAR)"


def rule_sql(rule_id, severity, scope, ref, source):
    return f"SELECT '{rule_id}' AS rule_id, '{severity}' AS severity, '{scope}' AS scope, {ref} AS record_ref, 'Validation failed' AS message FROM {source}"


RECORD_SQL = rule_sql("tax_cap", "WARN", "record", "'record:' || CAST(l_orderkey AS VARCHAR)",
                      "(SELECT l_orderkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS tax, l_discount FROM lineitem) WHERE NOT tax <= l_discount")


def record_rows(t):
    rows = t.lineitem.withColumn("tax", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")))
    return ex.record_rule(rows, "tax_cap", "tax <= l_discount", "l_orderkey", "WARN")


@query("E09_record_rule", RECORD_SQL)
def _(t):
    return record_rows(t)


GROUP_SQL = rule_sql("few_lines", "ERROR", "group", "'group:' || CAST(l_orderkey AS VARCHAR)", "lineitem GROUP BY l_orderkey HAVING NOT count(*) < 7")
WHERE_SQL = rule_sql("one_return", "ERROR", "group", "'group:' || CAST(l_orderkey AS VARCHAR)", "lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R') <> 1")


@query("E10_group_rule_count", GROUP_SQL)
def _(t):
    return ex.group_rule(t.lineitem, "few_lines", ["l_orderkey"], "count(*) < 7")


@query("E11_group_count_where", WHERE_SQL)
def _(t):
    return ex.group_count_where(t.lineitem, "one_return", ["l_orderkey"], "l_returnflag", "R", 1)


@query("E12_group_strict_desc", rule_sql(
    "falling", "ERROR", "group", "'group:' || CAST(k AS VARCHAR)",
    """(SELECT k, bool_or(b <= value) AS rises FROM (SELECT event_id // 3 AS k, value, lag(value) OVER (PARTITION BY event_id // 3 ORDER BY ts, event_id) AS b FROM events) GROUP BY k) WHERE rises"""))
def _(t):
    rows = t.events.select((F.col("event_id") / 3).cast("bigint").alias("k"), "ts", "event_id", "value")
    return ex.group_strict_desc(rows, "falling", ["k"], "value", ["ts", "event_id"])


@query("E12_group_strict_desc_types", rule_sql(
    "falling", "ERROR", "group", "'group:' || event_type",
    """(SELECT event_type, bool_or(b <= value) AS rises FROM (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS b FROM events)
 GROUP BY event_type) WHERE rises"""))
def _(t):
    rows = t.events.select("event_type", "event_id", "value", (-F.col("value")).alias("falling"))
    return ex.group_strict_desc(rows, "falling", ["event_type"], "value", ["falling", "event_id"])


FILE_SQL = rule_sql("total_count", "ERROR", "file", "'file'", "(SELECT max(o_orderkey) + 2 AS declared, count(*) AS n FROM orders) WHERE NOT declared = n")


@query("E13_file_rule", FILE_SQL)
def _(t):
    return ex.file_rule(t.orders, "total_count", {"declared": "max(o_orderkey) + 2", "n": "count(*)"}, "declared = n")


def rule_run(t):
    return (
        record_rows(t)
        .unionByName(ex.group_rule(t.lineitem, "few_lines", ["l_orderkey"], "count(*) < 7"))
        .unionByName(ex.group_count_where(t.lineitem, "one_return", ["l_orderkey"], "l_returnflag", "R", 1))
        .unionByName(ex.file_rule(t.orders, "total_count", {"declared": "max(o_orderkey) + 2", "n": "count(*)"}, "declared = n"))
    )


RUN_SQL = f"WITH v AS ({union_all(RECORD_SQL, GROUP_SQL, WHERE_SQL, FILE_SQL)})"


@query("E14_rule_run_summary", f"""{RUN_SQL}, c AS (SELECT (SELECT count(*) FROM lineitem) + 1 AS validated, count(*) FILTER (severity = 'ERROR') AS failed, count(*) FILTER (severity = 'WARN') AS warned FROM v)
SELECT validated, greatest(validated - failed - warned, 0) AS passed, failed, warned FROM c""")
def _(t):
    return ex.rule_run_summary(rule_run(t), t.lineitem.agg((F.count(F.lit(1)) + 1).alias("n")).scalar())


@query("E14_top_failing", f"{RUN_SQL} SELECT rule_id, count(*) AS fail_count FROM v GROUP BY rule_id ORDER BY fail_count DESC, rule_id LIMIT 5")
def _(t):
    return ex.top_failing(rule_run(t))
