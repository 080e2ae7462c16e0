"""Queries for streaming validation (Z): a run over a folder equals the batch run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import transforms as tf
from tablewright.operators.mapping import Target
from tablewright.operators.rules import FieldRule, GroupRule
from tablewright.plans.registry import query
from tablewright.plans.rule_queries import PRICING_RULES, PRICING_SQL, line_id
from tablewright.session import scratch_folder
from tablewright.streaming import watch

ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def landed(t, name, df):
    """A folder into which the rows of a table have arrived as files."""
    folder = scratch_folder(t.spark, name)
    df.write.parquet(f"{folder}/in")
    return folder


WATCH_SQL = """
WITH d AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)
SELECT rule_id, count(*) AS violations FROM (SELECT 'price_cap' AS rule_id FROM orders WHERE NOT o_totalprice <= 400000
 UNION ALL SELECT 'one_per_customer' FROM orders WHERE o_custkey IN (SELECT o_custkey FROM d)) GROUP BY rule_id"""


def watched_orders(t, files_per_batch):
    # All orders of a customer are in one file; files arrive one or several at a time.
    folder = landed(t, "watch", t.orders.repartition(4, "o_custkey"))
    target = watch.WatchTarget(f"{folder}/in", ORDERS_SCHEMA, f"{folder}/out", f"{folder}/state", files_per_batch=files_per_batch)
    rules = [FieldRule("price_cap", "o_totalprice", "<=", value=400000), GroupRule("one_per_customer", "unique", ("o_custkey",))]
    watch.watch_and_validate(t.spark, target, rules, "o_orderkey", unit="file").awaitTermination()
    # A second run finds nothing new and adds nothing.
    watch.watch_and_validate(t.spark, target, rules, "o_orderkey", unit="file").awaitTermination()
    return watch.read_results(t.spark, target)[0].groupBy("rule_id").agg(F.count(F.lit(1)).alias("violations"))


@query("Z01_watch_and_validate", WATCH_SQL)
def _(t):
    return watched_orders(t, 1)


@query("Z01_watch_two_files_a_batch", WATCH_SQL)
def _(t):
    return watched_orders(t, 2)


@query("Z01_watch_across_batches", """
WITH o AS (SELECT *, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_number FROM lineitem),
k AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi,
  sum(CAST(l_quantity AS DECIMAL(30,2))) AS s FROM o GROUP BY l_orderkey)
SELECT 'cap' AS rule_id, row_number FROM o WHERE NOT l_discount <= 0.09
UNION ALL SELECT 'one_line', row_number FROM o JOIN k USING (l_orderkey) WHERE n > 1
UNION ALL SELECT 'same_flag', row_number FROM o JOIN k USING (l_orderkey) WHERE flags > 1
UNION ALL SELECT 'numbered', row_number FROM o JOIN k USING (l_orderkey) WHERE NOT (d = n AND lo = 1 AND hi = n)
UNION ALL SELECT 'total', row_number FROM o JOIN k USING (l_orderkey) WHERE s < 20 OR s > 200""")
def _(t):
    """The lines of an order are spread over files that arrive in several batches."""
    # Files and batches of a bounded size: five files for each part in which the table is read, two fifths of them a batch.
    parts = t.lineitem.rdd.getNumPartitions()
    folder = landed(t, "watch", t.lineitem.repartition(5 * parts, "l_linenumber", "l_partkey"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.lineitem.schema)
    target = watch.WatchTarget(f"{folder}/in", schema, f"{folder}/out", f"{folder}/state", files_per_batch=2 * parts)
    key = ("l_orderkey",)
    rules = [
        FieldRule("cap", "l_discount", "<=", value=0.09), GroupRule("one_line", "unique", key), GroupRule("same_flag", "consistent", key, target="l_returnflag"),
        GroupRule("numbered", "sequential", key, target="l_linenumber"), GroupRule("total", "group_sum", key, target="l_quantity", min=20, max=200, scale=2),
    ]
    for _ in range(2):
        watch.watch_and_validate(t.spark, target, rules, line_id(), unit="all").awaitTermination()
    return watch.landed_violations(t.spark, target, rules).select("rule_id", "row_number")


@query("Z01_watch_metrics", "SELECT count(*) AS total_rows, count(*) FILTER (o_totalprice <= 400000) AS valid_rows, count(*) FILTER (o_totalprice > 400000) AS error_count FROM orders")
def _(t):
    folder = landed(t, "watch", t.orders.repartition(4))
    target = watch.WatchTarget(f"{folder}/in", ORDERS_SCHEMA, f"{folder}/out", f"{folder}/state", files_per_batch=2)
    rules = [FieldRule("price_cap", "o_totalprice", "<=", value=400000)]
    watch.watch_and_validate(t.spark, target, rules, "o_orderkey").awaitTermination()
    return watch.read_results(t.spark, target)[1].agg(*[F.sum(c).alias(c) for c in ("total_rows", "valid_rows", "error_count")])


@query("Z02_stateless_stream_rules", PRICING_SQL)
def _(t):
    folder = landed(t, "stream", t.lineitem)
    stream = t.spark.readStream.schema(t.lineitem.schema).parquet(f"{folder}/in")
    watch.run_once(watch.stream_violations(stream, PRICING_RULES, line_id()), f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out")


@query("Z02_stream_transform", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS customer, strftime(o_orderdate, '%Y%m%d') AS day FROM orders")
def _(t):
    folder = landed(t, "stream", t.orders)
    stream = t.spark.readStream.schema(ORDERS_SCHEMA).parquet(f"{folder}/in")
    targets = [Target("customer", lambda: tf.pad_left(F.col("o_custkey"), 8, "0"), 8), Target("day", lambda: F.date_format("o_orderdate", "yyyyMMdd"))]
    watch.run_once(watch.stream_transform(stream, targets, ["o_orderkey"]), f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out")
