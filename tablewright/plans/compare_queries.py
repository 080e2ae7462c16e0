"""Queries for comparisons (C) and the thresholds and gates over them (N09-N13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import compare, gates
from tablewright.operators import profile as prof
from tablewright.operators.rules import FieldRule, validate
from tablewright.plans.registry import query
from tablewright.plans.sqltext import rounded_sql, union_all
from tablewright.sources.rows import number_rows

# The right side: some orders dropped, some new, some fields changed or nulled.
RIGHT_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 103 <> 0 THEN o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 10.5 ELSE o_totalprice END AS o_totalprice, o_orderdate,
 CASE WHEN o_orderkey % 107 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
 FROM orders WHERE o_orderkey % 97 <> 0
 UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 89 = 0"""
LEFT_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 109 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate,
 o_orderpriority FROM orders"""
SIDES_SQL = f"WITH a AS ({LEFT_SQL}), b AS ({RIGHT_SQL})"
KEYS = ["o_orderkey"]


def left_orders(t):
    k = F.col("o_orderkey")
    return t.orders.withColumn("o_orderstatus", F.when(k % 109 != 0, F.col("o_orderstatus")))


def right_orders(t):
    k = F.col("o_orderkey")
    base = t.orders.filter(k % 97 != 0)
    changed = (
        base.withColumn("o_orderstatus", F.when(k % 103 != 0, F.col("o_orderstatus")))
        .withColumn("o_totalprice", F.when(k % 101 == 0, F.col("o_totalprice") + 10.5).otherwise(F.col("o_totalprice")))
        .withColumn("o_orderpriority", F.when(k % 107 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")))
    )
    new = t.orders.filter(k % 89 == 0).withColumn("o_orderkey", k + 100000000)
    return changed.unionByName(new)


def sides(t):
    return left_orders(t), right_orders(t)


@query("C01_only_in_left", f"{SIDES_SQL} SELECT o_orderkey, o_totalprice FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def _(t):
    return compare.only_in_left(*sides(t), KEYS).select("o_orderkey", "o_totalprice")


@query("C02_only_in_right", f"{SIDES_SQL} SELECT o_orderkey, o_totalprice FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def _(t):
    return compare.only_in_right(*sides(t), KEYS).select("o_orderkey", "o_totalprice")


FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def diff_sql(fields, both_null: bool = False) -> str:
    def kind(f):
        return f"""CASE WHEN a.{f} IS NULL AND b.{f} IS NULL THEN 'both_null' WHEN a.{f} IS NULL THEN 'null_to_value'
 WHEN b.{f} IS NULL THEN 'value_to_null' ELSE 'value_difference' END"""

    extra = "OR (a.{f} IS NULL AND b.{f} IS NULL)" if both_null else ""
    return union_all(*[
        f"""SELECT a.o_orderkey, '{f}' AS field, CAST(a.{f} AS VARCHAR) AS left_value, CAST(b.{f} AS VARCHAR) AS right_value,
 {kind(f)} AS diff_type, CAST(1 AS BIGINT) AS pairs FROM a JOIN b ON a.o_orderkey = b.o_orderkey
 WHERE a.{f} IS DISTINCT FROM b.{f} {extra.format(f=f)}""" for f in fields])


@query("C03_keyed_diff", f"{SIDES_SQL} {diff_sql(FIELDS)}")
def _(t):
    return compare.keyed_diff(*sides(t), KEYS)


@query("C03_keyed_diff_unique", f"{SIDES_SQL} {diff_sql(FIELDS)}")
def _(t):
    return compare.keyed_diff(*sides(t), KEYS, unique_keys=True)


@query("C03_keyed_diff_nulls_differ", f"{SIDES_SQL} {diff_sql(FIELDS, True)}")
def _(t):
    return compare.keyed_diff(*sides(t), KEYS, nulls_differ=True)


# Lines under their order key alone, so keys repeat; the line number names the source row.
LINES_SQL = """WITH a AS (SELECT l_orderkey AS k, l_returnflag AS flag, CAST(l_quantity AS DECIMAL(12,2)) AS q, l_linenumber AS n FROM lineitem),
b AS (SELECT l_orderkey AS k, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_returnflag END AS flag,
      CAST(CASE WHEN l_partkey % 40 = 0 THEN l_quantity + 1 ELSE l_quantity END AS DECIMAL(12,2)) AS q, l_linenumber + 10 AS n
      FROM lineitem WHERE l_suppkey % 30 <> 0
      UNION ALL SELECT l_orderkey, l_returnflag, CAST(l_quantity AS DECIMAL(12,2)), l_linenumber + 20 FROM lineitem WHERE l_partkey % 70 = 0)"""


def repeated_lines(t):
    k, flag, n = F.col("l_orderkey").alias("k"), F.col("l_returnflag"), F.col("l_linenumber")
    q = F.col("l_quantity").cast("decimal(12,2)")
    a = t.lineitem.select(k, flag.alias("flag"), q.alias("q"), n.alias("n"))
    more = F.when(F.col("l_partkey") % 40 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast("decimal(12,2)")
    b = t.lineitem.filter("l_suppkey % 30 <> 0").select(k, F.when(F.col("l_partkey") % 50 != 0, flag).alias("flag"), more.alias("q"), (n + 10).alias("n"))
    return a, b.unionByName(t.lineitem.filter("l_partkey % 70 = 0").select(k, flag.alias("flag"), q.alias("q"), (n + 20).alias("n")))


@query("C03_matched_diff", f"""{LINES_SQL},
c AS (SELECT k, flag, q, sum(l) AS l, sum(r) AS r FROM (SELECT k, flag, q, 1 AS l, 0 AS r FROM a UNION ALL SELECT k, flag, q, 0, 1 FROM b) GROUP BY k, flag, q),
x AS (SELECT *, row_number() OVER (PARTITION BY k, flag, q ORDER BY n) AS i FROM a WHERE k IN (SELECT k FROM b)),
y AS (SELECT *, row_number() OVER (PARTITION BY k, flag, q ORDER BY n) AS i FROM b WHERE k IN (SELECT k FROM a)),
u AS (SELECT x.k, x.flag, x.q, x.n, row_number() OVER (PARTITION BY x.k ORDER BY x.flag NULLS FIRST, x.q NULLS FIRST, x.n) AS j
      FROM x JOIN c ON x.k = c.k AND x.flag IS NOT DISTINCT FROM c.flag AND x.q IS NOT DISTINCT FROM c.q WHERE x.i > c.r),
v AS (SELECT y.k, y.flag, y.q, y.n, row_number() OVER (PARTITION BY y.k ORDER BY y.flag NULLS FIRST, y.q NULLS FIRST, y.n) AS j
      FROM y JOIN c ON y.k = c.k AND y.flag IS NOT DISTINCT FROM c.flag AND y.q IS NOT DISTINCT FROM c.q WHERE y.i > c.l),
p AS (SELECT u.k, u.n AS left_n, v.n AS right_n, u.flag AS f, v.flag AS g, u.q AS s, v.q AS t FROM u JOIN v ON u.k = v.k AND u.j = v.j)
SELECT k, left_n, right_n, 'flag' AS field, f AS left_value, g AS right_value,
  CASE WHEN f IS NULL THEN 'null_to_value' WHEN g IS NULL THEN 'value_to_null' ELSE 'value_difference' END AS diff_type FROM p WHERE f IS DISTINCT FROM g
UNION ALL SELECT k, left_n, right_n, 'q', CAST(s AS VARCHAR), CAST(t AS VARCHAR), 'value_difference' FROM p WHERE s IS DISTINCT FROM t
UNION ALL SELECT k, n, NULL, NULL, NULL, NULL, 'extra_in_left' FROM u WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.k = u.k AND v.j = u.j)
UNION ALL SELECT k, NULL, n, NULL, NULL, NULL, 'extra_in_right' FROM v WHERE NOT EXISTS (SELECT 1 FROM u WHERE v.k = u.k AND v.j = u.j)""")
def _(t):
    found = compare.matched_diff(*repeated_lines(t), ["k"], ids=["n"])
    return found.withColumns({"left_n": F.col("left_row.n"), "right_n": F.col("right_row.n")}).drop("left_row", "right_row")


# Prices that fit no common type: 38 whole digits on one side, six decimals on the other; keys above 2**53 against doubles.
WIDE_SQL = """WITH a AS (SELECT o_orderkey AS k, CAST(o_custkey AS HUGEINT) * CAST('10000000000000000000000000000' AS HUGEINT) AS big,
  CAST(9007199254740992 AS BIGINT) + o_orderkey % 4 AS n FROM orders WHERE o_orderkey % 3 > 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey + 0.5 AS DECIMAL(20,6)) END AS small FROM orders WHERE o_orderkey % 3 > 0)"""


def wide_numbers(t):
    rows = t.orders.filter("o_orderkey % 3 > 0")
    big = F.concat(F.col("o_custkey").cast("string"), F.lit("0" * 28)).cast("decimal(38,0)")
    a = rows.select(F.col("o_orderkey").alias("k"), big.alias("price"), (F.lit(2**53) + F.col("o_orderkey") % 4).alias("n"))
    small = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_custkey") + F.lit("0.5").cast("decimal(3,1)")).cast("decimal(20,6)"))
    return a, rows.select(F.col("o_orderkey").alias("k"), small.alias("price"), F.lit(float(2**53)).alias("n"))


@query("C03_exact_numbers", f"""{WIDE_SQL}
SELECT a.k, 'price' AS field, CAST(a.big AS VARCHAR) AS left_value, CAST(b.small AS VARCHAR) AS right_value,
  CASE WHEN b.small IS NULL THEN 'value_to_null' ELSE 'value_difference' END AS diff_type, CAST(1 AS BIGINT) AS pairs FROM a JOIN b ON a.k = b.k
UNION ALL SELECT k, 'n', CAST(n AS VARCHAR), '9.007199254740992E15', 'value_difference', CAST(1 AS BIGINT) FROM a WHERE n <> 9007199254740992""")
def _(t):
    return compare.keyed_diff(*wide_numbers(t), ["k"])


@query("C09_exact_numbers", f"""{WIDE_SQL} SELECT count(*) AS rows_with_differences, CAST(0 AS BIGINT) AS matching_rows, 'failed' AS status FROM a""")
def _(t):
    return compare.compare_status(compare.compare_summary(*wide_numbers(t), ["k"])).select("rows_with_differences", "matching_rows", "status")


@query("C04_ignore_columns", f"{SIDES_SQL} {diff_sql(['o_orderstatus', 'o_orderpriority'])}")
def _(t):
    return compare.keyed_diff(*sides(t), KEYS, ignore=("o_custkey", "o_totalprice", "o_orderdate"), unique_keys=True)


@query("C05_classify_difference", f"""{SIDES_SQL} SELECT a.o_orderkey,
 CASE WHEN coalesce(a.o_orderstatus, '') = '' AND coalesce(b.o_orderstatus, '') = '' THEN 'both_empty' WHEN coalesce(a.o_orderstatus, '') = '' THEN 'empty_to_value'
 WHEN coalesce(b.o_orderstatus, '') = '' THEN 'value_to_empty' ELSE 'value_difference' END AS diff_type
 FROM a JOIN b ON a.o_orderkey = b.o_orderkey WHERE coalesce(a.o_orderstatus, '?') <> coalesce(b.o_orderstatus, '!')""")
def _(t):
    a, b = sides(t)
    a = a.select("o_orderkey", F.col("o_orderstatus").alias("x"))
    b = b.select("o_orderkey", F.col("o_orderstatus").alias("y"))
    pairs = a.join(b, "o_orderkey").filter(F.coalesce("x", F.lit("?")) != F.coalesce("y", F.lit("!")))
    return pairs.select("o_orderkey", compare.empty_difference_type(F.col("x"), F.col("y")).alias("diff_type"))


@query("C06_string_difference", """
SELECT p_partkey, CAST(length(y) - length(x) AS INTEGER) AS length_diff, lower(x) = lower(y) AS case_only, trim(x) = trim(y) AS whitespace_diff,
 CAST(length(x) AS INTEGER) AS length_left, CAST(length(y) AS INTEGER) AS length_right FROM
 (SELECT p_partkey, p_name AS x, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN p_name || '  '
  WHEN p_partkey % 4 = 2 THEN left(p_name, 3) ELSE p_name END AS y FROM part) WHERE x <> y""")
def _(t):
    k, n = F.col("p_partkey"), F.col("p_name")
    y = F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.concat(n, F.lit("  "))).when(k % 4 == 2, F.left(n, F.lit(3))).otherwise(n)
    rows = t.part.select("p_partkey", n.alias("x"), y.alias("y")).filter("x <> y")
    return rows.select("p_partkey", compare.string_difference(F.col("x"), F.col("y")).alias("d")).select("p_partkey", "d.*")


@query("C07_numeric_difference", f"""
SELECT o_orderkey, {rounded_sql("y - x", 4)} AS absolute_difference, CASE WHEN x = 0 THEN CAST('inf' AS DOUBLE) ELSE {rounded_sql("(y - x) / x * 100", 4)} END AS percent_change,
 (x < 0) <> (y < 0) AS sign_change FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS x,
 CASE WHEN o_orderkey % 7 = 0 THEN -o_totalprice ELSE o_totalprice * 1.5::DOUBLE END AS y FROM orders)""")
def _(t):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    rows = t.orders.select("o_orderkey", F.when(k % 10 == 0, 0.0).otherwise(p).alias("x"), F.when(k % 7 == 0, -p).otherwise(p * 1.5).alias("y"))
    d = rows.select("o_orderkey", compare.numeric_difference(F.col("x"), F.col("y")).alias("d")).select("o_orderkey", "d.*")
    return d.withColumn("absolute_difference", F.round("absolute_difference", 4)).withColumn("percent_change", F.round("percent_change", 4))


@query("C08_field_difference_stats", f"""{SIDES_SQL} SELECT field, diff_type, CAST(sum(pairs) AS BIGINT) AS differences
 FROM ({diff_sql(FIELDS)}) GROUP BY field, diff_type""")
def _(t):
    return compare.field_difference_stats(compare.keyed_diff(*sides(t), KEYS, unique_keys=True))


@query("C08_most_different_field", f"""{SIDES_SQL}, f AS (SELECT field, CAST(sum(pairs) AS BIGINT) AS n FROM ({diff_sql(FIELDS)}) GROUP BY field)
 SELECT (SELECT count(*) FROM f) AS fields_with_differences, field AS most_different_field, n AS differences FROM f ORDER BY n DESC, field DESC LIMIT 1""")
def _(t):
    return compare.most_different_field(compare.keyed_diff(*sides(t), KEYS, unique_keys=True))


SUMMARY_SQL = f"""SELECT (SELECT count(*) FROM a) AS total_rows_left, (SELECT count(*) FROM b) AS total_rows_right,
 (SELECT count(*) FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) AS only_in_left,
 (SELECT count(*) FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)) AS only_in_right,
 (SELECT count(DISTINCT o_orderkey) FROM ({diff_sql(FIELDS)})) AS rows_with_differences,
 (SELECT count(*) FROM (SELECT o_orderkey FROM a GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys_left,
 (SELECT count(*) FROM (SELECT o_orderkey FROM b GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys_right"""


@query("C09_compare_summary", f"{SIDES_SQL}, s AS ({SUMMARY_SQL}) SELECT *, total_rows_left - only_in_left - rows_with_differences AS matching_rows, CAST(0 AS BIGINT) AS columns_only_in_left, CAST(0 AS BIGINT) AS columns_only_in_right FROM s")
def _(t):
    return compare.compare_summary(*sides(t), KEYS)


# lineitem repeats (l_orderkey, l_linenumber): many-to-many on both sides.
LINE_SIDES_SQL = """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 10 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_tax FROM lineitem WHERE l_orderkey % 31 <> 0)"""


def line_sides(t):
    a = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    b = t.lineitem.filter("l_orderkey % 31 <> 0").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_suppkey") % 10 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_tax")
    return a, b


@query("C09_compare_summary_repeated_keys", f"""{LINE_SIDES_SQL}, j AS (SELECT a.l_quantity = b.l_quantity AND a.l_tax = b.l_tax AS same FROM a JOIN b USING (l_orderkey, l_linenumber)),
s AS (SELECT (SELECT count(*) FROM a) AS total_rows_left, (SELECT count(*) FROM b) AS total_rows_right,
 (SELECT count(*) FROM a ANTI JOIN b USING (l_orderkey, l_linenumber)) AS only_in_left,
 (SELECT count(*) FROM b ANTI JOIN a USING (l_orderkey, l_linenumber)) AS only_in_right,
 (SELECT count(*) FROM j WHERE NOT same) AS rows_with_differences,
 (SELECT count(*) FROM (SELECT 1 FROM a GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_keys_left,
 (SELECT count(*) FROM (SELECT 1 FROM b GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_keys_right)
SELECT *, total_rows_left - only_in_left - rows_with_differences AS matching_rows, CAST(0 AS BIGINT) AS columns_only_in_left, CAST(0 AS BIGINT) AS columns_only_in_right FROM s""")
def _(t):
    return compare.compare_summary(*line_sides(t), ["l_orderkey", "l_linenumber"])


@query("C03_keyed_diff_repeated_keys", f"""{LINE_SIDES_SQL}
SELECT field, CAST(count(*) AS BIGINT) AS pairs FROM (
 SELECT 'l_quantity' AS field FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.l_quantity <> b.l_quantity
 UNION ALL SELECT 'l_tax' FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.l_tax <> b.l_tax) GROUP BY field""")
def _(t):
    diffs = compare.keyed_diff(*line_sides(t), ["l_orderkey", "l_linenumber"])
    return diffs.groupBy("field").agg(F.sum("pairs").alias("pairs"))


@query("C09_duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n_left, count(*) AS n_right FROM lineitem
 GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _(t):
    return compare.duplicate_keys(t.lineitem, t.lineitem, ["l_orderkey", "l_linenumber"])


@query("C10_positional_diff", """
WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS r, s_suppkey, s_name, s_nationkey FROM supplier),
b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS r, s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN lower(s_name) ELSE s_name END AS s_name, s_nationkey
  FROM supplier WHERE s_suppkey % 100 <> 90)
SELECT r AS row_number, f AS field, x AS left_value, y AS right_value, 'value_difference' AS diff_type FROM (
 SELECT a.r, 's_suppkey' AS f, CAST(a.s_suppkey AS VARCHAR) AS x, CAST(b.s_suppkey AS VARCHAR) AS y FROM a JOIN b USING (r)
 UNION ALL SELECT a.r, 's_name', a.s_name, b.s_name FROM a JOIN b USING (r)
 UNION ALL SELECT a.r, 's_nationkey', CAST(a.s_nationkey AS VARCHAR), CAST(b.s_nationkey AS VARCHAR) FROM a JOIN b USING (r)) WHERE x <> y
UNION ALL SELECT r, NULL, NULL, NULL, 'only_in_left' FROM a WHERE r > (SELECT max(r) FROM b)""")
def _(t):
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    changed = s.filter("s_suppkey % 100 <> 90").withColumn(
        "s_name", F.when(F.col("s_suppkey") % 5 == 0, F.lower("s_name")).otherwise(F.col("s_name")))
    return compare.positional_diff(number_rows(s, ["s_suppkey"]), number_rows(changed, ["s_suppkey"]))


@query("C10_positional_orders", """
WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS r, o_orderkey FROM orders),
b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS r, o_orderkey FROM orders WHERE o_orderkey % 5000 <> 4999)
SELECT coalesce(a.r, b.r) AS row_number, CASE WHEN b.r IS NULL THEN 'only_in_left' ELSE 'value_difference' END AS diff_type
FROM a LEFT JOIN b ON a.r = b.r WHERE b.r IS NULL OR a.o_orderkey <> b.o_orderkey""")
def _(t):
    k = t.orders.select("o_orderkey")
    d = compare.positional_diff(number_rows(k, ["o_orderkey"]), number_rows(k.filter("o_orderkey % 5000 <> 4999"), ["o_orderkey"]))
    return d.select("row_number", "diff_type")


@query("C11_compare_tables", f"""{SIDES_SQL}, s AS ({SUMMARY_SQL}) SELECT only_in_left, only_in_right, rows_with_differences,
 CASE WHEN only_in_left + only_in_right + rows_with_differences = 0 THEN 'passed' ELSE 'failed' END AS status FROM s""")
def _(t):
    s = compare.compare_status(compare.compare_summary(*sides(t), KEYS))
    return s.select("only_in_left", "only_in_right", "rows_with_differences", "status")


REGRESSION_SQL = f"""{SIDES_SQL}, s AS ({SUMMARY_SQL}), n AS (SELECT 'orders' AS target, only_in_left, only_in_right, rows_with_differences FROM s
 UNION ALL SELECT 'part', (SELECT count(*) FROM part x ANTI JOIN part y USING (p_partkey)), (SELECT count(*) FROM part y ANTI JOIN part x USING (p_partkey)),
  (SELECT count(*) FROM part x JOIN part y USING (p_partkey) WHERE (x.p_name, x.p_brand, x.p_type, x.p_size, x.p_retailprice) IS DISTINCT FROM (y.p_name, y.p_brand, y.p_type, y.p_size, y.p_retailprice)))
SELECT *, CASE WHEN only_in_left + only_in_right + rows_with_differences = 0 THEN 'passed' ELSE 'failed' END AS status FROM n"""


@query("C14_baseline_regression", REGRESSION_SQL)
def _(t):
    a, b = sides(t)
    out = compare.baseline_regression([("orders", a, b, KEYS), ("part", t.part, t.part, ["p_partkey"])])
    return out.select("target", "only_in_left", "only_in_right", "rows_with_differences", "status")


# ----------------------------------------------------------- thresholds N09-N13
def limit_sql(metric, value, limit):
    mv, mr, wv, wr = limit.max_value, limit.max_ratio, limit.warning_value, limit.warning_ratio
    return f"""SELECT '{metric}' AS metric, {value} AS value, round(({value} / total_rows_left)::DOUBLE, 6) AS ratio,
 CASE WHEN {value} > {mv} OR {value} / total_rows_left > {mr} THEN 'fail' WHEN {value} > {wv} OR {value} / total_rows_left > {wr} THEN 'warning' ELSE 'pass' END AS result FROM s"""


LIMITS = (
    gates.Limit("missing_rows", 1_000_000, 0.5, 5, 0.005),
    gates.Limit("extra_rows", 10, 0.01, 5, 0.005),
    gates.Limit("different_rows", 1_000_000, 0.5, 1_000_000, 0.4),
)


@query("N09_compare_thresholds", f"{SIDES_SQL}, s AS ({SUMMARY_SQL}) " + union_all(
    limit_sql("missing_rows", "only_in_left", LIMITS[0]), limit_sql("extra_rows", "only_in_right", LIMITS[1]),
    limit_sql("different_rows", "rows_with_differences", LIMITS[2])))
def _(t):
    return gates.compare_thresholds(compare.compare_summary(*sides(t), KEYS), LIMITS).select("metric", "value", "ratio", "result")


@query("N09_threshold_verdict", f"""{SIDES_SQL}, s AS ({SUMMARY_SQL}), r AS ({union_all(
    limit_sql("missing_rows", "only_in_left", LIMITS[0]), limit_sql("different_rows", "rows_with_differences", LIMITS[2]))})
SELECT CASE WHEN count(*) FILTER (result = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (result = 'warning') > 0 THEN 'warning' ELSE 'pass' END AS overall_result FROM r""")
def _(t):
    return gates.threshold_verdict(gates.compare_thresholds(compare.compare_summary(*sides(t), KEYS), (LIMITS[0], LIMITS[2])))


@query("N10_suite_thresholds", f"""{SIDES_SQL}, s AS ({SUMMARY_SQL})
SELECT concat_ws(';', CASE WHEN only_in_left > 5 THEN 'missing_rows' END, CASE WHEN only_in_right > 100000 THEN 'extra_rows' END,
  CASE WHEN rows_with_differences * 100.0 / greatest(total_rows_left, 1) > 1.0 THEN 'different_rows_pct' END) AS failures,
  CASE WHEN only_in_left > 5 OR only_in_right > 100000 OR rows_with_differences * 100.0 / greatest(total_rows_left, 1) > 1.0 THEN 'FAIL' ELSE 'PASS' END AS status FROM s""")
def _(t):
    s = compare.compare_summary(*sides(t), KEYS)
    return gates.suite_thresholds(s, max_missing_rows=5, max_extra_rows=100000, max_different_rows_pct=1.0).select("failures", "status")


@query("N11_gate_thresholds", """
WITH e AS (SELECT (SELECT count(*) FROM customer) AS total_rows, (SELECT count(*) FROM customer WHERE NOT c_acctbal > 0) AS error_count)
SELECT total_rows, error_count, total_rows >= 100 AND error_count * 100.0 / total_rows <= 8.0 AS within_limits FROM e""")
def _(t):
    v = validate(t.customer, [FieldRule("acct_positive", "c_acctbal", ">", value=0)], "c_custkey")
    out = gates.gate_thresholds(prof.validation_summary(t.customer, v), max_error_pct=8.0, min_rows=100)
    return out.select("total_rows", "error_count", "within_limits")


@query("N12_gate_status", """
WITH st AS (SELECT o_custkey AS pipeline, CAST(o_orderkey % 4 AS BIGINT) AS gate_order, 'gate' || CAST(o_orderkey % 4 AS VARCHAR) AS gate,
  o_orderkey % 4 = 1 AS blocking, o_totalprice < 400000 AS passed FROM orders),
g AS (SELECT pipeline, gate_order, gate, bool_and(passed) AS ok, bool_or(blocking) AS blocking FROM st GROUP BY ALL),
c AS (SELECT pipeline, min(CASE WHEN NOT ok AND blocking THEN gate_order END) AS cut, bool_and(ok) AS all_ok FROM g GROUP BY pipeline)
SELECT pipeline, gate_order, gate, CASE WHEN cut IS NOT NULL AND gate_order > cut THEN 'not_run' WHEN ok THEN 'passed' ELSE 'failed' END AS gate_status,
  CASE WHEN all_ok THEN 'passed' ELSE 'failed' END AS pipeline_status FROM g JOIN c USING (pipeline)""")
def _(t):
    k = F.col("o_orderkey")
    steps = t.orders.select(
        F.col("o_custkey").alias("pipeline"), (k % 4).alias("gate_order"), F.concat(F.lit("gate"), (k % 4).cast("string")).alias("gate"),
        (k % 4 == 1).alias("blocking"), (F.col("o_totalprice") < 400000).alias("passed"))
    return gates.gate_status(steps)


@query("N13_overall_status", """
WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'FAIL' WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'SKIPPED' ELSE 'PASS' END AS status FROM orders)
SELECT o_custkey, CASE WHEN count(*) FILTER (status IN ('PASS','SKIPPED')) = 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'FAIL') = 0 THEN 'PASS' ELSE 'PARTIAL' END AS overall_status FROM s GROUP BY o_custkey""")
def _(t):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    status = F.when((s == "F") & (p > 300000), "FAIL").when((s == "P") & (p > 300000), "SKIPPED").otherwise("PASS")
    return gates.overall_status(t.orders.select("o_custkey", status.alias("status")), ["o_custkey"])
