"""Larger queries that exercise several operators at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import compare
from tablewright.operators.rules import CrossFieldRule, FieldRule, GroupRule, validate, when_equals
from tablewright.plans.registry import query
from tablewright.plans.rule_queries import line_id
from tablewright.plans.sqltext import union_all

TEN_RULES = [
    FieldRule("quantity_range", "l_quantity", "range", min=1, max=45),
    FieldRule("price_floor", "l_extendedprice", ">=", value=2000),
    FieldRule("discount_cap", "l_discount", "<=", value=0.09),
    FieldRule("tax_cap", "l_tax", "<", value=0.08),
    FieldRule("flag_known", "l_returnflag", "in", values=("A", "N", "R")),
    FieldRule("status_open", "l_linestatus", "not_in", values=("X",)),
    FieldRule("line_small", "l_linenumber", "range", min=1, max=6),
    FieldRule("part_shape", "l_partkey", "regex", pattern="[0-9]{1,5}$"),
    CrossFieldRule("discount_over_tax", ">=", left="l_discount", right="l_tax"),
    FieldRule("returned_price", "l_extendedprice", "<", value=90000, when=when_equals("l_returnflag", "R")),
]
TEN_BAD = {
    "quantity_range": "NOT l_quantity BETWEEN 1 AND 45", "price_floor": "NOT l_extendedprice >= 2000", "discount_cap": "NOT l_discount <= 0.09",
    "tax_cap": "NOT l_tax < 0.08", "flag_known": "l_returnflag NOT IN ('A','N','R')", "status_open": "l_linestatus = 'X'",
    "line_small": "NOT l_linenumber BETWEEN 1 AND 6", "part_shape": "NOT regexp_matches(CAST(l_partkey AS VARCHAR), '^(?:[0-9]{1,5}$)')",
    "discount_over_tax": "NOT l_discount >= l_tax", "returned_price": "l_returnflag = 'R' AND NOT l_extendedprice < 90000",
}


@query("bench_ten_field_rules", "SELECT rule_id, count(*) AS violations FROM (" + union_all(*[
    f"SELECT '{k}' AS rule_id FROM lineitem WHERE {bad}" for k, bad in TEN_BAD.items()]) + ") GROUP BY rule_id")
def _(t):
    return validate(t.lineitem, TEN_RULES, line_id()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("violations"))


@query("bench_keyed_rules", """SELECT rule_id, count(*) AS violations FROM (
 SELECT 'same_line' AS rule_id FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) USING (l_orderkey, l_linenumber)
 UNION ALL SELECT 'total' FROM lineitem JOIN (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING sum(CAST(l_extendedprice AS DECIMAL(30,2))) > 400000) USING (l_orderkey)) GROUP BY rule_id""")
def _(t):
    rules = [
        GroupRule("same_line", "unique_composite", ("l_orderkey", "l_linenumber")),
        GroupRule("total", "group_sum", ("l_orderkey",), target="l_extendedprice", max=400000, scale=2),
    ]
    return validate(t.lineitem, rules, line_id()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("violations"))


@query("bench_lineitem_diff", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey % 97 <> 0)
SELECT (SELECT count(*) FROM lineitem) AS total_rows_left, (SELECT count(*) FROM b) AS total_rows_right,
 (SELECT count(*) FROM lineitem a ANTI JOIN b USING (l_orderkey, l_linenumber)) AS only_in_left,
 (SELECT count(*) FROM lineitem a JOIN b USING (l_orderkey, l_linenumber) WHERE a.l_partkey <> b.l_partkey OR a.l_suppkey <> b.l_suppkey OR a.l_quantity <> b.l_quantity OR a.l_extendedprice <> b.l_extendedprice) AS rows_with_differences""")
def _(t):
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    changed = F.when(F.col("l_suppkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    right = left.filter("l_orderkey % 97 <> 0").withColumn("l_quantity", changed)
    s = compare.compare_summary(left, right, ["l_orderkey", "l_linenumber"])
    return s.select("total_rows_left", "total_rows_right", "only_in_left", "rows_with_differences")


@query("bench_lineitem_diff_details", """
WITH j AS (SELECT a.l_quantity <> b.l_quantity AS quantity, a.l_tax <> b.l_tax AS tax FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_tax, CASE WHEN l_suppkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity
 FROM lineitem WHERE l_orderkey % 97 <> 0) b USING (l_orderkey, l_linenumber))
SELECT 'l_quantity' AS field, count(*) FILTER (quantity) AS differences FROM j HAVING count(*) FILTER (quantity) > 0
UNION ALL SELECT 'l_tax', count(*) FILTER (tax) FROM j HAVING count(*) FILTER (tax) > 0""")
def _(t):
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    changed = F.when(F.col("l_suppkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    right = t.lineitem.filter("l_orderkey % 97 <> 0").select("l_orderkey", "l_linenumber", changed.alias("l_quantity"), "l_tax")
    stats = compare.field_difference_stats(compare.keyed_diff(left, right, ["l_orderkey", "l_linenumber"]))
    return stats.groupBy("field").agg(F.sum("differences").alias("differences"))
