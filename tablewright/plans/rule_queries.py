"""Queries for scopes (W), field rules (F), cross-field rules (X) and cross-row rules (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import profile
from tablewright.operators.rules import (
    CrossFieldRule,
    FieldRule,
    GroupRule,
    rule_statistics,
    validate,
    when_compares,
    when_differs,
    when_equals,
    when_in,
)
from tablewright.plans.registry import query
from tablewright.plans.sqltext import union_all, violation_sql

LINE = "l_orderkey * 10 + l_linenumber"


def line_id():
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


# ---------------------------------------------------------- pricing (flagship)
PRICING_RULES = [
    FieldRule("discount_range", "l_discount", "range", min=0, max=0.08),
    FieldRule("quantity_cap", "l_quantity", "<", value=50),
    FieldRule("return_flag", "l_returnflag", "in", values=("A", "N")),
    CrossFieldRule("discount_over_tax", ">=", left="l_discount", right="l_tax"),
]

PRICING_SQL = union_all(
    violation_sql("discount_range", LINE, "l_discount", "CAST(l_discount AS VARCHAR)", "lineitem",
                  "NOT coalesce(l_discount >= 0 AND l_discount <= 0.08, false)"),
    violation_sql("quantity_cap", LINE, "l_quantity", "CAST(l_quantity AS VARCHAR)", "lineitem",
                  "NOT coalesce(l_quantity < 50, false)", "50"),
    violation_sql("return_flag", LINE, "l_returnflag", "l_returnflag", "lineitem",
                  "NOT coalesce(trim(l_returnflag) IN ('A','N'), false)", "A,N"),
    violation_sql("discount_over_tax", LINE, "l_discount, l_tax",
                  "CAST(l_discount AS VARCHAR) || ' vs ' || CAST(l_tax AS VARCHAR)", "lineitem",
                  "NOT coalesce(l_discount >= l_tax, false)", "l_discount >= l_tax",
                  "BR_DISCOUNT_OVER_TAX_CROSS"),
)


@query("rules_pricing", PRICING_SQL)
def _(t):
    return validate(t.lineitem, PRICING_RULES, line_id())


@query("W05_rule_statistics", """
WITH c AS (SELECT c_custkey, 'acct_positive' AS rule_id, 'error' AS severity FROM customer WHERE NOT coalesce(c_acctbal > 0, false)
  UNION ALL SELECT c_custkey, 'segment_known', 'warning' FROM customer
    WHERE NOT coalesce(trim(c_mktsegment) IN ('BUILDING','MACHINERY','AUTOMOBILE'), false))
SELECT rule_id, severity, count(*) AS violations,
  round(((SELECT count(*) FROM customer) - (SELECT count(DISTINCT c_custkey) FROM c)) * 100.0
        / (SELECT count(*) FROM customer), 2)::DOUBLE AS compliance_rate
FROM c GROUP BY rule_id, severity""")
def _(t):
    rules = [
        FieldRule("acct_positive", "c_acctbal", ">", value=0),
        FieldRule("segment_known", "c_mktsegment", "in", values=("BUILDING", "MACHINERY", "AUTOMOBILE"), severity="warning"),
        FieldRule("never", "c_name", "not_null", enabled=False),
    ]
    return rule_statistics(t.customer, validate(t.customer, rules, "c_custkey"))


# ------------------------------------------------------------------- scopes
def scope_query(name, table, row, rule, value_sql, bad_sql, expected):
    @query(name, violation_sql(rule.id, row, rule.field, value_sql, table, bad_sql, expected))
    def _(t, table=table, row=row, rule=rule):
        return validate(getattr(t, table), [rule], row)


scope_query("W01_when_equals", "orders", "o_orderkey",
            FieldRule("open_small", "o_totalprice", "<", value=300000, when=when_equals("o_orderstatus", "O")),
            "CAST(o_totalprice AS VARCHAR)", "o_orderstatus = 'O' AND NOT coalesce(o_totalprice < 300000, false)", "300000")
scope_query("W02_when_differs", "orders", "o_orderkey",
            FieldRule("other_small", "o_totalprice", "<", value=300000, when=when_differs("o_orderstatus", "O")),
            "CAST(o_totalprice AS VARCHAR)", "o_orderstatus <> 'O' AND NOT coalesce(o_totalprice < 300000, false)", "300000")
scope_query("W03_when_compares", "customer", "c_custkey",
            FieldRule("rich_segment", "c_mktsegment", "in", values=("BUILDING",), when=when_compares("c_acctbal", ">=", "5000")),
            "c_mktsegment", "c_acctbal >= 5000 AND c_mktsegment <> 'BUILDING'", "BUILDING")
scope_query("W04_when_in", "orders", "o_orderkey",
            FieldRule("urgent_cap", "o_totalprice", "<=", value=200000,
                      when=when_in("o_orderpriority", ["1-URGENT", "2-HIGH"])),
            "CAST(o_totalprice AS VARCHAR)",
            "o_orderpriority IN ('1-URGENT','2-HIGH') AND NOT coalesce(o_totalprice <= 200000, false)", "200000")

# -------------------------------------------------------------- field rules
# Customer text with every kind of awkward value: null, blank, not a number.
CUSTOMER_TEXT_SQL = """(SELECT c_custkey, c_nationkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN ''
  WHEN c_custkey % 10 = 2 THEN '   ' WHEN c_custkey % 10 = 3 THEN 'abc' WHEN c_custkey % 10 = 4 THEN ' ' || CAST(c_nationkey AS VARCHAR) || ' '
  ELSE CAST(c_nationkey AS VARCHAR) END AS code FROM customer) AS ct"""


def customer_text(t):
    m = F.col("c_custkey") % 10
    nation = F.col("c_nationkey").cast("string")
    return t.customer.select(
        "c_custkey", "c_nationkey", "c_name",
        F.when(m == 0, None).when(m == 1, "").when(m == 2, "   ").when(m == 3, "abc")
        .when(m == 4, F.concat(F.lit(" "), nation, F.lit(" "))).otherwise(nation).alias("code"),
    )


def text_rule_query(name, rule, bad_sql, expected):
    @query(name, violation_sql(rule.id, "c_custkey", rule.field, rule.field, CUSTOMER_TEXT_SQL, bad_sql, expected))
    def _(t, rule=rule):
        return validate(customer_text(t), [rule], "c_custkey")


NUM = "try_cast(trim(code) AS DOUBLE)"
for _name, _op in [("F01_num_gt", ">"), ("F02_num_lt", "<"), ("F03_num_ge", ">="), ("F04_num_le", "<="), ("F05_num_eq", "==")]:
    text_rule_query(_name, FieldRule("num", "code", _op, value=12), f"NOT coalesce({NUM} {_op.replace('==', '=')} 12, false)", "12")
text_rule_query("F06_num_ne", FieldRule("num", "code", "!=", value=12), f"coalesce({NUM} = 12, false)", "12")
text_rule_query("F07_in", FieldRule("listed", "code", "in", values=("1", " 2 ", "3")),
                "NOT coalesce(trim(code) IN ('1','2','3'), false)", "1,2,3")
text_rule_query("F07b_not_in", FieldRule("unlisted", "code", "not_in", values=("1", "2", "3")),
                "coalesce(trim(code) IN ('1','2','3'), false)", "1,2,3")
text_rule_query("F08_range", FieldRule("between", "code", "range", min=3, max=20),
                f"NOT coalesce({NUM} BETWEEN 3 AND 20, false)", None)
text_rule_query("F08_range_open", FieldRule("at_least", "code", "range", min=3), f"NOT coalesce({NUM} >= 3, false)", None)
text_rule_query("F09_regex", FieldRule("digits", "code", "regex", pattern="[0-9]+$"),
                "NOT coalesce(regexp_matches(trim(code), '^(?:[0-9]+$)'), false)", "[0-9]+$")
text_rule_query("F09_regex_name", FieldRule("name_shape", "c_name", "regex", pattern="Customer#0+[1-9]{3}"),
                "NOT coalesce(regexp_matches(trim(c_name), '^(?:Customer#0+[1-9]{3})'), false)", "Customer#0+[1-9]{3}")
text_rule_query("F10_not_null", FieldRule("filled", "code", "not_null"), "code IS NULL OR trim(code) = ''", None)
text_rule_query("F11_length", FieldRule("len", "code", "length", min=1, max=2),
                "coalesce(length(code), 0) < 1 OR coalesce(length(code), 0) > 2", None)
text_rule_query("F12_numeric", FieldRule("is_number", "code", "numeric"), f"trim(code) <> '' AND {NUM} IS NULL", None)
text_rule_query("F14_valid_values", FieldRule("listed", "code", "valid_values", values=("7", "8", "9")),
                "NOT coalesce(trim(code) IN ('7','8','9'), false)", "7,8,9")
text_rule_query("F15_min_value", FieldRule("floor", "code", "min_value", value=5), f"NOT coalesce({NUM} >= 5, false)", "5")
text_rule_query("F16_max_value", FieldRule("ceiling", "code", "max_value", value=5), f"NOT coalesce({NUM} <= 5, false)", "5")
text_rule_query("F17_exact_length", FieldRule("two", "code", "exact_length", value=2), "coalesce(length(code), 0) <> 2", "2")
text_rule_query("F18_min_length", FieldRule("two_up", "code", "min_length", value=2), "coalesce(length(code), 0) < 2", "2")
text_rule_query("F18_max_length", FieldRule("two_down", "code", "max_length", value=2), "coalesce(length(code), 0) > 2", "2")
text_rule_query("F19_not_empty", FieldRule("filled", "code", "not_empty"), "code IS NULL OR trim(code) = ''", None)

# Order dates as text, with month 13, non-digits and blanks mixed in.
ORDER_DATES_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y') || '1340'
  WHEN o_orderkey % 11 = 1 THEN '2020-1-1' WHEN o_orderkey % 11 = 2 THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END AS odate
  FROM orders) AS od"""


def order_dates(t):
    m = F.col("o_orderkey") % 11
    return t.orders.select(
        "o_orderkey",
        F.when(m == 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("1340"))).when(m == 1, "2020-1-1").when(m == 2, "")
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("odate"),
    )


@query("F13_date_format", violation_sql(
    "order_day", "o_orderkey", "odate", "odate", ORDER_DATES_SQL,
    "odate <> '' AND NOT (regexp_matches(odate, '^[0-9]{8}$') AND try_strptime(odate, '%Y%m%d') IS NOT NULL)", "CCYYMMDD"))
def _(t):
    return validate(order_dates(t), [FieldRule("order_day", "odate", "date_format", value="CCYYMMDD")], "o_orderkey")


@query("F13_date_digits", violation_sql(
    "order_day", "o_orderkey", "odate", "odate", ORDER_DATES_SQL,
    "odate <> '' AND NOT regexp_matches(odate, '^[0-9]{8}$')", "CCYYMMDD"))
def _(t):
    rule = FieldRule("order_day", "odate", "date_format", value="CCYYMMDD", pattern="digits")
    return validate(order_dates(t), [rule], "o_orderkey")


# Event properties as text: {"k": 69} gives '69'; every seventh is decimal.
EVENT_K_SQL = """(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST(value AS VARCHAR) WHEN event_id % 7 = 1 THEN event_type
  ELSE regexp_extract(props, '([0-9]+)', 1) END AS k FROM events) AS ev"""


def event_k(t):
    m = F.col("event_id") % 7
    return t.events.select(
        "event_id",
        F.when(m == 0, F.col("value").cast("string")).when(m == 1, F.col("event_type"))
        .otherwise(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"),
    )


def typed_rule(check):
    code = "DT_INT_001" if check == "integer" else "DT_FLT_001"
    return FieldRule("typed", "k", check, issue_code=code)


@query("F20_dt_integer", violation_sql("typed", "event_id", "k", "k", EVENT_K_SQL,
                                       "trim(k) <> '' AND NOT regexp_matches(trim(k), '^[+-]?[0-9]+$')", None, "DT_INT_001"))
def _(t):
    return validate(event_k(t), [typed_rule("integer")], "event_id")


@query("F21_dt_float", violation_sql("typed", "event_id", "k", "k", EVENT_K_SQL,
                                     "trim(k) <> '' AND try_cast(trim(k) AS DOUBLE) IS NULL", None, "DT_FLT_001"))
def _(t):
    return validate(event_k(t), [typed_rule("float")], "event_id")


@query("F22_mapping_rule_counts", f"""
SELECT column_name, rule_type, violations FROM (
  SELECT 'code' AS column_name, 'not_null' AS rule_type, count(*) FILTER (code IS NULL) AS violations FROM {CUSTOMER_TEXT_SQL}
  UNION ALL SELECT 'code', 'min_length', count(*) FILTER (length(code) < 2) FROM {CUSTOMER_TEXT_SQL}
  UNION ALL SELECT 'code', 'max_length', count(*) FILTER (length(code) > 2) FROM {CUSTOMER_TEXT_SQL}
  UNION ALL SELECT 'code', 'regex', count(*) FILTER (NOT coalesce(regexp_matches(code, '^(?:[0-9]+$)'), false)) FROM {CUSTOMER_TEXT_SQL}
  UNION ALL SELECT 'code', 'range', count(*) FILTER ({NUM} < 3 OR {NUM} > 20) FROM {CUSTOMER_TEXT_SQL}
  UNION ALL SELECT 'code', 'in_list', count(*) FILTER (code IS NOT NULL AND code NOT IN ('1','2','3')) FROM {CUSTOMER_TEXT_SQL})""")
def _(t):
    return profile.mapping_rule_counts(
        customer_text(t),
        [
            ("code", "not_null", {}),
            ("code", "min_length", {"length": 2}),
            ("code", "max_length", {"length": 2}),
            ("code", "regex", {"pattern": "[0-9]+$"}),
            ("code", "range", {"min": 3, "max": 20}),
            ("code", "in_list", {"values": ["1", "2", "3"]}),
        ],
    )


@query("F23_required_empty", """
SELECT 'code' AS field, count(*) FILTER (code IS NULL OR trim(code) = '') AS empty_rows, count(*) AS total_rows FROM """ + CUSTOMER_TEXT_SQL + """
UNION ALL SELECT 'c_name', count(*) FILTER (c_name IS NULL OR trim(c_name) = ''), count(*) FROM """ + CUSTOMER_TEXT_SQL)
def _(t):
    return profile.required_empty_totals(customer_text(t), ["code", "c_name"])


# -------------------------------------------------------------- cross field
CMP_SQL = """(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_totalprice
  ELSE o_totalprice + (o_orderkey % 7) - 3 END AS other FROM orders) AS op"""


def order_pairs(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", "o_totalprice",
        F.when(k % 13 == 0, None).when(k % 3 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + (k % 7) - 3).alias("other"),
    )


for _name, _op in [("X01_gt", ">"), ("X02_lt", "<"), ("X03_ge", ">="), ("X04_le", "<="), ("X05_eq", "=="), ("X06_ne", "!=")]:
    _sql_op = {"==": "=", "!=": "<>"}.get(_op, _op)
    _default = "true" if _op == "!=" else "false"

    @query(_name, f"SELECT CAST(o_orderkey AS BIGINT) AS row_number, 'o_totalprice, other' AS field FROM {CMP_SQL} "
                  f"WHERE NOT coalesce(o_totalprice {_sql_op} other, {_default})")
    def _(t, op=_op):
        rule = CrossFieldRule("pair", op, left="o_totalprice", right="other")
        return validate(order_pairs(t), [rule], "o_orderkey").select("row_number", "field")


@query("X01_date_order", """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_number, CAST(l_shipdate AS VARCHAR) || ' vs ' || CAST(o_orderdate AS VARCHAR) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT coalesce(l_shipdate >= o_orderdate, false)""")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rule = CrossFieldRule("ship_after_order", ">=", left="l_shipdate", right="o_orderdate", compare_as="date")
    return validate(rows, [rule], line_id()).select("row_number", "value")


@query("X07_depends_on", """
SELECT CAST(d.doc_id AS BIGINT) AS row_number, 'quality, lang' AS field FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.lang IS NOT NULL AND trim(d.lang) <> '' AND l.quality IS NULL""")
def _(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    rule = CrossFieldRule("label_needed", "depends_on", left="quality", right="lang")
    return validate(rows, [rule], "doc_id").select("row_number", "field")


@query("X08_mutually_exclusive", """
SELECT CAST(o_orderkey AS BIGINT) AS row_number, 'a, b, c' AS field FROM orders
WHERE (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)
    + (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) > 1""")
def _(t):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", *[F.when(k % n == 0, F.col("o_orderstatus")).alias(c) for c, n in (("a", 2), ("b", 3), ("c", 5))])
    return validate(rows, [CrossFieldRule("one_of", "mutually_exclusive", fields=("a", "b", "c"))], "o_orderkey").select("row_number", "field")


@query("X09_if_then", violation_sql(
    "finished_rule", "o_orderkey", "o_totalprice", "CAST(o_totalprice AS VARCHAR)", "orders",
    "o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT') AND NOT coalesce(o_totalprice BETWEEN 1000 AND 400000, false)"))
def _(t):
    scope = when_equals("o_orderstatus", "F") & when_in("o_orderpriority", ["1-URGENT"])
    return validate(t.orders, [FieldRule("finished_rule", "o_totalprice", "range", min=1000, max=400000, when=scope)], "o_orderkey")


# ---------------------------------------------------------------- cross row
def group_sql(rule_id, row, field, value, source, message, bad):
    return violation_sql(rule_id, row, field, value, source, bad, None, f"BR_{rule_id.upper()}_CROSS", message)


LI = "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)"


@query("R01_unique", group_sql(
    "uniq", LINE, "l_orderkey", "CAST(l_orderkey AS VARCHAR)",
    "(SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_orderkey IS NOT NULL) g",
    "'uniq: more than one row has l_orderkey = ' || CAST(l_orderkey AS VARCHAR)", "n > 1"))
def _(t):
    return validate(t.lineitem, [GroupRule("uniq", "unique", ("l_orderkey",))], line_id())


@query("R02_unique_composite", group_sql(
    "uniq2", LINE, "l_orderkey, flag", "coalesce(CAST(l_orderkey AS VARCHAR), 'null') || ', ' || coalesce(flag, 'null')",
    """(SELECT *, count(*) OVER (PARTITION BY l_orderkey, flag) AS n FROM
       (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS flag FROM lineitem)) g""",
    "'uniq2: more than one row has (' || coalesce(CAST(l_orderkey AS VARCHAR), 'null') || ', ' || coalesce(flag, 'null') || ')'", "n > 1"))
def _(t):
    rows = t.lineitem.withColumn("flag", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")))
    return validate(rows, [GroupRule("uniq2", "unique_composite", ("l_orderkey", "flag"))], line_id())


@query("R03_consistent", group_sql(
    "same_flag", LINE, "l_returnflag", "l_returnflag",
    "(SELECT *, count(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) g",
    "'same_flag: rows with l_orderkey = ' || CAST(l_orderkey AS VARCHAR) || ' disagree on l_returnflag'", "n > 1"))
def _(t):
    return validate(t.lineitem, [GroupRule("same_flag", "consistent", ("l_orderkey",), target="l_returnflag")], line_id())


@query("R04_sequential", """
WITH k AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi
           FROM lineitem GROUP BY l_orderkey)
SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS row_number, CAST(l.l_linenumber AS VARCHAR) AS value
FROM lineitem l JOIN k ON l.l_orderkey = k.l_orderkey WHERE NOT (d = n AND lo = 1 AND hi = n)""")
def _(t):
    rule = GroupRule("seq", "sequential", ("l_orderkey",), target="l_linenumber")
    return validate(t.lineitem, [rule], line_id()).select("row_number", "value")


@query("R04_sequential_turns", """
WITH c AS (SELECT conv_id, turn + 1 AS seq FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 0)),
k AS (SELECT conv_id, count(*) AS n, count(DISTINCT seq) AS d, min(seq) AS lo, max(seq) AS hi FROM c GROUP BY conv_id)
SELECT CAST(c.conv_id AS BIGINT) AS row_number, CAST(c.seq AS VARCHAR) AS value FROM c JOIN k USING (conv_id) WHERE NOT (d = n AND lo = 1 AND hi = n)""")
def _(t):
    rows = t.conversations.filter("NOT (conv_id % 7 = 0 AND turn = 0)").select("conv_id", (F.col("turn") + 1).alias("seq"))
    rule = GroupRule("seq", "sequential", ("conv_id",), target="seq")
    return validate(rows, [rule], "conv_id").select("row_number", "value")


@query("R05_group_count", """
WITH c AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 5 = 0 THEN '3' ELSE CAST(turn + 1 AS VARCHAR) END AS declared FROM conversations),
k AS (SELECT conv_id, count(*) AS n, arg_min(CAST(declared AS BIGINT), turn) FILTER (declared IS NOT NULL) AS v FROM c GROUP BY conv_id)
SELECT CAST(c.conv_id * 100 + c.turn AS BIGINT) AS row_number, c.declared AS value,
  'cnt: conv_id = ' || CAST(c.conv_id AS VARCHAR) || ' has ' || CAST(n AS VARCHAR) || ' rows and declares ' || CAST(v AS VARCHAR) AS message
FROM c JOIN k USING (conv_id) WHERE v <> n""")
def _(t):
    declared = F.when(F.col("turn") == 0, None).when(F.col("conv_id") % 5 == 0, "3").otherwise((F.col("turn") + 1).cast("string"))
    rows = t.conversations.select("conv_id", "turn", declared.alias("declared"))
    rule = GroupRule("cnt", "group_count", ("conv_id",), target="declared")
    return validate(rows, [rule], F.col("conv_id") * 100 + F.col("turn")).select("row_number", "value", "message")


@query("R06_group_sum", """
WITH k AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(30,2))) AS s FROM lineitem GROUP BY l_orderkey)
SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS row_number, CAST(l.l_quantity AS VARCHAR) AS value,
  'total: l_quantity adds up to ' || CAST(s AS VARCHAR) || ' where l_orderkey = ' || CAST(l.l_orderkey AS VARCHAR) || ', outside [20, 200]' AS message
FROM lineitem l JOIN k USING (l_orderkey) WHERE s < 20 OR s > 200""")
def _(t):
    rule = GroupRule("total", "group_sum", ("l_orderkey",), target="l_quantity", min=20, max=200, scale=2)
    return validate(t.lineitem, [rule], line_id()).select("row_number", "value", "message")


@query("R_shared_key", """
WITH k AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus) AS d, sum(CAST(l_quantity AS DECIMAL(30,2))) AS s FROM lineitem GROUP BY l_orderkey)
SELECT rule_id, count(*) AS violations FROM (
  SELECT 'uniq' AS rule_id FROM lineitem JOIN k USING (l_orderkey) WHERE n > 1
  UNION ALL SELECT 'same_status' FROM lineitem JOIN k USING (l_orderkey) WHERE d > 1
  UNION ALL SELECT 'total' FROM lineitem JOIN k USING (l_orderkey) WHERE s < 20 OR s > 200) GROUP BY rule_id""")
def _(t):
    rules = [
        GroupRule("uniq", "unique", ("l_orderkey",)),
        GroupRule("same_status", "consistent", ("l_orderkey",), target="l_linestatus"),
        GroupRule("total", "group_sum", ("l_orderkey",), target="l_quantity", min=20, max=200, scale=2),
    ]
    return validate(t.lineitem, rules, line_id()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("violations"))


@query("R07_duplicate_rows", """
SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1
ORDER BY copies DESC, l_orderkey, l_linenumber, l_returnflag LIMIT 10""")
def _(t):
    return profile.top_duplicates(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), 10)
