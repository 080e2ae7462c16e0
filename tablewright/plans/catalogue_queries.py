"""Queries for schema checks (H), contracts (N01-N08) and column lists (P02, E01).

The catalogue holds one dataset per line of a document: its words are the
columns, as if the line were the header of a file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tablewright.operators import catalogue as cat
from tablewright.operators import expectations as ex
from tablewright.plans.registry import query
from tablewright.plans.sqltext import union_all, upper_sql

CAT_SQL = """WITH cat AS (SELECT dataset, column_name, CAST(min(i) AS INTEGER) AS ordinal,
 CASE length(column_name) % 4 WHEN 0 THEN 'VARCHAR2' WHEN 1 THEN 'NUMBER' WHEN 2 THEN 'DATE' ELSE 'CLOB' END AS type, min(i) % 3 <> 0 AS nullable
 FROM (SELECT dataset, unnest(string_split(content, ' ')) AS column_name, generate_subscripts(string_split(content, ' '), 1) AS i
  FROM (SELECT doc_id * 100000 + generate_subscripts(string_split(text, chr(10)), 1) AS dataset, unnest(string_split(text, chr(10))) AS content FROM documents)) WHERE column_name <> '' GROUP BY dataset, column_name),
spec AS (SELECT dataset, column_name, ordinal % 2 = 0 AS required, CASE ordinal % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'number' ELSE 'date' END AS data_type,
  CASE WHEN ordinal % 4 = 0 THEN 'YYYYMMDD HH24' END AS date_format FROM cat WHERE ordinal % 5 <> 0
 UNION ALL SELECT DISTINCT dataset, 'zz_required', true, 'string', NULL FROM cat UNION ALL SELECT DISTINCT dataset, 'zz_optional', false, 'string', NULL FROM cat)"""


def first_places(contents: pa.Array) -> pa.Array:
    """Words of each line, joined by blanks, and the first place of each."""
    names, ordinals = [], []
    for line in contents.to_pylist():
        places: dict[str, int] = {}
        for i, word in enumerate(line.split(" "), 1):
            if word:
                places.setdefault(word, i)
        names.append(" ".join(places))
        ordinals.append(list(places.values()))
    lists = pa.array(names, pa.string()), pa.array(ordinals, pa.list_(pa.int32()))
    return pa.StructArray.from_arrays(lists, ["names", "places"])


def least_places(lists):
    """Words of several lines with their least places: those of equal words stand together once sorted."""
    placed = F.sort_array(F.flatten(F.transform(lists, lambda l: F.arrays_zip(F.split(l["names"], " ").alias("column_name"), l["places"].alias("ordinal")))))
    before = F.concat(F.array(F.lit(None)), F.slice(placed, 1, F.size(placed) - 1))
    return F.filter(F.zip_with(placed, before, lambda p, b: F.when(b.isNull() | (p["column_name"] != b["column_name"]), p)), lambda p: p.isNotNull())


def catalogue(t):
    """Packed: lines meet by their dataset with their words as one text.

    Python has its turn before that; built-in functions leave the rows where their
    dataset put them, so checks that join by dataset again shuffle nothing.
    """
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "content")).filter(F.trim("content") != "")
    placed = F.arrow_udf(first_places, "struct<names: string, places: array<int>>")
    lists = lines.select((F.col("doc_id") * 100000 + F.col("n") + 1).alias("dataset"), placed("content").alias("placed")).groupBy("dataset").agg(F.collect_list("placed").alias("lists"))
    one, merged = F.get("lists", F.lit(0)), least_places("lists")
    words = F.when(F.size("lists") == 1, F.struct(F.split(one["names"], " ").alias("column_name"), one["places"].alias("ordinal"))).otherwise(
        F.struct(merged["column_name"].alias("column_name"), merged["ordinal"].alias("ordinal")))
    types = F.array(*[F.lit(k) for k in ("VARCHAR2", "NUMBER", "DATE", "CLOB")])
    return lists.select("dataset", words.alias("words")).select("dataset", "words.*").select(
        "dataset", "column_name", "ordinal",
        F.transform("column_name", lambda n: F.get(types, F.char_length(n) % 4)).alias("type"), F.transform("ordinal", lambda o: o % 3 != 0).alias("nullable"))


def spec(c):
    def listed(name):
        return F.filter(name, lambda _, i: F.get("ordinal", i) % 5 != 0)

    def of_each(value, *added):
        return F.concat(F.transform(listed("ordinal"), value), F.array(*added))

    nothing = F.lit(None).cast("string")
    return c.select(
        "dataset", F.concat(listed("column_name"), F.array(F.lit("zz_required"), F.lit("zz_optional"))).alias("column_name"),
        of_each(lambda o: o % 2 == 0, F.lit(True), F.lit(False)).alias("required"),
        of_each(lambda o: F.when(o % 3 == 0, "string").when(o % 3 == 1, "number").otherwise("date"), F.lit("string"), F.lit("string")).alias("data_type"),
        of_each(lambda o: F.when(o % 4 == 0, "YYYYMMDD HH24"), nothing, nothing).alias("date_format"))


@query("H01_schema_missing", f"{CAT_SQL} SELECT dataset, column_name, 'VAL_SCHEMA_MISSING_FIELD' AS issue_code FROM spec ANTI JOIN cat USING (dataset, column_name)")
def _(t):
    c = catalogue(t)
    return cat.schema_missing(c, spec(c))


@query("H02_schema_unexpected", f"{CAT_SQL} SELECT dataset, column_name, 'VAL_SCHEMA_UNEXPECTED_FIELD' AS issue_code FROM cat ANTI JOIN spec USING (dataset, column_name)")
def _(t):
    c = catalogue(t)
    return cat.schema_unexpected(c, spec(c))


@query("H03_schema_check", f"""{CAT_SQL} SELECT * FROM (SELECT coalesce(c.dataset, s.dataset) AS dataset, coalesce(c.column_name, s.column_name) AS column_name,
 CASE WHEN s.dataset IS NULL THEN 'unexpected' WHEN c.dataset IS NULL AND required THEN 'missing_required' WHEN c.dataset IS NULL THEN 'missing_optional' END AS finding,
 CASE WHEN s.dataset IS NOT NULL AND c.dataset IS NULL AND required THEN 'error' ELSE 'warning' END AS severity
 FROM cat c FULL JOIN spec s ON c.dataset = s.dataset AND c.column_name = s.column_name) WHERE finding IS NOT NULL""")
def _(t):
    c = catalogue(t)
    return cat.schema_check(c, spec(c))


@query("P02_unmapped_columns", f"""{CAT_SQL} SELECT dataset, column_name, 'unmapped_source' AS finding FROM cat ANTI JOIN spec USING (dataset, column_name)
UNION ALL SELECT dataset, column_name, 'missing_in_source' FROM spec ANTI JOIN cat USING (dataset, column_name)""")
def _(t):
    c = catalogue(t)
    return cat.unmapped_columns(c, spec(c))


@query("H04_structure_compatible", f"""{CAT_SQL}, names AS (SELECT dataset, list(column_name ORDER BY ordinal) AS cols FROM cat GROUP BY dataset),
p AS (SELECT a.dataset AS "left", b.dataset AS "right", a.cols AS l, b.cols AS r FROM names a JOIN names b ON b.dataset = a.dataset + 1),
d AS (SELECT "left", "right", len(l) AS nl, len(r) AS nr, list_sort(list_filter(l, lambda x: NOT list_contains(r, x))) AS gone_r, list_sort(list_filter(r, lambda x: NOT list_contains(l, x))) AS gone_l FROM p)
SELECT "left", "right", 'column_count_mismatch' AS finding, CAST(NULL AS VARCHAR) AS in_file, CAST(nl AS VARCHAR) || ' vs ' || CAST(nr AS VARCHAR) AS columns FROM d WHERE nl <> nr
UNION ALL SELECT "left", "right", 'missing_columns', 'right', array_to_string(gone_r, ',') FROM d WHERE nl = nr AND len(gone_r) > 0
UNION ALL SELECT "left", "right", 'missing_columns', 'left', array_to_string(gone_l, ',') FROM d WHERE nl = nr AND len(gone_l) > 0""")
def _(t):
    c = catalogue(t)
    pairs = c.select(F.col("dataset").alias("left"), (F.col("dataset") + 1).alias("right"))
    return cat.structure_compatible(c, pairs)


@query("E01_columns_match_ordered_list", f"""{CAT_SQL}, names AS (SELECT dataset, list(column_name ORDER BY ordinal) AS cols FROM cat GROUP BY dataset),
x AS (SELECT dataset, list(column_name ORDER BY ordinal) AS cols FROM cat WHERE NOT (dataset % 3 = 0 AND ordinal = 2) GROUP BY dataset)
SELECT names.dataset, names.cols = x.cols AS success FROM names JOIN x USING (dataset)""")
def _(t):
    c = catalogue(t)
    kept = F.filter(F.arrays_zip("column_name", "ordinal"), lambda e: ~((F.col("dataset") % 3 == 0) & (e["ordinal"] == 2)))
    some = c.select("dataset", kept.alias("kept")).filter(F.size("kept") > 0).select("dataset", "kept.column_name", "kept.ordinal")
    expected = cat.column_lists(some).withColumnRenamed("columns", "expected")
    return ex.columns_match_ordered_list(c, expected)


@query("N01_contract_columns", f"""{CAT_SQL} SELECT * FROM (SELECT coalesce(c.dataset, s.dataset) AS dataset, coalesce(c.column_name, s.column_name) AS column_name,
 CASE WHEN c.dataset IS NULL AND required THEN 'required_column_absent' WHEN c.dataset IS NULL THEN 'optional_column_absent' WHEN s.dataset IS NULL AND NOT nullable THEN 'not_null_column_unmapped' END AS finding,
 CASE WHEN c.dataset IS NULL AND required THEN 'error' ELSE 'warning' END AS severity
 FROM cat c FULL JOIN spec s ON c.dataset = s.dataset AND c.column_name = s.column_name) WHERE finding IS NOT NULL""")
def _(t):
    c = catalogue(t)
    return cat.contract_columns(c, spec(c))


MATRIX_SQL = " ".join(f"WHEN data_type = '{k}' THEN type IN ({', '.join(repr(v) for v in vs)})" for k, vs in cat.COMPATIBLE_TYPES.items())


@query("N02_contract_types", f"{CAT_SQL} SELECT dataset, column_name, type, data_type FROM cat JOIN spec USING (dataset, column_name) WHERE NOT CASE {MATRIX_SQL} ELSE false END")
def _(t):
    c = catalogue(t)
    return cat.contract_types(c, spec(c))


@query("N03_contract_nullability", f"{CAT_SQL} SELECT dataset, column_name, 'required_but_nullable' AS finding FROM cat JOIN spec USING (dataset, column_name) WHERE nullable AND required")
def _(t):
    c = catalogue(t)
    return cat.contract_nullability(c, spec(c))


@query("N03_observed_nulls", """SELECT 'status' AS column_name, count(*) FILTER (o_orderkey % 9 = 0) AS blank_rows, count(*) FILTER (o_orderkey % 9 = 0) = 0 AS holds FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL), count(*) FILTER (o_orderpriority IS NULL) = 0 FROM orders""")
def _(t):
    rows = t.orders.withColumn("status", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")))
    return cat.observed_nulls(rows, ["status", "o_orderpriority"])


@query("N04_contract_length", union_all(*[
    f"SELECT '{c}' AS column_name, {n} AS declared_length, CAST(max(length({c})) AS INTEGER) AS observed_length, max(length({c})) <= {n} AS holds FROM part"
    for c, n in (("p_name", 8), ("p_brand", 10), ("p_type", 25))]))
def _(t):
    return cat.observed_lengths(t.part, {"p_name": 8, "p_brand": 10, "p_type": 25})


def precision_sql(c: str, p: int, s: int) -> str:
    d = f"CAST(CAST(abs({c}) AS DECIMAL(38,6)) AS VARCHAR)"
    return f"""SELECT '{c}' AS column_name, {p} AS precision, {s} AS scale, CAST(max(greatest(length(ltrim(split_part({d}, '.', 1), '0')), 1)) AS INTEGER) AS digits_before,
 CAST(max(length(rtrim(split_part({d}, '.', 2), '0'))) AS INTEGER) AS digits_after,
 max(greatest(length(ltrim(split_part({d}, '.', 1), '0')), 1)) <= {p - s} AND max(length(rtrim(split_part({d}, '.', 2), '0'))) <= {s} AS holds FROM lineitem"""


@query("N05_contract_precision", union_all(precision_sql("l_extendedprice", 8, 2), precision_sql("l_quantity", 3, 1), precision_sql("l_discount", 2, 1)))
def _(t):
    return cat.observed_precision(t.lineitem, {"l_extendedprice": (8, 2), "l_quantity": (3, 1), "l_discount": (2, 1)}).drop("unreadable")


@query("N06_contract_date_format", f"""{CAT_SQL} SELECT * FROM (SELECT dataset, column_name, CASE WHEN type <> 'DATE' THEN 'not_a_date_type' WHEN date_format IS NOT NULL THEN 'time_on_date' END AS finding
 FROM cat JOIN spec USING (dataset, column_name) WHERE data_type = 'date' OR date_format IS NOT NULL) WHERE finding IS NOT NULL""")
def _(t):
    c = catalogue(t)
    return cat.contract_date_format(c, spec(c))


@query("N07_contract_keys", union_all(
    """SELECT 'o_orderkey' AS keys, count(*) FILTER (n > 1) AS repeated_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_repeats, count(*) FILTER (n > 1) = 0 AS holds
 FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)""",
    """SELECT 'l_orderkey,l_linenumber', count(*) FILTER (n > 1), CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT), count(*) FILTER (n > 1) = 0
 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""))
def _(t):
    return cat.observed_keys(t.orders, ["o_orderkey"]).unionByName(cat.observed_keys(t.lineitem, ["l_orderkey", "l_linenumber"]))


@query("N07_contract_key_sets", f"""{CAT_SQL}, d AS (SELECT dataset, list_sort(list(DISTINCT {upper_sql("column_name")})) AS k FROM cat WHERE ordinal <= 2 GROUP BY dataset),
s AS (SELECT dataset, ordinal % 2 AS c, list_sort(list(DISTINCT {upper_sql("column_name")})) AS k FROM cat WHERE ordinal <= CASE WHEN dataset % 3 = 0 THEN 4 ELSE 2 END GROUP BY dataset, c
 UNION ALL SELECT dataset, 9, list_sort(list(DISTINCT {upper_sql("column_name")})) FROM cat WHERE dataset % 2 = 0 AND ordinal <= 2 GROUP BY dataset)
SELECT dataset, 'keys_match_no_constraint' AS finding FROM d JOIN s USING (dataset) GROUP BY dataset HAVING NOT bool_or(d.k = s.k)""")
def _(t):
    c = catalogue(t).select("dataset", F.inline(F.arrays_zip("column_name", "ordinal"))).filter("ordinal <= 4")
    declared = c.filter("ordinal <= 2")
    split = c.filter(F.col("ordinal") <= F.when(F.col("dataset") % 3 == 0, 4).otherwise(2)).withColumn("constraint", F.col("ordinal") % 2)
    whole = c.filter("dataset % 2 = 0 AND ordinal <= 2").withColumn("constraint", F.lit(9))
    return cat.contract_key_sets(declared, split.unionByName(whole))


# Issue counts per customer and run: two versions of the same summary.
RUNS_SQL = """WITH old AS (SELECT CAST(o_custkey AS VARCHAR) AS mapping, count(*) FILTER (o_totalprice > 400000) AS errors, count(*) FILTER (o_orderstatus = 'P') AS warnings FROM orders WHERE o_custkey % 17 <> 0 GROUP BY o_custkey),
new AS (SELECT CAST(o_custkey AS VARCHAR) AS mapping, count(*) FILTER (o_totalprice > 400000 - o_custkey % 2 * 50000) AS errors, count(*) FILTER (o_orderstatus = CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE 'P' END) AS warnings FROM orders WHERE o_custkey % 19 <> 0 GROUP BY o_custkey),
d AS (SELECT coalesce(n.mapping, o.mapping) AS mapping, CASE WHEN o.mapping IS NULL THEN 'added' WHEN n.mapping IS NULL THEN 'removed' WHEN n.errors <> o.errors OR n.warnings <> o.warnings THEN 'changed' END AS status,
 o.errors AS old_errors, n.errors AS new_errors, n.errors - o.errors AS delta_errors, o.warnings AS old_warnings, n.warnings AS new_warnings, n.warnings - o.warnings AS delta_warnings
 FROM new n FULL JOIN old o ON n.mapping = o.mapping)"""


def runs(t):
    k, p, s = F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    name = k.cast("string").alias("mapping")
    old = t.orders.filter(k % 17 != 0).groupBy(k).agg(F.count_if(p > 400000).alias("errors"), F.count_if(s == "P").alias("warnings")).select(name, "errors", "warnings")
    new = t.orders.filter(k % 19 != 0).groupBy(k).agg(
        F.count_if(p > 400000 - k % 2 * 50000).alias("errors"), F.count_if(s == F.when(k % 3 == 0, "F").otherwise("P")).alias("warnings")).select(name, "errors", "warnings")
    return new, old


@query("N08_reconcile_drift", f"{RUNS_SQL} SELECT * FROM d WHERE status IS NOT NULL")
def _(t):
    return cat.reconcile_drift(*runs(t))


@query("N08_drift_totals", f"""{RUNS_SQL} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed,
 CAST(coalesce(sum(delta_errors) FILTER (delta_errors > 0), 0) AS BIGINT) AS new_errors, CAST(coalesce(sum(delta_warnings) FILTER (delta_warnings > 0), 0) AS BIGINT) AS new_warnings FROM d""")
def _(t):
    return cat.drift_totals(cat.reconcile_drift(*runs(t)))
