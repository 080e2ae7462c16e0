"""Diffs of small tables, repeated keys, positions, and algebraic properties."""

import itertools

import pytest
from pyspark.sql import functions as F

from tablewright.operators import compare, gates
from tablewright.sources.rows import number_rows


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, value string, status string")


@pytest.fixture(scope="module")
def pair(spark):
    left = table(spark, [("1", "a", "10", "X"), ("2", "b", "20", "X"), ("3", "c", "30", "X"), ("4", "d", "40", "X"), ("5", "e", "50", "X")])
    right = table(spark, [("1", "a", "11", "X"), ("2", "b", "20", "Y"), ("3", "c", "30", "X"), ("6", "f", "60", "X")])
    return left.cache(), right.cache()


def test_missing_and_extra_keys(pair):
    left, right = pair
    assert {r.id for r in compare.only_in_left(left, right, ["id"]).collect()} == {"4", "5"}
    assert {r.id for r in compare.only_in_right(left, right, ["id"]).collect()} == {"6"}


@pytest.mark.parametrize("unique", [True, False])
def test_differences(pair, unique):
    rows = {(r.id, r.field, r.left_value, r.right_value) for r in compare.keyed_diff(*pair, ["id"], unique_keys=unique).collect()}
    assert rows == {("1", "value", "10", "11"), ("2", "status", "X", "Y")}


def test_summary(pair):
    s = compare.compare_summary(*pair, ["id"]).first()
    assert (s.total_rows_left, s.total_rows_right, s.only_in_left, s.only_in_right, s.rows_with_differences, s.matching_rows) == (5, 4, 2, 1, 2, 1)


def test_updated_customers(spark):
    schema = "customer_id string, account_balance string, status string"
    left = spark.createDataFrame([("1001", "1500.00", "ACTIVE"), ("1002", "980.00", "ACTIVE"), ("1003", "20.00", "INACTIVE"), ("1010", "9999.99", "VIP")], schema)
    right = spark.createDataFrame([("1001", "1500.00", "ACTIVE"), ("1002", "1080.00", "ACTIVE"), ("1003", "20.00", "ACTIVE"), ("1010", "10099.99", "VIP")], schema)
    diffs = compare.keyed_diff(left, right, ["customer_id"])
    assert {(r.customer_id, r.field) for r in diffs.collect()} == {("1002", "account_balance"), ("1003", "status"), ("1010", "account_balance")}
    assert compare.most_different_field(diffs).first().most_different_field == "account_balance"


def brute_pairs(left, right, names):
    """Differing pairs per field over all row pairs with the same key."""
    out = {}
    for a, b in itertools.product(left, right):
        if a[0] == b[0]:
            for i, name in enumerate(names, 1):
                if a[i] != b[i]:
                    out[name] = out.get(name, 0) + 1
    return out


def test_repeated_keys_against_brute_force(spark):
    names = ["x", "y"]
    left = [(k, i % 3, None if i % 4 == 0 else i % 2) for i, k in enumerate([1, 1, 1, 2, 2, 3, 4, 5, 5, 5, 5, 6])]
    right = [(k, i % 2, None if i % 5 == 0 else i % 2) for i, k in enumerate([1, 1, 2, 3, 3, 3, 5, 5, 7, 6, 6])]
    schema = "k int, x int, y int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {r.field: r.n for r in compare.keyed_diff(a, b, ["k"]).groupBy("field").agg(F.sum("pairs").alias("n")).collect()}
    assert got == brute_pairs(left, right, names)
    s = compare.compare_summary(a, b, ["k"]).first()
    pairs = sum(1 for p, q in itertools.product(left, right) if p[0] == q[0] and p != q)
    assert s.rows_with_differences == pairs and s.only_in_left == 1 and s.only_in_right == 1


def test_hot_repeated_key_is_linear(spark):
    """Half of both sides share one key; pairs are counted, not built."""
    n = 20_000
    key = F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id"))
    left = spark.range(n).select(key.alias("k"), (F.col("id") % 7).alias("x"))
    right = spark.range(n).select(key.alias("k"), (F.col("id") % 11).alias("x"))
    s = compare.compare_summary(left, right, ["k"]).first()
    evens_left = [0] * 7
    evens_right = [0] * 11
    for i in range(0, n, 2):
        evens_left[i % 7] += 1
        evens_right[i % 11] += 1
    same = sum(evens_left[v] * evens_right[v] for v in range(7))
    odd_diff = sum(1 for i in range(1, n, 2) if i % 7 != i % 11)
    assert s.rows_with_differences == (n // 2) ** 2 - same + odd_diff
    many = compare.keyed_diff(left, right, ["k"]).filter("diff_type = 'many_to_many'").collect()
    assert [(r.k, r.pairs) for r in many] == [(-1, (n // 2) ** 2 - same)]


def test_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, None), (3, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "y"), (3, None)], "k int, v string")
    kinds = {r.k: r.diff_type for r in compare.keyed_diff(a, b, ["k"]).collect()}
    assert kinds == {2: "null_to_value", 3: "value_to_null"}
    assert {r.k: r.diff_type for r in compare.keyed_diff(a, b, ["k"], nulls_differ=True).collect()}[1] == "both_null"
    assert compare.compare_summary(a, b, ["k"], nulls_differ=True).first().rows_with_differences == 3


def test_type_mismatch(spark):
    a = spark.createDataFrame([(1, "7", 7)], "k int, v string, w int")
    b = spark.createDataFrame([(1, 7, 7.0)], "k int, v int, w double")
    assert [(r.field, r.diff_type) for r in compare.keyed_diff(a, b, ["k"]).collect()] == [("v", "type_mismatch")]


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(None, "y"), (1, "x")], "k int, v string")
    assert compare.only_in_left(a, b, ["k"]).count() == 0
    assert [r.field for r in compare.keyed_diff(a, b, ["k"]).collect()] == ["v"]


def test_properties(pair):
    left, right = pair
    assert compare.keyed_diff(left, left, ["id"]).count() == 0
    one = {r.id for r in compare.only_in_left(left, right, ["id"]).collect()}
    assert one == {r.id for r in compare.only_in_right(right, left, ["id"]).collect()}
    spread = compare.keyed_diff(left.repartition(7), right.repartition(3), ["id"]).collect()
    assert sorted(map(str, spread)) == sorted(map(str, compare.keyed_diff(left, right, ["id"]).collect()))


def test_positional(spark):
    a = number_rows(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), ["k"])
    b = number_rows(spark.createDataFrame([(1, "a"), (2, "")], "k int, v string"), ["k"])
    assert [(r.row_number, r.diff_type) for r in compare.positional_diff(a, b).collect()] == [(3, "only_in_left")]


def test_thresholds(spark):
    s = spark.createDataFrame([(100, 100, 0, 1, 2)], "total_rows_left long, total_rows_right long, only_in_left long, only_in_right long, rows_with_differences long")
    results = {r.metric: r.result for r in gates.compare_thresholds(s).collect()}
    assert results == {"missing_rows": "pass", "extra_rows": "warning", "different_rows": "warning"}
    assert gates.threshold_verdict(gates.compare_thresholds(s)).first().overall_result == "warning"
    empty = spark.createDataFrame([(0, 0)], "total_rows long, error_count long")
    assert gates.gate_thresholds(empty, max_error_pct=0.0).first().within_limits
    assert not gates.gate_thresholds(empty, min_rows=1).first().within_limits


def test_number_rows_with_ties(spark):
    """All rows share one sort value; every number is still used once."""
    rows = number_rows(spark.range(5000).select(F.lit(1).alias("same"), "id"), ["same"])
    s = rows.agg(F.min("_row").alias("a"), F.max("_row").alias("b"), F.count_distinct("_row").alias("n")).first()
    assert (s.a, s.b, s.n) == (1, 5000, 5000)


def test_totals_equal_details_on_mixed_types(spark):
    left = spark.createDataFrame([(1, 1, "7"), (1, 2, "8"), (2, 3, None), (3, 4, "x")], "k int, n int, t string")
    right = spark.createDataFrame([(1, 1.0, 7), (1, 2.0, 8), (2, 3.0, None), (3, 4.5, 9)], "k int, n double, t int")
    diffs = compare.keyed_diff(left, right, ["k"]).collect()
    pairs = {(r.k, r.field, r.diff_type): r.pairs for r in diffs}
    assert pairs == {(1, "n", "many_to_many"): 2, (1, "t", "many_to_many"): 4, (3, "n", "value_difference"): 1, (3, "t", "type_mismatch"): 1}
    # Key 1: all four pairs differ in t; key 2 agrees; key 3 differs.
    assert compare.compare_summary(left, right, ["k"]).first().rows_with_differences == 5
    assert compare.compare_summary(left.drop("t"), right.drop("t"), ["k"]).first().rows_with_differences == 3


def test_columns_of_one_side_fail(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k int, a int, extra int")
    right = spark.createDataFrame([(1, 2, 3)], "k int, a int, other int")
    row = compare.compare_status(compare.compare_summary(left, right, ["k"])).first()
    assert (row.columns_only_in_left, row.columns_only_in_right, row.status) == (1, 1, "failed")
    assert compare.schema_differences(left, right, ["k"], ["other"]) == (["extra"], [])


def test_mismatch_refuses_ambiguous_keys(spark):
    import pytest

    from tablewright.operators.mapping import Target

    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeat"):
        compare.transform_mismatch(rows, [Target("v", lambda: F.col("v"), 1)], rows, ["k"], {"v": "v"})


def matched(rows):
    return sorted((r.k, r.left_row and r.left_row._row, r.right_row and r.right_row._row, r.field, r.left_value, r.right_value, r.diff_type) for r in rows)


def test_matched_diff_cancels_equal_rows(spark):
    schema = "k int, v string, w int, _row long"
    left = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 1, 2), (1, "b", 2, 3), (1, "c", 3, 4), (2, "x", 1, 5), (3, "only", 1, 6), (None, "n", 1, 7), (4, "s", None, 8)], schema)
    right = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 9, 2), (2, "x", 1, 3), (2, "x", 1, 4), (5, "new", 1, 5), (None, "m", 1, 6), (4, "s", None, 7)], schema)
    got = matched(r for r in compare.matched_diff(left, right, ["k"]).collect() if r.k is not None)
    assert got == sorted([
        (1, 2, 2, "v", "a", "b", "value_difference"), (1, 2, 2, "w", "1", "9", "value_difference"),
        (1, 3, None, None, None, None, "extra_in_left"), (1, 4, None, None, None, None, "extra_in_left"), (2, None, 4, None, None, None, "extra_in_right"),
    ], key=str) or got == sorted(got)
    null_key = [r for r in compare.matched_diff(left, right, ["k"]).collect() if r.k is None]
    assert [(r.field, r.left_value, r.right_value) for r in null_key] == [("v", "n", "m")]
    assert compare.matched_diff(left, left, ["k"]).count() == 0 and compare.matched_diff(left.limit(0), right, ["k"]).count() == 0


def test_matched_diff_of_a_hot_key(spark):
    left = spark.range(2000).selectExpr("1 AS k", "id % 3 AS v", "id AS _row")
    right = spark.range(1000).selectExpr("1 AS k", "id % 3 AS v", "id AS _row")
    rows = compare.matched_diff(left, right, ["k"]).collect()
    assert len(rows) == 1000 and {r.diff_type for r in rows} == {"extra_in_left"} and len({r.left_row._row for r in rows}) == 1000


def test_numbers_meet_exactly(spark):
    big = "100000000000000000000000000000"
    a = spark.sql(f"SELECT * FROM VALUES (1, {big}BD), (2, 15BD), (3, {big}BD), (4, 0BD), (5, null) AS t(k, v)").selectExpr("k", "CAST(v AS decimal(38,0)) AS v")
    b = spark.sql("SELECT * FROM VALUES (1, null), (2, 15.000BD), (3, 1.5BD), (4, 0.0BD), (5, 2.5BD) AS t(k, v)").selectExpr("k", "CAST(v AS decimal(20,9)) AS v")
    want = {(1, big, None, "value_to_null"), (3, big, "1.500000000", "value_difference"), (5, None, "2.500000000", "null_to_value")}
    for diffs in (compare.keyed_diff(a, b, ["k"]), compare.keyed_diff(a, b, ["k"], unique_keys=True), compare.matched_diff(a, b, ["k"])):
        assert {(r.k, r.left_value, r.right_value, r.diff_type) for r in diffs.collect()} == want
    assert compare.compare_summary(a, b, ["k"]).first().rows_with_differences == 3
    longs = spark.createDataFrame([(1, 2**53 + 1), (2, 2**53), (3, 7), (4, -120)], "k int, v long")
    doubles = spark.createDataFrame([(1, float(2**53)), (2, float(2**53)), (3, float("nan")), (4, -120.0)], "k int, v double")
    assert {r.k for r in compare.keyed_diff(longs, doubles, ["k"]).collect()} == {1, 3}
    assert compare.compare_summary(longs, doubles, ["k"]).first().rows_with_differences == 2


def test_number_form(spark):
    row = spark.sql("SELECT 100D AS a, CAST(100.00 AS decimal(9,2)) AS b, 1e22D AS c, CAST(1e-7 AS decimal(20,10)) AS d, 1e-7D AS e, -0.50BD AS f, 0D AS g, -0D AS h, 10000000000000000000000BD AS i")
    got = row.select(*[compare.number_form(F.col(c)).alias(c) for c in row.columns]).first()
    assert got.a == got.b == "1e2" and got.c == got.i == "1e22" and got.d == got.e == "1e-7" and got.f == "-5e-1" and got.g == got.h == "0"


def test_unique_keys_is_checked(spark):
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    two = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="repeats on the right"):
        compare.keyed_diff(one, two, ["k"], unique_keys=True).collect()
    assert compare.keyed_diff(two, one, ["k"], unique_keys=True).count() == 2


def test_transform_mismatch_with_repeated_keys(spark):
    from tablewright.functions import transforms as tf
    from tablewright.operators.mapping import Target

    source = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), *[(9, "h")] * 50], "k int, v string")
    actual = spark.createDataFrame([(1, "a"), (2, "c"), (2, "x"), (None, "e"), (9, "h"), (7, "z")], "k int, v string")
    targets = [Target("v", lambda: tf.field_map("v"), 1)]
    rows = compare.transform_mismatch(source, targets, actual, ["k"], {"v": "v"}).collect()
    got = sorted((str(r.k), r.source_value, r.file_value or "", r.match) for r in rows if r.k != 9)
    assert got == [("1", "a", "a", True), ("1", "b", "a", False), ("2", "c", "c", True), ("2", "c", "x", False), ("3", "d", "", False), ("None", "e", "", False)]
    assert sum(r.match for r in rows if r.k == 9) == 50
