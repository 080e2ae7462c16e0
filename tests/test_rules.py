"""Null matrix of field rules, scopes, and cross-row groups on small data."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import groups as groups_module
from tablewright.operators.rules import (
    CrossFieldRule,
    FieldRule,
    GroupRule,
    is_clean,
    rule_from_dict,
    rule_statistics,
    validate,
)

MATRIX = [(1, None), (2, ""), (3, "   "), (4, "abc"), (5, "0"), (6, "5"), (7, "6"), (8, " LS "), (9, "5d"), (10, "NaN")]


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame(MATRIX, "id int, v string").cache()


NOT_NUMBERS = {1, 2, 3, 4, 8, 9, 10}


@pytest.mark.parametrize(
    "rule, bad",
    [
        (dict(check=">", value=5), NOT_NUMBERS | {5, 6}),
        (dict(check=">=", value=5), NOT_NUMBERS | {5}),
        (dict(check="<", value=5), NOT_NUMBERS | {6, 7}),
        (dict(check="==", value=5), NOT_NUMBERS | {5, 7}),
        (dict(check="!=", value=5), {6}),
        (dict(check="in", values=("LS", "5")), {1, 2, 3, 4, 5, 7, 9, 10}),
        (dict(check="not_in", values=("LS ", "5")), {6, 8}),
        (dict(check="range", min=0, max=5), NOT_NUMBERS | {7}),
        (dict(check="regex", pattern="[0-9]"), {1, 2, 3, 4, 8, 10}),
        (dict(check="not_null"), {1, 2, 3}),
        (dict(check="length", min=1, max=2), {1, 2, 3, 4, 8, 10}),
        (dict(check="numeric"), {4, 8, 9, 10}),
        (dict(check="integer"), {4, 8, 9, 10}),
    ],
)
def test_null_matrix(matrix, rule, bad):
    found = validate(matrix, [FieldRule("r", "v", **rule)], "id")
    assert {r.row_number for r in found.collect()} == bad


def test_violation_row(matrix):
    row = validate(matrix, [FieldRule("big one", "v", ">", value=5, name="Big", description="Too small")], "id").filter("row_number = 6").first()
    assert row.message == "Too small (got: 5)" and row.issue_code == "BR_BIG_ONE_FIELD"
    assert row.expected == "5" and row.severity == "error" and row.rule_name == "Big"


def test_sql_scope_and_missing_column(matrix):
    rules = [FieldRule("a", "v", "not_null", when="id > 2"), FieldRule("gone", "w", "not_null"), FieldRule("off", "v", "not_null", enabled=False)]
    rows = {(r.rule_id, r.row_number, r.issue_code) for r in validate(matrix, rules, "id").collect()}
    assert rows == {("a", 3, "BR_A_FIELD"), ("gone", 0, "SKIPPED")}


def test_rules_from_dictionaries(matrix):
    specs = [
        {"id": "f", "type": "field_validation", "field": "v", "operator": "in", "values": "LS, 5"},
        {"id": "l", "type": "field_validation", "field": "v", "operator": "length", "min_length": 1},
        {"id": "x", "type": "cross_field", "left_field": "id", "operator": ">", "right_field": "v"},
        {"id": "u", "type": "cross_row", "check": "unique", "field": "v"},
    ]
    counts = {r.rule_id: r.n for r in validate(matrix, [rule_from_dict(s) for s in specs], "id").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Two values are empty or null; only rows 5, 6, 7 hold numbers, all but
    # 5 > "0" and 6 > "5" and 7 > "6" fail; no value repeats.
    assert counts == {"f": 8, "l": 2, "x": 7}


def test_statistics_and_clean_rows(matrix):
    rules = [FieldRule("a", "v", "not_null")]
    stats = rule_statistics(matrix, validate(matrix, rules, "id")).first()
    assert stats.violations == 3 and stats.compliance_rate == 70.0
    assert matrix.filter(is_clean(matrix, rules)).count() == 7


def test_depends_on_and_exclusive(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, None, "b"), (4, " ", None)], "id int, x string, y string")
    rules = [CrossFieldRule("d", "depends_on", left="y", right="x"), CrossFieldRule("m", "mutually_exclusive", fields=("x", "y"))]
    assert {(r.rule_id, r.row_number) for r in validate(df, rules, "id").collect()} == {("d", 1), ("m", 2)}


CROSS_ROW = [
    ("unique", GroupRule("r", "unique", ("k",)), [("A", None), ("B", None), ("A", None), ("C", None), ("B", None)], {1, 2, 3, 5}),
    ("unique_nulls", GroupRule("r", "unique", ("k",)), [("A", None), (None, None), (None, None)], set()),
    ("composite_nulls", GroupRule("r", "unique_composite", ("k", "v")), [("A", None), ("A", None), ("A", "1")], {1, 2}),
    ("consistent", GroupRule("r", "consistent", ("k",), target="v"), [("A", "1"), ("A", "2"), ("A", None), ("B", "1"), ("B", None)], {1, 2, 3}),
    ("sequential_ok", GroupRule("r", "sequential", ("k",), target="v"), [("A", "2"), ("A", "1"), ("A", "3")], set()),
    ("sequential_gap", GroupRule("r", "sequential", ("k",), target="v"), [("A", "1"), ("A", "3"), ("B", "1")], {1, 2}),
    ("sequential_repeat", GroupRule("r", "sequential", ("k",), target="v"), [("A", "1"), ("A", "1"), ("A", "2")], {1, 2, 3}),
    ("sequential_null", GroupRule("r", "sequential", ("k",), target="v"), [("A", "1"), ("A", None)], {1, 2}),
    ("count", GroupRule("r", "group_count", ("k",), target="v"), [("A", None), ("A", "3"), ("B", "1"), (None, "9")], {1, 2}),
    ("sum", GroupRule("r", "group_sum", ("k",), target="v", min=5, max=10), [("A", "3"), ("A", "x"), ("B", "5"), ("B", "6"), ("C", "7")], {1, 2, 3, 4}),
]


@pytest.mark.parametrize("hot_share", [1, 1000])
@pytest.mark.parametrize("name, rule, rows, bad", CROSS_ROW, ids=[c[0] for c in CROSS_ROW])
def test_cross_row(spark, monkeypatch, hot_share, name, rule, rows, bad):
    """Both routes of the group join: everything cold (1), everything hot."""
    monkeypatch.setattr(groups_module, "HOT_SHARE", hot_share)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "_row int, k string, v string")
    assert {r.row_number for r in validate(df, [rule]).collect()} == bad


def test_hot_key_next_to_many_small_keys(spark):
    """One key holds 40 % of the rows, and both routes are used at once."""
    n = 20_000
    key = F.when(F.col("id") % 5 < 2, F.lit(-1)).otherwise(F.floor(F.col("id") / 10))
    df = spark.range(n).select((F.col("id") + 1).alias("_row"), key.alias("k"), (F.col("id") % 3).alias("v"))
    found = validate(df, [GroupRule("u", "unique", ("k",)), GroupRule("c", "consistent", ("k",), target="v")])
    counts = {r.rule_id: r.n for r in found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"u": n, "c": n}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan


def test_bad_numbers_do_not_stop_the_job(spark):
    rows = [(1, "a", "1e30", "1e30"), (2, "a", "2", "2"), (3, "b", "1", "2"), (4, "b", "2.7", None), (5, "c", "1", "2.7"), (6, "d", "1", "1")]
    df = spark.createDataFrame(rows, "_row long, k string, seq string, declared string")
    found = validate(df, [GroupRule("s", "sequential", ("k",), target="seq"), GroupRule("n", "group_count", ("k",), target="declared")]).collect()
    assert sorted((r.rule_id, r.row_number) for r in found) == [("n", 1), ("n", 2), ("n", 5), ("s", 1), ("s", 2), ("s", 3), ("s", 4)]
    assert any("declares 2.7" in r.message for r in found)


def test_absent_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "x", None)], "_row long, a string, b string")
    found = validate(df, [CrossFieldRule("one", "mutually_exclusive", fields=("a", "b", "gone"))]).collect()
    assert [(r.row_number, r.field, r.level) for r in found] == [(1, "a, b", "row")]
    gone = validate(df, [CrossFieldRule("none", "mutually_exclusive", fields=("p", "q"))]).collect()
    assert [(r.severity, r.level, r.issue_code) for r in gone] == [("info", "file", "SKIPPED")]


def test_rows_are_known_by_file_and_number(spark):
    from tablewright.operators.layout import affected_rows
    from tablewright.operators.profile import validation_summary
    from tablewright.operators.rules import rule_statistics
    from tablewright.sources.files import extract_error_rows

    rows = [("a", 0, 5), ("a", 1, 50), ("b", 0, 50), ("b", 1, 5), (None, -1, 50)]
    df = spark.createDataFrame(rows, "_file string, _row long, n int")
    found = validate(df, [FieldRule("small", "n", "<", value=10), FieldRule("lost", "gone", "not_null")])
    bad = {("a", 1), ("b", 0), (None, -1)}
    assert {(r["_file"], r["_row"]) for r in extract_error_rows(df, found).collect()} == bad
    assert {(r["_file"], r["row_number"]) for r in affected_rows(found).collect()} == bad
    assert {r.compliance_rate for r in rule_statistics(df, found).collect()} == {40.0}
    assert validation_summary(df, found).first().valid_rows == 2


def test_groups_within_a_file(spark):
    df = spark.createDataFrame([("a", 1, "k"), ("b", 1, "k"), ("b", 2, "k"), (None, 1, "k")], "_file string, _row long, key string")
    rule = [GroupRule("one", "unique", ("key",))]
    assert validate(df, rule).count() == 4
    assert {(r["_file"], r["row_number"]) for r in validate(df, rule, within=("_file",)).collect()} == {("b", 1), ("b", 2)}


def test_redaction_leaves_no_value(spark):
    from tablewright.sources.sinks import sort_issues

    df = spark.createDataFrame([(1, "SSN123", "x1"), (2, "SSN123", "x2")], "_row long, ssn string, other string")
    rules = [
        FieldRule("n", "ssn", "numeric"), FieldRule("v", "ssn", "in", values=("A",)), GroupRule("u", "unique", ("ssn",)),
        GroupRule("c", "unique_composite", ("ssn",)), GroupRule("s", "consistent", ("ssn",), target="other"),
        GroupRule("q", "sequential", ("ssn",), target="other"), CrossFieldRule("x", "==", left="ssn", right="other", compare_as="string"),
    ]
    found = validate(df, rules)
    assert found.count() == 14
    for r in sort_issues(found, redact=True).collect():
        assert not any(v in str(r) for v in ("SSN123", "x1", "x2")) and "[REDACTED]" in r.message


def test_a_stream_refuses_rules_without_columns(spark, tmp_path):
    import pytest

    from tablewright.streaming.watch import stream_violations

    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="gone"):
        stream_violations(stream, [FieldRule("gone", "absent", "not_null")], "id")
