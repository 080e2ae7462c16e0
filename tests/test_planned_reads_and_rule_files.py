"""Splits of database reads, and rules between record types in their dictionary form."""

from datetime import date, datetime
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.operators import record_types as rt
from tablewright.operators.violations import VIOLATION_COLUMNS
from tablewright.sources import database


def balance(df, splits):
    return {r["split"]: (r["rows"], r["claimed_twice"]) for r in database.split_balance(df, splits).collect()}


@pytest.mark.parametrize("splits", [
    database.range_splits("k", -3, 7, 4),
    database.range_splits("k", 0, 2, 9),
    database.range_splits("k", 5, 5, 3),
    database.range_splits("k", None, None, 3),
    database.cut_splits("k", ["-2", "0", "100"]),
    database.remainder_splits("k", 4),
    database.remainder_splits("k", 1),
])
def test_every_row_is_read_once(spark, splits):
    rows = [None, None, *range(-12, 13), 2**62, -(2**62)]
    found = balance(spark.createDataFrame([(k,) for k in rows], "k bigint"), splits)
    assert -1 not in found and len(found) == len(splits)
    assert sum(n for n, _ in found.values()) == len(rows) and not any(twice for _, twice in found.values())


def test_splits_of_dates_and_times(spark):
    days = [date(2020, 1, d) for d in (1, 5, 9, 31)]
    splits = database.range_splits("d", days[0], days[-1], 3)
    assert splits[1] == "d >= DATE '2020-01-11' AND d < DATE '2020-01-21'"
    assert balance(spark.createDataFrame([(d,) for d in [*days, None]], "d date"), splits) == {0: (4, 0), 1: (0, 0), 2: (1, 0)}
    times = database.range_splits("d", datetime(2020, 1, 1, 13), datetime(2020, 1, 3, 1), 2)
    assert times[1] == "d >= DATE '2020-01-02'"
    assert balance(spark.createDataFrame([(datetime(2020, 1, 1, 13),), (datetime(2020, 1, 3, 1),)], "d timestamp"), times) == {0: (1, 0), 1: (1, 0)}


@settings(max_examples=200, deadline=None)
@given(st.integers(-(10**6), 10**6), st.integers(0, 10**6), st.integers(1, 40), st.integers(-(2 * 10**6), 2 * 10**6))
def test_a_key_meets_one_range(lo, width, n, key):
    splits = database.range_splits("k", lo, lo + width, n)
    assert 1 <= len(splits) <= n
    hits = [eval(p.replace(" = ", " == ").replace("AND", "and").replace("OR k IS NULL", ""), {"k": key}) for p in splits]  # noqa: S307
    assert sum(hits) == 1


def test_overlaps_and_gaps_are_seen(spark):
    found = balance(spark.createDataFrame([(k,) for k in (1, 2, 3, 9)], "k int"), ["k < 3", "k > 1 AND k < 9"])
    assert found == {0: (2, 1), 1: (1, 0), -1: (1, 0)}


def fake_reader(calls, bounds=(0, 100)):
    class Reader:
        def format(self, _):
            return self

        def options(self, **kw):
            calls.append(("load", kw))
            return self

        def load(self):
            return SimpleNamespace(first=lambda: bounds)

        def jdbc(self, url, table, predicates, properties):
            calls.append(("jdbc", table, predicates, properties))
            return SimpleNamespace(first=lambda: None)

    return SimpleNamespace(read=Reader())


def test_a_query_is_read_over_several_connections():
    calls = []
    database.scan_query(fake_reader(calls), "jdbc:x", "SELECT id FROM a", {"user": "u"}, "id", partitions=3)
    assert calls == [("jdbc", "(SELECT id FROM a) rows_of_query", database.remainder_splits("id", 3), {"fetchsize": "10000", "user": "u"})]
    calls.clear()
    database.scan_query(fake_reader(calls), "jdbc:x", "SELECT id FROM a", None, "id", partitions=4, split="range")
    assert calls[0] == ("load", {"url": "jdbc:x", "query": "SELECT MIN(id) AS lo, MAX(id) AS hi FROM (SELECT id FROM a) rows_of_query"})
    assert calls[1][2] == database.range_splits("id", 0, 100, 4)
    with pytest.raises(ValueError):
        database.scan_query(fake_reader(calls), "jdbc:x", "SELECT 1", None, "id", split="other")
    with pytest.raises(ValueError):
        database.remainder_splits("id", 0)


ROWS = [("b", 1, "header", "3", "10", "A", None), ("b", 2, "detail", None, None, "A", "4"), ("b", 3, "detail", None, None, "C", "5"), ("b", 4, "trailer", "2", "9", "A", None)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, "batch string, _row bigint, _record_type string, declared string, total string, flag string, amount string")


def test_rules_between_types_from_dictionaries(records):
    rules = [
        {"check": "header_trailer_count", "record_type": "header", "trailer_field": "declared", "message": "count is off"},
        {"check": "header_trailer_count", "record_type": "trailer", "trailer_field": "declared"},
        {"check": "header_trailer_sum", "record_type": "header", "trailer_field": "total", "sum_field": "amount", "severity": "warning"},
        {"check": "header_detail_consistent", "header_field": "flag", "detail_field": "flag", "message": ""},
        {"check": "type_sequence", "expected_order": ["trailer", "header"]},
        {"check": "required_companion", "when_type": "header", "requires_type": "summary"},
        rt.CrossTypeRule("expect_count", {"record_type": "detail", "exactly": 0}),
    ]
    found = {r["rule_id"]: r for r in rt.check_across_types(records, rules, ["batch"]).collect()}
    assert set(found) == {f"CT_{c}" for c in rt.CROSS_TYPE_CHECKS} - {"CT_header_trailer_match"}
    assert found["CT_header_trailer_count"]["message"] == "count is off" and found["CT_header_trailer_sum"]["severity"] == "warning"
    assert found["CT_header_detail_consistent"]["row_number"] == 3 and "flag is C" in found["CT_header_detail_consistent"]["message"]
    assert rt.check_across_types(records, [rules[0]]).columns == VIOLATION_COLUMNS


def test_no_rules_and_no_rows(records):
    assert rt.check_across_types(records, [], ["batch"]).columns == ["batch", *VIOLATION_COLUMNS]
    assert rt.check_across_types(records, []).count() == 0
    rule = {"check": "expect_count", "record_type": "detail", "exactly": 1}
    assert rt.check_across_types(records.where("false"), [rule]).count() == 1
    assert rt.check_across_types(records.where("false"), [rule], ["batch"]).count() == 0


@pytest.mark.parametrize("spec", [
    {"check": "other"}, {}, {"check": "expect_count", "record_type": "detail"}, {"check": "type_sequence", "expected_order": []},
    {"check": "header_trailer_sum", "record_type": "trailer", "trailer_field": "total"},
])
def test_a_rule_that_could_never_fire_is_an_error(spec):
    with pytest.raises(ValueError):
        rt.cross_type_rule(spec)


def test_record_types_from_a_dictionary(spark):
    spec = {"discriminator": {"position": 1, "length": 2}, "record_types": {"head": {"position": "first"}, "line": {"match": "LN", "expect": "at_least_one"}, "end": {"position": "last"}}}
    types, disc = rt.record_types_from_dict(spec)
    lines = spark.createDataFrame([(1, "LN head"), (2, "LN one"), (3, "XX"), (4, "LN end")], "_row bigint, value string")
    got = {r["_row"]: r["_record_type"] for r in rt.classify_records(lines, types, disc).collect()}
    assert got == {1: "head", 2: "line", 3: None, 4: "end"} and types[1].expect == "at_least_one"
    for bad in ({"match": "A", "expect": "two"}, {"match": ""}, {"position": "middle"}):
        with pytest.raises(ValueError):
            rt.record_types_from_dict({"discriminator": {"position": 1, "length": 1}, "record_types": {"t": bad}})


def test_counting_rules_of_a_file_share_one_aggregation(spark):
    records = spark.createDataFrame(
        [("a", "header", 0, "3", None, None), ("a", "detail", 1, None, None, "2.5"), ("a", "trailer", 9, None, "2.5", None), ("b", "header", 0, "0", None, None), ("c", "trailer", 9, None, "1", None)],
        "batch string, _record_type string, _row long, declared string, total string, amount string")
    rules = [
        {"check": "required_companion", "when_type": "header", "requires_type": "trailer"},
        {"check": "header_trailer_count", "record_type": "header", "trailer_field": "declared"},
        {"check": "header_trailer_sum", "record_type": "trailer", "trailer_field": "total", "sum_of": ["amount"]},
        {"check": "expect_count", "record_type": "detail", "exactly": 1},
    ]
    found = rt.check_across_types(records, rules, ["batch"])
    assert "partial_count" not in found._jdf.queryExecution().executedPlan().toString()
    alone = [rt.check_across_types(records, [rule], ["batch"]) for rule in rules]
    expected = sorted(str(r) for df in alone for r in df.collect())
    assert len(expected) == 5 and sorted(map(str, found.collect())) == expected
