"""Fixed-width defect scenarios, file scans, archives, record files."""

import datetime
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.functions.pictures import picture_pattern
from tablewright.operators import layout as lay
from tablewright.operators import record_types as rt
from tablewright.operators.record_types import RecordLayout, RecordType
from tablewright.operators.rules import FieldRule, validate
from tablewright.sources import delimited, files, sinks
from tablewright.sources.layouts import LayoutField, layout_from_mapping, scan_fixed_width, slice_fields, write_fixed_width
from tablewright.sources.records import parse_all, scan_multi_record, scan_record_layouts

SPEC = [
    ("REC_TYPE", 2, None, True, ("HD", "DT")), ("ACCOUNT_ID", 10, "9(10)", True, ()), ("CUSTOMER_ID", 8, "9(8)", True, ()),
    ("COUNTRY", 3, None, True, ("USA", "CAN", "MEX")), ("STATE", 2, None, True, ("NY", "CA", "TX", "FL")), ("POSTAL", 5, "9(5)", True, ()),
    ("OPEN_DATE", 8, "CCYYMMDD", True, ()), ("CLOSE_DATE", 8, "CCYYMMDD", False, ()), ("BALANCE", 13, "+9(7)V9(5)", True, ()),
    ("CREDIT_LIMIT", 13, "+9(7)V9(5)", True, ()), ("STATUS", 1, None, True, ("A", "I", "C")), ("RISK_SCORE", 3, "9(3)", True, ()),
    ("RATE", 5, "9(2)V9(3)", True, ()), ("AMOUNT_DUE", 11, "+9(6)V9(4)", True, ()), ("LAST_PMT_DATE", 8, "CCYYMMDD", False, ()),
    ("DELQ_DAYS", 3, "9(3)", True, ()), ("CODE3", 3, "XXX", False, ()), ("CURRENCY", 3, None, True, ("USD", "CAD", "MXN")),
    ("FLAG", 1, None, False, ("Y", "N")), ("SEGMENT", 2, None, False, ("R1", "R2", "R3")), ("EMAIL_OPT_IN", 1, None, False, ("Y", "N")),
    ("PHONE_AREA", 3, "9(3)", False, ()), ("PHONE_NUM", 7, "9(7)", False, ()), ("FILLER1", 5, None, False, ()), ("FILLER2", 5, None, False, ()),
]
LAYOUT = layout_from_mapping({"fields": [{"name": n, "length": w, "format": p, "required": r, "valid_values": list(v)} for n, w, p, r, v in SPEC]})
START = {f.name: (f.start - 1, f.length) for f in LAYOUT}


def record(i):
    values = {
        "REC_TYPE": "DT", "ACCOUNT_ID": f"{i:010d}", "CUSTOMER_ID": f"{i:08d}", "COUNTRY": "USA", "STATE": "NY", "POSTAL": "10001",
        "OPEN_DATE": "20240131", "CLOSE_DATE": "", "BALANCE": "+000012345678", "CREDIT_LIMIT": "+000050000000", "STATUS": "A", "RISK_SCORE": "700",
        "RATE": "04500", "AMOUNT_DUE": "+0000123400", "LAST_PMT_DATE": "20240201", "DELQ_DAYS": "000", "CODE3": "ABC", "CURRENCY": "USD", "FLAG": "Y",
        "SEGMENT": "R1", "EMAIL_OPT_IN": "N", "PHONE_AREA": "212", "PHONE_NUM": "5550100", "FILLER1": "", "FILLER2": "",
    }
    return "".join(values[f.name].ljust(f.length) for f in LAYOUT)


def put(line, name, text):
    at, width = START[name]
    return line[:at] + text.ljust(width)[:width] + line[at + width:]


def scenario(spark, changes):
    rows = [(i, changes.get(i, lambda x: x)(record(i))) for i in range(1, 51)]
    return spark.createDataFrame(rows, "_row long, value string")


def strict(spark, lines):
    found = lay.strict_fixed_width(slice_fields(lines, LAYOUT), LAYOUT)
    return {(r.row_number, r.field, r.issue_code) for r in found.collect()}


def test_layout_positions():
    assert START["BALANCE"] == (46, 13) and START["FILLER2"] == (128, 5) and len(record(1)) == 133


def test_all_valid(spark):
    lines = scenario(spark, {})
    assert strict(spark, lines) == set()
    assert lay.first_misalignment(lines, LAYOUT).count() == 0 and lay.length_issues(lines, LAYOUT).count() == 0


def test_short_and_long_rows(spark):
    short, long = {1, 6, 11, 16, 21, 26}, {2, 7, 12, 17, 22, 27}
    lines = scenario(spark, {**{i: lambda x: x[:-3] for i in short}, **{i: lambda x: x + "XYZ" for i in long}})
    issues = lay.length_issues(lines, LAYOUT).collect()
    assert {r.row_number for r in issues if r.issue_code == "FW_LEN_002" and r.field == "FILLER2"} == short
    assert {r.row_number for r in issues if r.issue_code == "FW_LEN_003" and r.trailing == "XYZ"} == long
    reasons = {r.row_number: r.reason for r in lay.first_misalignment(lines, LAYOUT).collect()}
    assert reasons == {**{i: "field_truncated" for i in short}, **{i: "line_length_mismatch" for i in long}}


@pytest.mark.parametrize(
    "rows, field, text, code",
    [
        ({3, 13, 23}, "COUNTRY", "ZZZ", "FW_VAL_001"),
        ({4, 14, 24}, "ACCOUNT_ID", "", "FW_REQ_001"),
        ({5, 15, 25}, "OPEN_DATE", "20251340", "FW_FMT_001"),
        ({6, 16, 26}, "BALANCE", "A000000000000", "FW_FMT_001"),
        ({8, 18, 28}, "POSTAL", "12A4B", "FW_FMT_001"),
        ({9, 19, 29}, "STATUS", "X", "FW_VAL_001"),
        ({9, 19, 29}, "CURRENCY", "EUR", "FW_VAL_001"),
    ],
)
def test_bad_fields(spark, rows, field, text, code):
    lines = scenario(spark, {i: lambda x: put(x, field, text) for i in rows})
    assert strict(spark, lines) == {(i, field, code) for i in rows}
    assert {(r.row_number, r.field) for r in lay.first_misalignment(lines, LAYOUT).collect()} == {(i, field) for i in rows}


def test_digits_only_accepts_impossible_days(spark):
    lines = scenario(spark, {5: lambda x: put(x, "OPEN_DATE", "20251340")})
    found = lay.strict_fixed_width(slice_fields(lines, LAYOUT), LAYOUT, digits_only=True)
    assert found.count() == 0


def test_every_cut_field_is_named(spark):
    lines = spark.createDataFrame([(1, record(1)[:20])], "_row long, value string")
    hint = lay.length_issues(lines, LAYOUT).first().field
    assert hint.startswith("COUNTRY, STATE, ") and hint.endswith(", FILLER1, FILLER2") and hint.count(",") == 21


def test_pictures():
    assert picture_pattern("S9(3)V9(2)") == "[+-]?[0-9]{5}" and picture_pattern("+9(3)") is None and picture_pattern("nothing") is None


def test_wide_layout(spark):
    """Several hundred checks stay within one expression."""
    wide = [LayoutField(f"f{i}", 1 + i, 1, picture="9(1)", required=True) for i in range(250)]
    lines = spark.createDataFrame([(1, "1" * 250), (2, "1" * 200 + "x" * 50)], "_row long, value string")
    assert lay.strict_fixed_width(slice_fields(lines, wide), wide).count() == 50


# ------------------------------------------------------------------- scans
def test_delimited_empty_missing_and_quoted(spark, tmp_path):
    (tmp_path / "a.txt").write_text('id|name|note\n1|x|\n2|"p|q"|z\n3|only\n')
    rows = delimited.scan_delimited(spark, str(tmp_path / "a.txt"), header=True).orderBy("id").collect()
    assert [(r.id, r.name, r.note) for r in rows] == [("1", "x", ""), ("2", "p|q", "z"), ("3", "only", None)]
    assert [r._malformed is None for r in rows] == [True, True, False]


def test_delimited_without_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,x\n2,\n")
    rows = delimited.scan_delimited(spark, str(tmp_path / "a.txt"), sep=",")
    assert rows.columns == ["col_1", "col_2", "_malformed"] and rows.filter("col_2 = ''").count() == 1


def test_fixed_width_round_trip(spark, tmp_path):
    layout = [LayoutField("a", 1, 4), LayoutField("b", 7, 3)]
    df = spark.createDataFrame([("x", "toolong"), (None, "y")], "a string, b string")
    write_fixed_width(df, layout, str(tmp_path / "o"))
    assert {r.value for r in spark.read.text(str(tmp_path / "o")).collect()} == {"x     too", "      y  "}
    assert {(r.a, r.b) for r in scan_fixed_width(spark, str(tmp_path / "o"), layout).collect()} == {("x", "too"), (None, "y")}


def test_line_numbers_over_many_blocks(spark, tmp_path):
    """Files that are split into many blocks still get physical numbers."""
    for name, n in (("a.txt", 3000), ("b.txt", 500)):
        (tmp_path / name).write_text("".join(f"{name}:{i}\n" if i % 10 else "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = files.read_lines(spark, str(tmp_path))
        rows = lines.filter("value <> ''").select("_row", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2700 + 450 and all(r.value.endswith(f":{r._row}") for r in rows)


def test_inventory(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "tiny.txt").write_text("ab\n")
    (tmp_path / "big.txt").write_text("line\n" * 10)
    rows = {r.name: r for r in files.file_inventory(spark, str(tmp_path), "*.txt").collect()}
    assert {n: r.note for n, r in rows.items()} == {"empty.txt": "empty", "tiny.txt": "very small", "big.txt": "ok"}
    assert rows["big.txt"].line_count == 10 and len(rows["tiny.txt"].sha256) == 64 and isinstance(rows["big.txt"].modified, datetime.datetime)


def test_grep_files_and_archives(spark, tmp_path):
    (tmp_path / "one.log").write_text("ok\nERROR here \nok\n")
    (tmp_path / "two.txt").write_text("ERROR\n")
    hits = files.grep_files(spark, str(tmp_path), "ERROR", "*.log").collect()
    assert [(r.file, r.line, r.content) for r in hits] == [("one.log", 2, "ERROR here")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.log", "a\nERROR 1\n")
        z.writestr("in/y.txt", "ERROR 2\n")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as tar:
        data = b"ERROR 3\nb\nERROR 4\n"
        info = tarfile.TarInfo("z.log")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    (tmp_path / "broken.zip").write_text("no archive")
    found = files.grep_archives(spark, str(tmp_path), "ERROR", file_glob="*.log").collect()
    assert {(r.archive, r.file, r.line, r.content) for r in found} == {("a.zip", "in/x.log", 2, "ERROR 1"), ("b.tar.gz", "z.log", 1, "ERROR 3"), ("b.tar.gz", "z.log", 3, "ERROR 4"), ("broken.zip", None, None, None)}
    assert [r.archive for r in found if r.error] == ["broken.zip"]


def test_error_rows_and_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([(1, "head"), (2, "a"), (3, ""), (4, "")], "_row long, v string")
    violations = validate(rows, [FieldRule("r", "v", "not_null"), FieldRule("s", "v", "in", values=("head", "a"), severity="warning")])
    assert {r._row for r in files.extract_error_rows(rows, violations, header_row=1).collect()} == {1, 3, 4}
    sinks.write_issues(violations, str(tmp_path / "out"), redact=True)
    errors = spark.read.csv(str(tmp_path / "out" / "errors"), header=True).collect()
    assert [(r.source_row, r["index"]) for r in errors] == [("3", "1"), ("4", "2")]
    assert spark.read.csv(str(tmp_path / "out" / "warnings"), header=True).count() == 2


# ------------------------------------------------------------ record files
TYPES = [RecordType("header", "HDR", expect="exactly_one"), RecordType("detail", "DTL", expect="at_least_one"), RecordType("trailer", "TRL", expect="exactly_one")]
RECORD_LAYOUTS = {
    "header": [LayoutField("batch_date", 4, 8), LayoutField("batch_id", 12, 4)],
    "detail": [LayoutField("seq", 4, 3), LayoutField("amount", 7, 6), LayoutField("batch_date", 13, 8)],
    "trailer": [LayoutField("detail_count", 4, 3), LayoutField("amount_total", 7, 8), LayoutField("batch_id", 15, 4)],
}
GOOD = ["HDR20240131B001", "DTL001 10.5020240131", "DTL002  1.2520240131", "TRL002   11.75B001"]
CASES = {
    "good": (GOOD, set()),
    "count": (GOOD[:3] + ["TRL003   11.75B001"], {"CT_header_trailer_count"}),
    "total": (GOOD[:3] + ["TRL002   11.76B001"], {"CT_header_trailer_sum"}),
    "date": (GOOD[:2] + ["DTL002  1.2520240201"] + GOOD[3:], {"CT_header_detail_consistent"}),
    "id": (GOOD[:3] + ["TRL002   11.75B002"], {"CT_header_trailer_match"}),
    "order": ([GOOD[0], GOOD[3], GOOD[1], GOOD[2]], {"CT_type_sequence"}),
    "no_trailer": (GOOD[:3], {"CT_required_companion", "CT_EXPECT"}),
    "two_headers": ([GOOD[0]] + GOOD, {"CT_EXPECT"}),
    "unknown": (GOOD[:3] + ["XYZ"] + GOOD[3:], {"CT_UNKNOWN_RECORD_TYPE"}),
}


def test_record_files(spark, tmp_path):
    for name, (lines, _) in CASES.items():
        (tmp_path / f"{name}.dat").write_text("\n".join(lines) + "\n\n")
    raw = scan_multi_record(spark, str(tmp_path), TYPES, 1, 3).cache()
    rec = parse_all(raw, RECORD_LAYOUTS).cache()
    by = ["_file"]
    found = [
        rt.unknown_records(raw, rt.discriminator(1, 3), "error", by), rt.expect_cardinality(rec, TYPES, by),
        rt.required_companion(rec, "header", "trailer", by), rt.header_trailer_count(rec, "trailer", "detail_count", "detail", by),
        rt.header_trailer_sum(rec, "trailer", "amount_total", "detail", ["amount"], by), rt.header_detail_consistent(rec, "batch_date", "batch_date", batch=by),
        rt.header_trailer_match(rec, "batch_id", "batch_id", batch=by), rt.type_sequence(rec, ["header", "detail", "trailer"], by),
    ]
    got = {name: set() for name in CASES}
    for part in found:
        for r in part.collect():
            got[r._file.rsplit("/", 1)[1][:-4]].add(r.rule_id)
    assert got == {name: want for name, (_, want) in CASES.items()}


def test_positional_types_and_whole_table_checks(spark):
    lines = spark.createDataFrame([(1, "anything"), (2, "D1"), (3, "D2"), (4, "D9")], "_row long, value string")
    types = [RecordType("top", position="first"), RecordType("end", position="last"), RecordType("detail", "D1")]
    kinds = {r._row: r._record_type for r in rt.classify_records(lines, types, rt.discriminator(1, 2)).collect()}
    assert kinds == {1: "top", 2: "detail", 3: None, 4: "end"}
    none = lines.filter("false").withColumn("_record_type", F.lit("x"))
    assert rt.expect_count(none, "detail", 1).count() == 1


def test_record_layouts(spark, tmp_path):
    (tmp_path / "f.dat").write_text("A12345\n??????\nAB\nzz\n")
    layouts = [RecordLayout("a", discriminator=(1, 1, "A")), RecordLayout("b", discriminator=(2, 1, "B")), RecordLayout("six", length=6), RecordLayout("rest", default=True)]
    rows = {r.value: (r._record_type, r._ambiguous) for r in scan_record_layouts(spark, str(tmp_path), layouts).collect()}
    assert rows == {"A12345": ("a", None), "??????": ("six", None), "AB": (None, "a,b"), "zz": ("rest", None)}


def test_drift_beyond_the_first_columns(spark):
    from tablewright.operators.discover import DeclaredField, fixed_width_drift

    lines = spark.createDataFrame([("f", " " * 300 + "VALUE")] * 4, "file string, content string")
    found = fixed_width_drift(lines, [DeclaredField("late", 296, 5)]).collect()
    assert [(r.name, r.actual_start) for r in found] == [("late", 301)]


def test_digits_are_counted_as_written(spark):
    from tablewright.operators.catalogue import observed_precision

    rows = [("1.123456789012345",), ("-" + "9" * 30,), ("5E-7",), ("1.25E3",), (None,)]
    df = spark.createDataFrame([(r[0], 1.5e12, "1") for r in rows], "a string, b double, c string")
    out = {r.column_name: r for r in observed_precision(df, {"a": (20, 10), "b": (13, 1), "c": (1, 0)}).collect()}
    assert (out["a"].digits_before, out["a"].digits_after, out["a"].holds) == (30, 15, False)
    assert (out["b"].digits_before, out["b"].digits_after, out["b"].holds) == (13, 0, False)
    assert out["c"].holds
    odd = observed_precision(spark.createDataFrame([("abc",)], "a string"), {"a": (5, 2)}).first()
    assert (odd.unreadable, odd.holds) == (1, False)


def test_broken_archives_are_reported(spark):
    from tablewright.sources.files import search_archives

    found = search_archives(spark.createDataFrame([("a.zip", bytearray(b"no zip")), ("b.tar.gz", bytearray(b""))], "path string, content binary"), "x").collect()
    assert sorted(r.archive for r in found) == ["a.zip", "b.tar.gz"] and all(r.error and r.file is None for r in found)
