"""Checks of fixed-width lines against their layout.

Lines carry ``value`` and ``_row``.  Each check is one expression per line;
lists of issues are complete, and the capped lists of a report are separate
functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import coerce
from tablewright.functions.pictures import picture_holds
from tablewright.operators.profile import pct
from tablewright.operators.violations import ValueCheck, explode_value_checks, of_rows, row_identity
from tablewright.sources.layouts import LayoutField, line_length, raw_field


def length_summary(lines: DataFrame, expected: int) -> DataFrame:
    """Lines with the right and the wrong length."""
    wrong = F.char_length("value") != expected
    return lines.agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(~wrong).alias("correct_lines"), F.count_if(wrong).alias("incorrect_lines")
    ).withColumn("expected_length", F.lit(expected).cast("bigint"))


def length_issues(lines: DataFrame, layout: list[LayoutField], keep=()) -> DataFrame:
    """Every short or long line: which fields are cut, or what trails."""
    expected = line_length(layout)
    actual = F.char_length("value")
    ends = F.array(*[F.struct(F.lit(f.name).alias("n"), F.lit(f.end).alias("e")) for f in layout])
    cut = F.transform(F.filter(ends, lambda f: f["e"] > actual), lambda f: f["n"])
    hint = F.array_join(cut, ", ")
    short = actual < expected
    return lines.filter(actual != expected).select(
        *keep,
        F.col("_row").cast("bigint").alias("row_number"),
        F.when(short, "FW_LEN_002").otherwise("FW_LEN_003").alias("issue_code"),
        F.when(short, hint).otherwise("__TRAILING_DATA__").alias("field"),
        F.lit(expected).alias("expected_length"),
        actual.alias("actual_length"),
        F.when(~short, F.substring("value", expected + 1, 2**31 - 1)).alias("trailing"),
    )


def length_issue_report(issues: DataFrame, cap: int = 200) -> DataFrame:
    """The first ``cap`` issues of a report and, on each, how many there are."""
    total = issues.agg(F.count(F.lit(1)).alias("n")).scalar()
    return issues.orderBy("row_number", *[c for c in issues.columns if c != "row_number"]).limit(cap).withColumn("omitted", F.greatest(total - cap, F.lit(0)).cast("bigint"))


def uniform_length(lines: DataFrame, by: list[str]) -> DataFrame:
    """Per file: is there one single line length?"""
    n = F.char_length("value")
    return lines.groupBy(*by).agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.count(F.lit(1)).alias("lines")).withColumn(
        "uniform", F.col("min_length") == F.col("max_length")
    )


def _strict_conditions(layout: list[LayoutField], level: str, digits_only: bool = False) -> list[tuple[Column, LayoutField, str]]:
    """``(is_bad, field, issue code)`` of every check that applies."""
    conditions = []
    for f in layout:
        c = F.col(f.name)
        if f.required:
            conditions.append((coerce.is_blank(c), f, "FW_REQ_001"))
        if level == "basic":
            continue
        if f.valid_values:
            conditions.append((coerce.is_filled(c) & ~coerce.strip(c).isin(*f.valid_values), f, "FW_VAL_001"))
        if f.picture:
            conditions.append((coerce.is_filled(c) & ~picture_holds(c, f.picture, digits_only), f, "FW_FMT_001"))
    return conditions


def strict_checks(layout: list[LayoutField], level: str = "all", digits_only: bool = False) -> list[ValueCheck]:
    """Required, valid-value and picture checks on sliced fields.

    ``basic`` looks at required fields only; ``format`` and ``all`` at
    everything.
    """
    checks = []
    for is_bad, f, code in _strict_conditions(layout, level, digits_only):
        name, expected, before, after = {
            "FW_REQ_001": ("required", None, f"{f.name} has to be filled", ""),
            "FW_VAL_001": ("valid_values", ",".join(f.valid_values), f"{f.name} does not allow [", "]"),
            "FW_FMT_001": ("format", f.picture, f"{f.name} asks for picture {f.picture}, not [", "]"),
        }[code]
        checks.append(ValueCheck(is_bad, code, name, "error", f.name, F.col(f.name), expected, code, before, after))
    return checks


def strict_fixed_width(fields: DataFrame, layout: list[LayoutField], level: str = "all", row_id="_row", digits_only: bool = False, ids=()) -> DataFrame:
    """Violations of all strict checks in one pass over the sliced fields."""
    row_number = F.col(row_id) if isinstance(row_id, str) else row_id
    return explode_value_checks(fields, row_number, strict_checks(layout, level, digits_only), ids)


def strict_summary(fields: DataFrame, layout: list[LayoutField], level: str = "all") -> DataFrame:
    """Invalid records and format errors, without building the violations."""
    bad = {kind: [] for kind in ("FW_REQ_001", "FW_VAL_001", "FW_FMT_001")}
    for is_bad, _, code in _strict_conditions(layout, level):
        bad[code].append(F.coalesce(is_bad, F.lit(False)).cast("int"))
    zero = F.lit(0)
    required = reduce(lambda a, b: a + b, bad["FW_REQ_001"], zero)
    formats = reduce(lambda a, b: a + b, bad["FW_VAL_001"] + bad["FW_FMT_001"], zero)
    return fields.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(required + formats > 0).alias("invalid_records"),
        F.coalesce(F.sum(formats), zero).cast("bigint").alias("format_errors"),
    )


def first_misalignment(lines: DataFrame, layout: list[LayoutField], digits_only: bool = False, keep=()) -> DataFrame:
    """Per bad line the first field that fails, with its 1-based offset.

    In field order: cut off, required but blank, value not allowed, picture
    not met; a line that only has the wrong length is reported as such.
    """
    expected = line_length(layout)
    actual = F.char_length("value")

    def issue(reason: str, name: str | None, offset: Column, wanted: Column, got: Column) -> Column:
        return F.struct(
            F.lit(reason).alias("reason"), F.lit(name).cast("string").alias("field"), offset.cast("int").alias("offset"),
            wanted.cast("string").alias("expected"), got.cast("string").alias("actual"),
        )

    steps = []
    for f in sorted(layout, key=lambda f: f.start):
        raw = raw_field(f)
        v = coerce.strip(raw)
        at = F.lit(f.start)
        steps.append(F.when(F.char_length(raw) < f.length, issue("field_truncated", f.name, at, F.lit(f"len={f.length}"), F.concat(F.lit("len="), F.char_length(raw).cast("string")))))
        if f.required:
            steps.append(F.when(v == "", issue("required_empty", f.name, at, F.lit("non-empty"), F.lit("empty"))))
        if f.valid_values:
            allowed = [x.strip() for x in f.valid_values]
            shown = ", ".join(sorted(allowed))
            steps.append(F.when((v != "") & ~v.isin(*allowed), issue("invalid_value", f.name, at, F.lit(f"one of {shown}"), v)))
        if f.picture:
            steps.append(F.when((v != "") & ~picture_holds(v, f.picture, digits_only), issue("invalid_format", f.name, at, F.lit(f.picture), v)))
    steps.append(F.when(actual != expected, issue("line_length_mismatch", None, F.least(actual, F.lit(expected)), F.lit(expected), actual)))
    return lines.select(*keep, F.col("_row").cast("bigint").alias("row_number"), F.coalesce(*steps).alias("i")).filter("i IS NOT NULL").select(
        *keep, "row_number", "i.*"
    )


def misalignment_summary(lines: DataFrame, layout: list[LayoutField]) -> DataFrame:
    """Totals of lengths and misalignments."""
    expected = line_length(layout)
    issues = first_misalignment(lines, layout)
    found = issues.agg(F.count(F.lit(1)).alias("misaligned_rows"), F.count_if(F.col("reason") != "line_length_mismatch").alias("rows_with_field_errors"))
    counted = length_summary(lines, expected)
    return counted.select("*", found.select("misaligned_rows").scalar().alias("misaligned_rows"), found.select("rows_with_field_errors").scalar().alias("rows_with_field_errors"))


# ------------------------------------------------------- views of violations
def issue_code_summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("issue_code").agg(F.count(F.lit(1)).alias("issues"))


def affected_rows(violations: DataFrame, messages: int = 10) -> DataFrame:
    """Issue count and first messages per row (its file and other ids included).

    A row has at most one issue per rule and field, so the list is bounded by
    the rule set.
    """
    return of_rows(violations).groupBy(*row_identity(violations)).agg(
        F.count(F.lit(1)).alias("issue_count"), F.slice(F.array_sort(F.collect_list("message")), 1, messages).alias("messages")
    )


def affected_summary(violations: DataFrame, total_rows: Column) -> DataFrame:
    per_row = of_rows(violations).groupBy(*row_identity(violations)).agg(F.lit(1).alias("one"))
    return per_row.agg(F.count("one").alias("total_affected_rows")).withColumn("affected_row_pct", pct(F.col("total_affected_rows"), total_rows))


def first_affected(violations: DataFrame, n: int = 100) -> DataFrame:
    return affected_rows(violations).orderBy(*row_identity(violations)).limit(n)


def worst_rows(violations: DataFrame, n: int = 20) -> DataFrame:
    return affected_rows(violations, 3).orderBy(F.desc("issue_count"), *row_identity(violations)).limit(n)
