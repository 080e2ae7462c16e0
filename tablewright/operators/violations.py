"""The long table of violations and the one-scan evaluation of row rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION_COLUMNS = [
    "rule_id",
    "rule_name",
    "severity",
    "row_number",
    "field",
    "value",
    "message",
    "expected",
    "issue_code",
    "level",
]

VIOLATION_SCHEMA = (
    "rule_id string, rule_name string, severity string, row_number bigint, field string, "
    "value string, message string, expected string, issue_code string, level string"
)

ROW, FILE = "row", "file"
HIDDEN = "[REDACTED]"

# Expressions per array: keeps each generated method below the JVM size limit
# when a wide layout yields hundreds of checks.
FUSE_WIDTH = 100


def violation(
    rule_id: str,
    rule_name: str,
    severity: str,
    field: str | None,
    value: Column,
    message: Column,
    expected: str | None,
    issue_code: str,
    level: str = ROW,
) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(rule_name).alias("rule_name"),
        F.lit(severity).alias("severity"),
        F.lit(field).cast("string").alias("field"),
        value.cast("string").alias("value"),
        message.cast("string").alias("message"),
        F.lit(expected).cast("string").alias("expected"),
        F.lit(issue_code).alias("issue_code"),
        F.lit(level).alias("level"),
    )


def fuse(checks: list[tuple[Column, Column]]) -> Column:
    """One array from ``(is_bad, struct)`` pairs; null where a check passes.

    Nulls are dropped after the explode: a lambda over the array would take
    the whole expression out of code generation.
    """
    parts = []
    for i in range(0, len(checks), FUSE_WIDTH):
        chunk = checks[i : i + FUSE_WIDTH]
        parts.append(F.array(*[F.when(bad, what) for bad, what in chunk]))
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))


def explode_found(df: DataFrame, kept: list, entries: Column) -> DataFrame:
    """``kept`` columns and the fields of every struct that is not null."""
    out = df.select(*kept, F.explode(entries).alias("_found")).filter("_found IS NOT NULL")
    names = [c for c in out.columns if c != "_found"]
    return out.select(*names, "_found.*")


def explode_checks(df: DataFrame, row_number: Column, checks: list[tuple[Column, Column]], ids=()) -> DataFrame:
    """Violations of any number of row-local checks in one pass over ``df``."""
    return explode_found(df, [*ids, row_number.cast("bigint").alias("row_number")], fuse(checks)).select(*ids, *VIOLATION_COLUMNS)


@dataclass(frozen=True)
class ValueCheck:
    """A check whose message is fixed text around the value it found."""

    bad: Column
    rule_id: str
    rule_name: str
    severity: str
    field: str
    value: Column
    expected: str | None
    issue_code: str
    before: str
    after: str


def explode_value_checks(df: DataFrame, row_number: Column, checks: list[ValueCheck], ids=()) -> DataFrame:
    """Violations of value checks in one pass over ``df``.

    Only the number of the check and the value go through the explode; names
    and messages are looked up afterwards, so a query that counts violations
    never builds their texts.
    """
    found = [(c.bad, F.struct(F.lit(i).alias("i"), c.value.cast("string").alias("value"))) for i, c in enumerate(checks, 1)]
    rows = explode_found(df, [*ids, row_number.cast("bigint").alias("row_number")], fuse(found))

    def text(name: str) -> Column:
        return F.element_at(F.array(*[F.lit(getattr(c, name)).cast("string") for c in checks]), F.col("i")).alias(name)

    shown = F.coalesce(F.col("value"), F.lit(""))
    message = F.concat(text("before"), shown, text("after")).alias("message")
    return rows.select(
        *ids, text("rule_id"), text("rule_name"), text("severity"), "row_number", text("field"), "value", message, text("expected"), text("issue_code"), F.lit(ROW).alias("level")
    )


def literal_violations(spark, rows: list[tuple]) -> DataFrame:
    """A table of file-level findings known from the schema alone."""
    return spark.createDataFrame(rows, VIOLATION_SCHEMA)


def row_identity(violations: DataFrame) -> list[str]:
    """The columns that name a row: what is carried besides the violation, and its number."""
    return [c for c in violations.columns if c not in VIOLATION_COLUMNS] + ["row_number"]


def of_rows(violations: DataFrame) -> DataFrame:
    """Violations of single rows, without findings on a file or a batch."""
    return violations.filter(F.col("level") == ROW)


def redact_issues(violations: DataFrame) -> DataFrame:
    """Violations without any value of the data.

    A message is made again from the names of its check: the field values that
    a text quotes (found values, keys of groups, declared totals) can not be
    told from other words afterwards.
    """
    safe = F.concat(F.coalesce("rule_name", "rule_id"), F.lit(": "), F.coalesce("field", F.lit("record")), F.lit(f" = {HIDDEN}"))
    # What a rule expects is part of the rule; for findings on whole files it is data.
    return violations.withColumns({
        "value": F.when(F.col("value").isNotNull(), F.lit(HIDDEN)),
        "message": safe,
        "expected": F.when(F.col("level") == ROW, F.col("expected")),
    })
