"""Expectation suites and expression rules with one result row per check.

All column-level expectations of a target share one aggregation; only
uniqueness needs a grouping of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import coerce
from tablewright.operators.catalogue import column_lists
from tablewright.operators.trailing import with_trailing

RESULT = ["target_id", "expectation_type", "column_name", "success", "unexpected_count", "element_count"]


@dataclass(frozen=True)
class Expectation:
    """``not_null, unique, in_set, between, row_count_between`` or
    ``columns_match``; nulls are not unexpected except for ``not_null``."""

    kind: str
    column: str | None = None
    values: tuple = ()
    min: float | None = None
    max: float | None = None
    mostly: float = 1.0


def default_suite(columns=(), required=(), keys=()) -> list[Expectation]:
    """Column order, required and key columns, and at least one row."""
    suite = [Expectation("columns_match", values=tuple(columns))] if columns else []
    suite += [Expectation("not_null", c) for c in required]
    for c in keys:
        suite += [Expectation("not_null", c), Expectation("unique", c)]
    return suite + [Expectation("row_count_between", min=1)]


def _unexpected(df: DataFrame, e: Expectation) -> Column:
    c = F.col(e.column)
    if e.kind == "not_null":
        return c.isNull()
    if e.kind == "in_set":
        return c.isNotNull() & ~F.coalesce(c.isin(*e.values), F.lit(False))
    n = coerce.number_of(df, e.column)
    inside = n.isNotNull()
    if e.min is not None:
        inside = inside & (n >= F.lit(float(e.min)))
    if e.max is not None:
        inside = inside & (n <= F.lit(float(e.max)))
    return c.isNotNull() & ~F.coalesce(inside, F.lit(False))


def run_suite(df: DataFrame, suite: list[Expectation], target_id: str) -> DataFrame:
    """Results of a suite: one aggregation, plus one per ``unique`` column."""
    plain = [e for e in suite if e.kind != "unique"]
    aggs, entries = [F.count(F.lit(1)).alias("n")], []
    n = F.col("n")

    def entry(kind, column, success, unexpected, elements=n):
        return F.struct(
            F.lit(kind).alias("expectation_type"), F.lit(column).cast("string").alias("column_name"), success.alias("success"),
            unexpected.cast("bigint").alias("unexpected_count"), elements.cast("bigint").alias("element_count"),
        )

    nothing = F.lit(None).cast("bigint")
    for i, e in enumerate(plain):
        if e.kind == "row_count_between":
            ok = n >= F.lit(int(e.min or 0))
            entries.append(entry(e.kind, None, ok & (n <= F.lit(int(e.max))) if e.max is not None else ok, nothing))
        elif e.kind == "columns_match":
            entries.append(entry(e.kind, None, F.lit(list(df.columns) == list(e.values)), nothing))
        else:
            aggs += [F.count_if(_unexpected(df, e)).alias(f"u{i}"), F.count(F.col(e.column)).alias(f"c{i}")]
            u = F.col(f"u{i}")
            judged = n if e.kind == "not_null" else F.col(f"c{i}")
            ok = F.when(judged > 0, (judged - u) / judged >= F.lit(e.mostly)).otherwise(F.lit(True))
            entries.append(entry(e.kind, e.column, ok, u))
    parts = [df.agg(*aggs).select(F.inline(F.array(*entries)))]
    for e in suite:
        if e.kind == "unique":
            per_value = df.groupBy(e.column).agg(F.count(F.lit(1)).alias("k"))
            repeated = F.col(e.column).isNotNull() & (F.col("k") > 1)
            sums = per_value.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(repeated, F.col("k"))), F.lit(0)).alias("u"))
            parts.append(sums.select(F.inline(F.array(entry("unique", e.column, F.col("u") == 0, F.col("u"))))))
    return reduce(DataFrame.unionByName, parts).select(F.lit(target_id).alias("target_id"), *RESULT[1:])


def checkpoint_summary(results: list[DataFrame]) -> DataFrame:
    """Results of several targets with the verdict of each target's run.

    The verdict is joined from one row per target.
    """
    every = reduce(DataFrame.unionByName, results)
    verdict = every.groupBy("target_id").agg(F.bool_and("success").alias("run_success"))
    return every.join(verdict, "target_id").select("target_id", "run_success", *RESULT[1:])


def columns_match_ordered_list(catalogue: DataFrame, expected: DataFrame) -> DataFrame:
    """Datasets of a catalogue against their expected column order
    (``dataset, expected``)."""
    names = column_lists(catalogue)
    return names.join(expected, "dataset").select("dataset", (F.col("columns") == F.col("expected")).alias("success"))


# --------------------------------------------------------- expression rules
RULE_ROW = ["rule_id", "severity", "scope", "record_ref", "message"]


def _rule_rows(found: DataFrame, rule_id: str, severity: str, scope: str, ref: Column, message: str) -> DataFrame:
    return found.select(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(scope).alias("scope"), ref.alias("record_ref"), F.lit(message).alias("message")
    )


def record_rule(df: DataFrame, rule_id: str, condition: str, row_id: str, severity: str = "ERROR", message: str = "Validation failed") -> DataFrame:
    """Rows where a SQL condition is false; unknown means not evaluated."""
    found = df.filter(~F.expr(condition))
    return _rule_rows(found, rule_id, severity, "record", F.concat(F.lit("record:"), F.col(row_id).cast("string")), message)


def _group_ref(keys: list[str]) -> Column:
    return F.concat(F.lit("group:"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def group_rule(df: DataFrame, rule_id: str, keys: list[str], condition: str, severity: str = "ERROR", message: str = "Validation failed") -> DataFrame:
    """Groups whose condition over aggregates is false, e.g. ``count(*) < 8``."""
    groups = df.groupBy(*keys).agg(F.expr(condition).alias("_ok"))
    return _rule_rows(groups.filter("NOT _ok"), rule_id, severity, "group", _group_ref(keys), message)


def group_count_where(df: DataFrame, rule_id: str, keys: list[str], field: str, value: str, expected: int, severity: str = "ERROR", message: str = "Validation failed") -> DataFrame:
    """Groups where the rows with ``field = value`` are not ``expected`` many.

    A group whose values are all null is not evaluated.
    """
    text = F.col(field).cast("string")
    groups = df.groupBy(*keys).agg(F.count_if(text == value).alias("_n"), F.count(text).alias("_known"))
    return _rule_rows(groups.filter((F.col("_known") > 0) & (F.col("_n") != expected)), rule_id, severity, "group", _group_ref(keys), message)


def group_strict_desc(df: DataFrame, rule_id: str, keys: list[str], field: str, order_by: list[str], severity: str = "ERROR", message: str = "Validation failed") -> DataFrame:
    """Groups in which a number does not strictly fall in row order.

    A group with a value that is no number is not evaluated.
    """
    rows = df.select(*keys, *[c for c in order_by if c not in keys], coerce.number_of(df, field).alias("_v"))
    steps = with_trailing(rows, keys, order_by, (-1, -1), {"_before": F.max("_v")})
    groups = steps.groupBy(*keys).agg(
        F.count_if(F.col("_v").isNull()).alias("_bad"), F.count_if(F.col("_before") <= F.col("_v")).alias("_rises")
    )
    return _rule_rows(groups.filter("_bad = 0 AND _rises > 0"), rule_id, severity, "group", _group_ref(keys), message)


def file_rule(df: DataFrame, rule_id: str, aggregates: dict[str, str], condition: str, severity: str = "ERROR", message: str = "Validation failed") -> DataFrame:
    """A condition over whole-table aggregates, such as a header total."""
    totals = df.agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
    return _rule_rows(totals.filter(~F.expr(condition)), rule_id, severity, "file", F.lit("file"), message)


def rule_run_summary(violations: DataFrame, validated: Column) -> DataFrame:
    """Evaluations, passes, failures and warnings of a run."""
    counts = violations.agg(F.count_if(F.col("severity") == "ERROR").alias("failed"), F.count_if(F.col("severity") == "WARN").alias("warned"))
    passed = F.greatest(validated - F.col("failed") - F.col("warned"), F.lit(0))
    return counts.select(validated.cast("bigint").alias("validated"), passed.cast("bigint").alias("passed"), "failed", "warned")


def top_failing(violations: DataFrame, n: int = 5) -> DataFrame:
    return violations.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fail_count")).orderBy(F.desc("fail_count"), "rule_id").limit(n)
