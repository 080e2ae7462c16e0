"""Thresholds, gates and statuses over tables of results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limit:
    """Upper limits of a metric; ratios are between 0 and 1."""

    metric: str
    max_value: float | None = None
    max_ratio: float | None = None
    warning_value: float | None = None
    warning_ratio: float | None = None
    enabled: bool = True


# Default limits of a comparison.
DEFAULT_LIMITS = (
    Limit("missing_rows", 10, 0.01, 5, 0.005),
    Limit("extra_rows", 10, 0.01, 5, 0.005),
    Limit("different_rows", 20, 0.02, 10, 0.01),
    Limit("field_differences", 50, 0.05, 25, 0.025),
)

METRIC_SOURCES = {
    "missing_rows": "only_in_left",
    "extra_rows": "only_in_right",
    "different_rows": "rows_with_differences",
    "field_differences": "field_differences",
}


def compare_thresholds(summary: DataFrame, limits=DEFAULT_LIMITS) -> DataFrame:
    """``pass``, ``warning`` or ``fail`` per metric of a comparison summary.

    Hard limits are looked at before warnings, counts before ratios.
    """
    total = F.col("total_rows_left")
    entries = []
    for limit in limits:
        source = METRIC_SOURCES[limit.metric]
        if not limit.enabled or source not in summary.columns:
            continue
        value = F.col(source)
        ratio = F.when(total > 0, value / total).otherwise(F.lit(0.0)).cast("double")
        steps = [
            (limit.max_value, value, "fail", "value over maximum"),
            (limit.max_ratio, ratio, "fail", "ratio over maximum"),
            (limit.warning_value, value, "warning", "value over warning level"),
            (limit.warning_ratio, ratio, "warning", "ratio over warning level"),
        ]
        result, reason = F.lit("pass"), F.lit("within limits")
        for bound, measured, verdict, why in reversed(steps):
            if bound is not None:
                result = F.when(measured > F.lit(bound), verdict).otherwise(result)
                reason = F.when(measured > F.lit(bound), why).otherwise(reason)
        entries.append(
            F.struct(
                F.lit(limit.metric).alias("metric"), value.cast("bigint").alias("value"), F.round(ratio, 6).alias("ratio"),
                result.alias("result"), reason.alias("reason"),
            )
        )
    carried = [c for c in ("target",) if c in summary.columns]
    return summary.select(*carried, F.inline(F.array(*entries)))


def threshold_verdict(results: DataFrame) -> DataFrame:
    """The worst result over all metrics."""
    return results.agg(
        F.when(F.count_if(F.col("result") == "fail") > 0, "fail")
        .when(F.count_if(F.col("result") == "warning") > 0, "warning")
        .otherwise("pass").alias("overall_result")
    )


def suite_thresholds(
    results: DataFrame,
    max_errors: int = 0,
    max_warnings: int | None = None,
    max_missing_rows: int | None = None,
    max_extra_rows: int | None = None,
    max_different_rows_pct: float | None = None,
) -> DataFrame:
    """``PASS`` / ``FAIL`` and the broken limits for each result row.

    Uses ``error_count`` and ``warning_count`` and, where present, the totals
    of a comparison summary.
    """
    found = set(results.columns)

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in found else F.lit(0)

    checks = [(count("error_count") > max_errors, "error_count")]
    if max_warnings is not None:
        checks.append((count("warning_count") > max_warnings, "warning_count"))
    if max_missing_rows is not None:
        checks.append((count("only_in_left") > max_missing_rows, "missing_rows"))
    if max_extra_rows is not None:
        checks.append((count("only_in_right") > max_extra_rows, "extra_rows"))
    if max_different_rows_pct is not None:
        share = count("rows_with_differences") * 100.0 / F.greatest(count("total_rows_left"), F.lit(1))
        checks.append((share > max_different_rows_pct, "different_rows_pct"))
    broken = F.concat_ws(";", *[F.when(bad, F.lit(name)) for bad, name in checks])
    return results.withColumn("failures", broken).withColumn("status", F.when(broken == "", "PASS").otherwise("FAIL"))


OFF = -1


def gate_thresholds(results: DataFrame, max_error_pct: float = OFF, max_errors: int = OFF, min_rows: int = OFF) -> DataFrame:
    """Adds ``within_limits``; -1 switches a limit off, no rows means 0 %."""
    total, errors = F.col("total_rows"), F.col("error_count")
    ok = F.lit(True)
    if min_rows != OFF:
        ok = ok & (total >= min_rows)
    if max_errors != OFF:
        ok = ok & (errors <= max_errors)
    if max_error_pct != OFF:
        share = F.when(total > 0, errors * 100.0 / total).otherwise(F.lit(0.0))
        ok = ok & (share <= max_error_pct)
    return results.withColumn("within_limits", ok)


def gate_status(steps: DataFrame, pipeline: str = "pipeline") -> DataFrame:
    """Status per gate from step results, with the cut-off of blocking gates.

    ``steps`` has the pipeline column, ``gate_order, gate, blocking`` and
    ``passed``.  Gates after the first failed blocking gate did not run.
    """
    gates = steps.groupBy(pipeline, "gate_order", "gate").agg(
        F.bool_and("passed").alias("ok"), F.bool_or("blocking").alias("blocking")
    )
    cut = gates.groupBy(pipeline).agg(
        F.min(F.when(~F.col("ok") & F.col("blocking"), F.col("gate_order"))).alias("cut"),
        F.bool_and("ok").alias("all_ok"),
    )
    ran = F.col("cut").isNull() | (F.col("gate_order") <= F.col("cut"))
    status = F.when(~ran, "not_run").when(F.col("ok"), "passed").otherwise("failed")
    return gates.join(cut, pipeline).select(
        pipeline, "gate_order", "gate", status.alias("gate_status"),
        F.when(F.col("all_ok"), "passed").otherwise("failed").alias("pipeline_status"),
    )


def overall_status(results: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """``PASS``, ``PARTIAL`` or ``FAIL`` per group of test statuses.

    No passed or skipped test means ``FAIL``; anything besides passed and
    skipped next to them means ``PARTIAL``.
    """
    good = F.col(status).isin("PASS", "SKIPPED")
    return results.groupBy(*by).agg(F.count_if(good).alias("_good"), F.count(F.lit(1)).alias("_all")).select(
        *by,
        F.when(F.col("_good") == 0, "FAIL").when(F.col("_good") == F.col("_all"), "PASS").otherwise("PARTIAL").alias("overall_status"),
    )


# Counters of a bulk loader log.
LOADER_PATTERNS = {
    "rows_loaded": r"(?i)(\d+)\s+Rows?\s+successfully\s+loaded",
    "rows_rejected": r"(?i)(\d+)\s+Rows?\s+not\s+loaded\s+due\s+to\s+data\s+errors",
    "rows_discarded": r"(?i)(\d+)\s+Rows?\s+not\s+loaded\s+because\s+all\s+when\s+clauses\s+were\s+failed",
}


def loader_metrics(logs: DataFrame, max_rejected: int = 0, max_discarded: int = 0, file: str = "file") -> DataFrame:
    """Counters and verdict per loader log; ``logs`` has ``file`` and ``value`` lines.

    Lines are reduced per file, so a log of any size is fine; the first line
    with a counter wins, absent counters are 0.
    """
    found = [
        F.coalesce(F.min_by(F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast("bigint"),
                            F.when(F.col("value").rlike(p), F.col("_row"))), F.lit(0)).alias(n)
        for n, p in LOADER_PATTERNS.items()
    ]
    counted = logs.groupBy(file).agg(*found)
    bad = (F.col("rows_rejected") > max_rejected) | (F.col("rows_discarded") > max_discarded)
    return counted.withColumn("status", F.when(bad, "failed").otherwise("passed"))
