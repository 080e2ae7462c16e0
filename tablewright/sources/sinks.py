"""Writers for several outputs: table exports, expected files, issue sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.operators.violations import ROW, redact_issues, row_identity
from tablewright.sources.delimited import write_delimited
from tablewright.sources.rows import number_rows


def export_tables(tables: dict[str, DataFrame], folder: str, sep: str = "|", header: bool = True) -> dict[str, int]:
    """Write several tables and return their row counts.

    Counts are observed while writing; no table is read twice.
    """
    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        write_delimited(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{folder}/{name}", sep, header)
        counts[name] = seen.get["n"]
    return counts


def batch_expected_outputs(jobs: list[tuple[str, DataFrame]], folder: str, sep: str = "|") -> dict[str, int]:
    """One expected file per transform query."""
    return export_tables(dict(jobs), folder, sep)


def sort_issues(violations: DataFrame, redact: bool = False) -> DataFrame:
    """Issues in reading order with a running index, values hidden on request.

    Issues of whole files come last.  Id columns of the violations (such as
    ``_file``) sort first and are kept.  The index comes from a distributed
    sort.
    """
    shown = redact_issues(violations) if redact else violations
    ids = row_identity(violations)[:-1]
    rows = shown.select(*ids, F.when(F.col("level") == ROW, F.col("row_number")).alias("source_row"), "field", "issue_code", "severity", "message")
    order = [*ids, F.col("source_row").asc_nulls_last(), F.coalesce("field", F.lit("")), "issue_code", "severity", "message"]
    return number_rows(rows, order, "index").select(*ids, "source_row", "index", "severity", "message")


def write_issues(violations: DataFrame, folder: str, redact: bool = False) -> None:
    """Sorted ``errors`` and ``warnings`` sidecars."""
    for name, severities in (("errors", ["error", "critical"]), ("warnings", ["warning"])):
        part = sort_issues(violations.filter(F.col("severity").isin(severities)), redact)
        part.orderBy("index").write.mode("overwrite").csv(f"{folder}/{name}", header=True)
