"""Scans of text files that hold several record types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.record_types import RecordLayout, RecordType, classify_layouts, classify_records, discriminator
from tablewright.sources.files import read_lines
from tablewright.sources.layouts import LayoutField, slice_fields


def scan_multi_record(
    spark: SparkSession, path: str, types: list[RecordType], position: int, length: int, name_glob: str | None = None
) -> DataFrame:
    """Lines of each file with ``_record_type``, by a discriminator field."""
    return classify_records(read_lines(spark, path, name_glob), types, discriminator(position, length), ["_file"])


def scan_record_layouts(spark: SparkSession, path: str, layouts: list[RecordLayout], name_glob: str | None = None) -> DataFrame:
    """Lines with ``_record_type`` by discriminator, length or default."""
    return classify_layouts(read_lines(spark, path, name_glob).filter("trim(value) <> ''"), layouts)


def records_of(lines: DataFrame, record_type: str, layout: list[LayoutField]) -> DataFrame:
    """The parsed fields of one record type."""
    return slice_fields(lines.filter(F.col("_record_type") == record_type), layout)


def parse_all(lines: DataFrame, layouts: dict[str, list[LayoutField]]) -> DataFrame:
    """One table with the fields of every type; absent fields are null."""
    names: dict[str, list[tuple[str, LayoutField]]] = {}
    for record_type, layout in layouts.items():
        for f in layout:
            names.setdefault(f.name, []).append((record_type, f))
    columns = []
    for name, uses in names.items():
        c = F.lit(None).cast("string")
        for record_type, f in uses:
            c = F.when(F.col("_record_type") == record_type, F.nullif(F.trim(F.substring("value", f.start, f.length)), F.lit(""))).otherwise(c)
        columns.append(c.alias(name))
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, *columns)
