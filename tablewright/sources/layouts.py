"""Fixed-width layouts: slicing lines into fields and rendering them back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import coerce
from tablewright.functions import transforms as tf

CARRIED = ("_row", "_file", "_record_type")


@dataclass(frozen=True)
class LayoutField:
    """A field at a 1-based character position."""

    name: str
    start: int
    length: int
    picture: str | None = None
    required: bool = False
    valid_values: tuple = ()
    data_type: str = "string"

    @property
    def end(self) -> int:
        return self.start + self.length - 1


def layout_from_mapping(mapping: dict) -> list[LayoutField]:
    """Layout of a mapping's ``fields``; without ``position`` they follow each other."""
    fields, at = [], 1
    for f in mapping["fields"]:
        start = int(f["position"]) if f.get("position") is not None else at
        length = int(f["length"])
        fields.append(
            LayoutField(
                name=f.get("name") or f.get("target_name"),
                start=start,
                length=length,
                picture=f.get("format"),
                required=bool(f.get("required", False)),
                valid_values=tuple(f.get("valid_values") or ()),
                data_type=f.get("data_type", "string"),
            )
        )
        at = start + length
    return fields


def line_length(layout: list[LayoutField]) -> int:
    return max(f.end for f in layout)


def raw_field(f: LayoutField) -> Column:
    return F.substring("value", f.start, f.length)


def slice_fields(lines: DataFrame, layout: list[LayoutField]) -> DataFrame:
    """Fields of each line, stripped, blank as null."""
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, *[coerce.blank_to_null(raw_field(f)).alias(f.name) for f in layout])


def scan_fixed_width(spark: SparkSession, path: str, layout: list[LayoutField]) -> DataFrame:
    """Read fixed-width text; lines that are empty are skipped."""
    return slice_fields(spark.read.text(path).filter("value <> ''"), layout)


def render_fixed_width(df: DataFrame, layout: list[LayoutField], keep=()) -> DataFrame:
    """One line per row: every field padded or cut on the right."""
    pieces, at = [], 1
    for f in sorted(layout, key=lambda f: f.start):
        if f.start > at:
            pieces.append(F.lit(" " * (f.start - at)))
        pieces.append(tf.fit(F.col(f.name), f.length))
        at = f.end + 1
    return df.select(*keep, F.concat(*pieces).alias("value"))


def write_fixed_width(df: DataFrame, layout: list[LayoutField], path: str) -> None:
    render_fixed_width(df, layout).write.mode("overwrite").text(path)
