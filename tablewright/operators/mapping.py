"""Source-to-target mappings: rename, clean, transform and mask whole tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import cleanup, masking
from tablewright.functions import transforms as tf


@dataclass(frozen=True)
class FieldMapping:
    """One target column: its source and the clean-up steps, in order."""

    source: str
    target: str
    data_type: str = "string"
    required: bool = False
    steps: tuple = ()
    default: str | None = None


@dataclass(frozen=True)
class Mapping:
    name: str
    fields: tuple
    keys: tuple = ()

    def sources(self) -> list[str]:
        return [f.source for f in self.fields]


def mapping_from_dict(spec: dict) -> Mapping:
    """Read a mapping document (``mappings`` with transformations)."""
    fields = [
        FieldMapping(
            source=m["source_column"],
            target=m.get("target_column", m["source_column"]),
            data_type=m.get("data_type", "string"),
            required=m.get("required", False),
            steps=tuple((s["type"], s.get("parameters", {})) for s in m.get("transformations", [])),
            default=m.get("default_value"),
        )
        for m in spec["mappings"]
    ]
    return Mapping(spec["mapping_name"], tuple(fields), tuple(spec.get("key_columns", ())))


def _require(df: DataFrame, names: list[str]) -> None:
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"columns missing from the source: {gone}")


def map_columns(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Keep the mapped columns under their target names."""
    _require(df, mapping.sources())
    return df.select(*[F.col(f.source).alias(f.target) for f in mapping.fields])


def clean_field(f: FieldMapping) -> Column:
    c = F.col(f.source)
    if f.default is not None:
        c = cleanup.fill_default(c, f.default)
    for kind, params in f.steps:
        c = cleanup.apply_step(c, kind, params)
    return c


def apply_mapping(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Clean every mapped column and rename it, in one projection."""
    _require(df, mapping.sources())
    return df.select(*[clean_field(f).alias(f.target) for f in mapping.fields])


# ---------------------------------------------------------------- transforms
@dataclass(frozen=True)
class Target:
    """A target field: a function of the original row and its width."""

    name: str
    build: object
    length: int = 0


def transform_rows(df: DataFrame, targets: list[Target], keep=()) -> DataFrame:
    """All target fields from the original row; other columns are dropped."""
    return df.select(*keep, *[tf.fit(t.build(), t.length).alias(t.name) for t in targets])


def transform_by_record_type(df: DataFrame, discriminator: str, per_type: dict[str, tuple[str, list[Target]]]) -> DataFrame:
    """A mapping per record type; unknown types pass unchanged.

    ``per_type`` maps a discriminator value to ``(type name, targets)``.  All
    types are served by one projection; a column that a type does not produce
    is null in its rows.
    """
    d = F.coalesce(F.col(discriminator).cast("string"), F.lit(""))
    type_name = F.lit("UNKNOWN")
    built: dict[str, list] = {}
    for value, (name, targets) in per_type.items():
        type_name = F.when(d == value, name).otherwise(type_name)
        for t in targets:
            built.setdefault(t.name, []).append((value, tf.fit(t.build(), t.length)))
    unknown = ~d.isin(*per_type)
    columns = []
    for name in [*df.columns, *[n for n in built if n not in df.columns]]:
        c = F.when(unknown, F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")
        for value, expression in built.get(name, []):
            c = F.when(d == value, expression).otherwise(c)
        columns.append(c.alias(name))
    return df.select(*columns, type_name.alias("_record_type"))


# ------------------------------------------------------------------- masking
def mask_columns(df: DataFrame, spec: dict[str, dict], seed: int = 0) -> DataFrame:
    """Mask named columns; others stay."""
    out = []
    for c in df.columns:
        rule = dict(spec.get(c, {"strategy": "preserve"}))
        out.append(masking.apply_strategy(F.col(c), rule.pop("strategy", "preserve"), rule, seed).alias(c))
    return df.select(*out)


def mask_fixed_width(lines: DataFrame, layout: list, spec: dict[str, dict], seed: int = 0) -> DataFrame:
    """Mask fields of fixed-width lines; every field keeps its width.

    Text between and after the fields is kept, blank lines stay blank.
    """
    raw = F.col("value")
    pieces, at = [], 1
    for f in sorted(layout, key=lambda f: f.start):
        if f.start > at:
            pieces.append(F.substring(raw, at, f.start - at))
        rule = dict(spec.get(f.name, {"strategy": "preserve"}))
        strategy = rule.pop("strategy", "preserve")
        rule.update(length=f.length, format_type="fixed_width")
        masked = masking.apply_strategy(F.substring(raw, f.start, f.length), strategy, rule, seed)
        pieces.append(F.rpad(masked, f.length, " "))
        at = f.start + f.length
    pieces.append(F.substring(raw, at, 2**31 - 1))
    whole = F.when(raw == "", raw).otherwise(F.concat(*pieces))
    return lines.withColumn("value", whole)


def mask_delimited(lines: DataFrame, names: list[str], spec: dict[str, dict], sep: str = "|", seed: int = 0) -> DataFrame:
    """Mask fields of delimited lines; the number of fields stays the same.

    Fields beyond ``names`` are kept and blank lines are dropped.
    """
    import re

    parts = F.split(F.col("value"), re.escape(sep), -1)
    cells = []
    for i, name in enumerate(names):
        rule = dict(spec.get(name, {"strategy": "preserve"}))
        strategy = rule.pop("strategy", "preserve")
        rule["format_type"] = "delimited"
        cells.append(F.when(F.size(parts) > i, masking.apply_strategy(F.get(parts, F.lit(i)), strategy, rule, seed)))
    known = F.filter(F.array(*cells), lambda v: v.isNotNull())
    rest = F.slice(parts, len(names) + 1, F.greatest(F.size(parts) - len(names), F.lit(0)))
    return lines.filter("value <> ''").withColumn("value", F.array_join(F.concat(known, rest), sep))
