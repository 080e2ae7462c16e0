"""Column clean-up steps of a mapping: trim, case, substring, replace, cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import coerce


def trim(c: Column) -> Column:
    return coerce.strip(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def substring(c: Column, start: int = 0, length: int | None = None) -> Column:
    """Slice from a 0-based start."""
    return F.substring(c, start + 1, length) if length else F.substring(c, start + 1, 2**31 - 1)


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def cast_number(c: Column) -> Column:
    return coerce.number(c)


def cast_date(c: Column, pattern: str | None = None) -> Column:
    s = coerce.strip(c)
    return F.try_to_timestamp(s, F.lit(pattern)) if pattern else s.try_cast("timestamp")


def cast_string(c: Column) -> Column:
    return c.cast("string")


def fill_default(c: Column, value: str) -> Column:
    return F.when(coerce.is_filled(c), c.cast("string")).otherwise(F.lit(value))


def apply_step(c: Column, kind: str, p: dict | None = None) -> Column:
    """One named step; an unknown kind leaves the value alone."""
    p = p or {}
    if kind == "trim":
        return trim(c)
    if kind == "upper":
        return upper(c)
    if kind == "lower":
        return lower(c)
    if kind == "substring":
        return substring(c, p.get("start", 0), p.get("length"))
    if kind == "replace":
        return replace(c, p.get("old", ""), p.get("new", "")) if p.get("old") else c
    if kind == "default":
        return fill_default(c, p.get("value", ""))
    if kind == "cast":
        kinds = {"number": cast_number, "date": cast_date}
        return kinds.get(p.get("to_type", "string"), cast_string)(c)
    return c
