"""Text-to-value helpers that never raise under ANSI mode.

Batch files arrive as text, so every rule starts by asking "is it blank?" or
"does it parse?".  All helpers are built-in expressions and stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\r\n\f"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only values; never null."""
    return F.coalesce(strip(c) == "", F.lit(True))


def is_filled(c: Column) -> Column:
    return ~is_blank(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def number(c: Column) -> Column:
    """Parse text as a double, anything else as null.

    The check on the last character keeps out forms that the JVM would accept
    but a data file would not mean as numbers: ``12d``, ``NaN``, ``Infinity``.
    """
    s = strip(c)
    return F.when(s.rlike("[0-9.]$"), s.try_cast("double"))


def decimal(c: Column, kind: str) -> Column:
    """Parse text as a decimal of the given type, anything else as null."""
    s = strip(c)
    return F.when(s.rlike("[0-9.]$"), s.try_cast(kind))


def integer(c: Column) -> Column:
    """Parse text made of an optional sign and digits only."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))


def flag(c: Column) -> Column:
    return F.upper(strip(c)).isin("Y", "YES", "TRUE", "1")


def day(c: Column, fmt: str) -> Column:
    """Parse text as a calendar date in a Spark date pattern, else null."""
    return F.try_to_timestamp(strip(c), F.lit(fmt)).cast("date")


def number_of(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: typed columns are widened, text is parsed."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return number(F.col(name))


def python_date_pattern(fmt: str) -> str:
    """Turn a ``%Y%m%d`` style pattern into the Spark pattern letters."""
    # Strptime codes and their Spark counterparts.
    codes = {
        "%Y": "yyyy",
        "%m": "MM",
        "%d": "dd",
        "%H": "HH",
        "%M": "mm",
        "%S": "ss",
        "%y": "yy",
    }
    for code, letters in codes.items():
        fmt = fmt.replace(code, letters)
    return fmt
