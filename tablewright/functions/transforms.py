"""Field transforms of a source-to-target mapping: text in, text out.

Every function takes and returns a ``Column``; a null source counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import coerce

# Named date conversions as (input, output) patterns.
DATE_PRESETS = {
    "CCYYMMDD": ("yyyy-MM-dd", "yyyyMMdd"),
    "YYYYMMDD": ("yyyy-MM-dd", "yyyyMMdd"),
    "MM/DD/CCYY": ("yyyy-MM-dd", "MM/dd/yyyy"),
    "MM/DD/YYYY": ("yyyy-MM-dd", "MM/dd/yyyy"),
    "MMDDCCYY": ("MMddyyyy", "yyyyMMdd"),
    "MMDDYYYY": ("MMddyyyy", "yyyyMMdd"),
}


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def noop(c: Column) -> Column:
    return text(c)


def default(c: Column, value: str) -> Column:
    return F.when(coerce.is_filled(c), text(c)).otherwise(F.lit(value))


def constant(value: str) -> Column:
    return F.lit(value)


def blank(length: int = 0, fill_char: str = " ", fill_value: str = "") -> Column:
    """``fill_value`` extended with ``fill_char``, or fill characters only."""
    return F.lit(fill_value + fill_char * (length - len(fill_value)) if length > 0 else fill_value)


def pad_left(c: Column, length: int, char: str = " ") -> Column:
    """Pad to a minimum width; longer values stay whole."""
    t = text(c)
    return F.when(F.char_length(t) >= length, t).otherwise(F.lpad(t, length, char))


def pad_right(c: Column, length: int, char: str = " ") -> Column:
    t = text(c)
    return F.when(F.char_length(t) >= length, t).otherwise(F.rpad(t, length, char))


def concat(*parts) -> Column:
    """Join parts; a part is a column or ``(column, width, char)`` to pad it."""
    pieces = [pad_left(*p) if isinstance(p, tuple) else text(p) for p in parts]
    return F.concat(*pieces)


def field_map(name: str) -> Column:
    return text(F.col(name))


def numeric_format(c: Column, length: int, signed: bool = False, decimals: int = 0, default_value: str = "") -> Column:
    """Implied-decimal digits, zero padded, with a leading sign if asked.

    Halves go to the even neighbour; digits are never cut.
    """
    n = coerce.number(c)
    scaled = F.bround(n * F.lit(float(10**decimals)) if decimals > 0 else n, 0).try_cast("decimal(38,0)")
    digits = F.abs(scaled).cast("string")
    width = max(length - 1 if signed else length, 0)
    padded = pad_left(digits, width, "0")
    whole = F.concat(F.when(scaled < 0, "-").otherwise("+"), padded) if signed else padded
    return F.when(scaled.isNotNull(), whole).otherwise(F.lit(default_value))


def date_format(c: Column, in_pattern: str, out_pattern: str, default_value: str = "") -> Column:
    """Rewrite a date; blank and unparseable values give the default."""
    parsed = F.try_to_timestamp(coerce.strip(c), F.lit(in_pattern))
    return F.coalesce(F.date_format(parsed, out_pattern), F.lit(default_value))


def date_preset(c: Column, preset: str, default_value: str = "") -> Column:
    return date_format(c, *DATE_PRESETS[preset], default_value)


def scale(c: Column, factor: float, decimals: int = -1, default_value: str = "") -> Column:
    """Multiply; with ``decimals`` the result has that many places."""
    product = coerce.number(c) * F.lit(float(factor))
    if decimals >= 0:
        shown = F.bround(product, decimals).try_cast(f"decimal(38,{decimals})").cast("string")
    else:
        shown = product.cast("string")
    return F.coalesce(shown, F.lit(default_value))


def pad(c: Column, length: int, char: str = " ", side: str = "right") -> Column:
    if length <= 0:
        return text(c)
    return pad_left(c, length, char) if side == "left" else pad_right(c, length, char)


def truncate(c: Column, length: int, from_end: bool = False) -> Column:
    if length <= 0:
        return text(c)
    return F.right(text(c), F.lit(length)) if from_end else F.left(text(c), F.lit(length))


def fit(c: Column, length: int, char: str = " ") -> Column:
    """Exactly ``length`` characters: padded or cut on the right."""
    return text(c) if length <= 0 else F.rpad(text(c), length, char)


# --------------------------------------------------------------- conditions
def cond_null(c: Column, negate: bool = False) -> Column:
    return coerce.is_filled(c) if negate else coerce.is_blank(c)


def cond_eq(c: Column, value: str, negate: bool = False) -> Column:
    same = coerce.strip(text(c)) == (value or "").strip()
    return ~same if negate else same


def cond_in(c: Column, values: list[str], negate: bool = False) -> Column:
    member = coerce.strip(text(c)).isin(*[v.strip() for v in values])
    return ~member if negate else member


def conditional(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)
