"""Picture formats of fixed-width layouts as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import coerce

DATE_PICTURE = "CCYYMMDD"


def picture_pattern(picture: str | None) -> str | None:
    """Pattern for a whole value, or None when the picture checks nothing.

    ``XXX`` three letters, ``CCYYMMDD`` eight digits, ``9(n)`` and ``S9(n)``
    digits, ``9(n)V9(m)`` with no, optional (S) or required (+) sign, ``X(n)``
    letters, digits and spaces, ``A(n)`` letters and spaces.
    """
    p = (picture or "").upper()
    if p == "XXX":
        return "[A-Za-z]{3}"
    if p == DATE_PICTURE:
        return "[0-9]{8}"
    if re.fullmatch(r"X\(\d+\)", p):
        return "[A-Za-z0-9 ]*"
    if re.fullmatch(r"A\(\d+\)", p):
        return "[A-Za-z ]*"
    m = re.fullmatch(r"([+S]?)9\((\d+)\)(?:V9\((\d+)\))?", p)
    if m is None or (m.group(1) == "+" and m.group(3) is None):
        return None
    sign = {"": "", "S": "[+-]?", "+": "[+-]"}[m.group(1)]
    return f"{sign}[0-9]{{{int(m.group(2)) + int(m.group(3) or 0)}}}"


def picture_holds(c: Column, picture: str | None, digits_only: bool = False) -> Column:
    """True where a value follows the picture; dates must exist in the calendar
    unless ``digits_only``."""
    pattern = picture_pattern(picture)
    if pattern is None:
        return F.lit(True)
    s = coerce.strip(c)
    holds = s.rlike(f"^(?:{pattern})$")
    if picture.upper() == DATE_PICTURE and not digits_only:
        holds = holds & F.try_to_timestamp(s, F.lit("yyyyMMdd")).isNotNull()
    return F.coalesce(holds, F.lit(False))
