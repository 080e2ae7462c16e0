"""Repeatable masking: the same value and seed give the same result anywhere.

Random choices are hashes of the seed and the value, so reruns and retried
tasks agree and equal values stay equal across tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = "0123456789"


def preserve(c: Column) -> Column:
    return c


def preserve_format(c: Column, seed: int = 0) -> Column:
    """Each letter and digit becomes another of its kind; the rest stays."""

    def draw(chars: str, i: Column) -> Column:
        at = F.pmod(F.xxhash64(F.lit(seed), c, i), F.lit(len(chars))).cast("int") + 1
        return F.substr(F.lit(chars), at, F.lit(1))

    def one(ch: Column, i: Column) -> Column:
        return (
            F.when(ch.rlike(r"^\p{Lu}$"), draw(UPPER, i))
            .when(ch.rlike(r"^\p{L}$"), draw(LOWER, i))
            .when(ch.rlike(r"^\p{Nd}$"), draw(DIGITS, i))
            .otherwise(ch)
        )

    return F.array_join(F.transform(F.split(c, ""), one), "")


def deterministic_hash(c: Column, length: int | None = None) -> Column:
    """Upper-case SHA-256 digits, repeated as needed and cut to length."""
    digest = F.upper(F.sha2(c, 256))
    if length is None:
        n = F.char_length(c)
        return F.left(F.repeat(digest, F.ceil(n / F.lit(64)).cast("int")), n)
    return F.left(F.repeat(digest, max(1, -(-length // 64))), F.lit(length))


def random_range(c: Column, lo: int = 0, hi: int = 999999, seed: int = 0) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), c), F.lit(hi - lo + 1)) + F.lit(lo)).cast("string")


def redact(c: Column, length: int | None = None, fixed_width: bool = True) -> Column:
    if not fixed_width:
        return F.lit("")
    return F.lit(" " * length) if length is not None else F.repeat(F.lit(" "), F.char_length(c))


def fake_name(c: Column, names: list[str], seed: int = 0) -> Column:
    """One of the caller's replacement names."""
    if not names:
        raise ValueError("fake_name needs replacement names")
    choices = F.array(*[F.lit(n) for n in names])
    return F.element_at(choices, (F.pmod(F.xxhash64(F.lit(seed), c), F.lit(len(names))) + 1).cast("int"))


def apply_strategy(c: Column, strategy: str, options: dict | None = None, seed: int = 0) -> Column:
    o = options or {}
    if strategy == "preserve":
        return preserve(c)
    if strategy == "preserve_format":
        return preserve_format(c, seed)
    if strategy == "deterministic_hash":
        return deterministic_hash(c, o.get("length"))
    if strategy == "random_range":
        return random_range(c, int(o.get("min", 0)), int(o.get("max", 999999)), seed)
    if strategy == "redact":
        return redact(c, o.get("length"), o.get("format_type", "fixed_width") == "fixed_width")
    if strategy == "fake_name":
        return fake_name(c, list(o.get("names", ())), seed)
    raise ValueError(f"unknown masking strategy {strategy!r}")
