"""Rule specifications and their evaluation: field, cross-field and cross-row.

``validate`` is the entry point.  All row-local rules share one scan and one
array expression; cross-row rules that share a key share one aggregation and
one join.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import coerce
from tablewright.operators.groups import rows_of_groups
from tablewright.operators.violations import (
    FILE,
    VIOLATION_COLUMNS,
    ValueCheck,
    explode_checks,
    explode_value_checks,
    literal_violations,
    of_rows,
    row_identity,
    violation,
)

NUMERIC_CHECKS = (">", "<", ">=", "<=", "==", "!=")
GROUP_CHECKS = ("unique", "unique_composite", "consistent", "sequential", "group_count", "group_sum")


# ------------------------------------------------------------------ scopes
class Scope:
    """A condition built when the rule is applied, so rules need no session."""

    def __init__(self, build, text: str):
        self.build = build
        self.text = text

    def __and__(self, other: "Scope") -> "Scope":
        return Scope(lambda: _scope(self) & _scope(other), f"({self.text}) AND ({other.text})")

    def __str__(self) -> str:
        return self.text


def when_equals(name: str, value: str) -> Scope:
    """Rows whose text equals ``value``."""
    return Scope(lambda: F.col(name).cast("string") == value, f"{name} = {value!r}")


def when_differs(name: str, value: str) -> Scope:
    """Rows whose text is not ``value``, nulls included."""
    return Scope(lambda: ~F.coalesce(F.col(name).cast("string") == value, F.lit(False)), f"{name} != {value!r}")


def when_compares(name: str, op: str, value) -> Scope:
    """Numeric scope; a bound that is not a number selects nothing."""
    try:
        bound = float(value)
    except (TypeError, ValueError):
        return Scope(lambda: F.lit(False), "false")
    return Scope(lambda: _compare(coerce.number(F.col(name)), op, F.lit(bound)), f"{name} {op} {bound}")


def when_in(name: str, values: list[str]) -> Scope:
    return Scope(lambda: F.col(name).cast("string").isin(*[str(v) for v in values]), f"{name} in {list(values)}")


def _scope(when) -> Column:
    """A scope given as Spark SQL text, ``Column`` or ``Scope``; null is false."""
    if when is None:
        return F.lit(True)
    if isinstance(when, Scope):
        cond = when.build()
    else:
        cond = F.expr(when) if isinstance(when, str) else when
    return F.coalesce(cond, F.lit(False))


def _compare(left: Column, op: str, right: Column) -> Column:
    if op == ">":
        return left > right
    if op == "<":
        return left < right
    if op == ">=":
        return left >= right
    if op == "<=":
        return left <= right
    if op in ("==", "="):
        return left == right
    if op == "!=":
        return left != right
    raise ValueError(f"unknown comparison {op!r}")


# ------------------------------------------------------------------- specs
@dataclass(frozen=True)
class FieldRule:
    """A check on one column.

    ``check`` is a comparison sign or one of ``in, not_in, range, regex,
    not_null, not_empty, length, min_length, max_length, exact_length,
    min_value, max_value, valid_values, numeric, integer, float,
    date_format``.
    """

    id: str
    field: str
    check: str
    value: object = None
    values: tuple = ()
    min: object = None
    max: object = None
    pattern: str | None = None
    name: str | None = None
    severity: str = "error"
    description: str | None = None
    when: object = None
    enabled: bool = True
    issue_code: str | None = None


@dataclass(frozen=True)
class CrossFieldRule:
    """A comparison of two columns, or ``depends_on`` / ``mutually_exclusive``.

    ``compare_as`` is ``number`` (default), ``date`` or ``string``; dates are
    read with ``date_pattern`` when the columns hold text.
    """

    id: str
    check: str
    left: str | None = None
    right: str | None = None
    fields: tuple = ()
    compare_as: str = "number"
    date_pattern: str = "yyyyMMdd"
    name: str | None = None
    severity: str = "error"
    description: str | None = None
    when: object = None
    enabled: bool = True


@dataclass(frozen=True)
class GroupRule:
    """A check on groups of rows that share ``keys``."""

    id: str
    check: str
    keys: tuple
    target: str | None = None
    min: float | None = None
    max: float | None = None
    scale: int | None = None
    name: str | None = None
    severity: str = "error"
    description: str | None = None
    when: object = None
    enabled: bool = True


@dataclass(frozen=True)
class RuleSet:
    rules: tuple = dc_field(default_factory=tuple)

    def active(self) -> list:
        return [r for r in self.rules if r.enabled]


def rule_from_dict(spec: dict):
    """Build a rule from its dictionary form (a JSON rule file entry).

    ``when`` is a Spark SQL predicate.
    """
    kind = spec.get("type", "field_validation")
    common = {
        "id": spec["id"],
        "name": spec.get("name"),
        "severity": spec.get("severity", "error"),
        "description": spec.get("description"),
        "when": spec.get("when"),
        "enabled": spec.get("enabled", True),
    }
    if kind == "field_validation":
        values = spec.get("values") or ()
        if isinstance(values, str):
            values = values.split(",")
        lo, hi = spec.get("min"), spec.get("max")
        if spec.get("operator") == "length":
            lo, hi = spec.get("min_length", lo), spec.get("max_length", hi)
        return FieldRule(
            field=spec["field"],
            check=spec["operator"],
            value=spec.get("value", spec.get("format")),
            values=tuple(values),
            min=lo,
            max=hi,
            pattern=spec.get("pattern"),
            **common,
        )
    if kind == "cross_field":
        return CrossFieldRule(
            check=spec["operator"],
            left=spec.get("left_field"),
            right=spec.get("right_field"),
            fields=tuple(spec.get("fields", ())),
            compare_as=spec.get("compare_as", "number"),
            date_pattern=spec.get("date_pattern", "yyyyMMdd"),
            **common,
        )
    if kind == "cross_row":
        check = spec["check"]
        if check == "unique":
            keys = (spec["field"],)
        elif check == "unique_composite":
            keys = tuple(spec["fields"])
        else:
            keys = (spec["key_field"],)
        target = next(
            (spec[k] for k in ("target_field", "sequence_field", "count_field", "sum_field") if k in spec), None
        )
        return GroupRule(
            check=check, keys=keys, target=target, min=spec.get("min_value"), max=spec.get("max_value"), **common
        )
    raise ValueError(f"unknown rule type {kind!r}")


# ------------------------------------------------------- row-local verdicts
def field_is_bad(df: DataFrame, r: FieldRule) -> Column:
    """True where the value of ``r.field`` breaks the rule; never null.

    Comparisons and ``range`` fail on values that do not parse, ``!=`` passes
    on them; ``in`` and ``regex`` fail on null, ``not_in`` passes; ``length``
    sees null as length 0; ``numeric`` and ``date_format`` skip blanks.
    """
    c = F.col(r.field)
    no = F.lit(False)
    if r.check in NUMERIC_CHECKS:
        holds = _compare(coerce.number_of(df, r.field), r.check, F.lit(float(r.value)))
        return ~F.coalesce(holds, F.lit(r.check == "!="))
    if r.check in ("min_value", "max_value"):
        return field_is_bad(df, replace(r, check=">=" if r.check == "min_value" else "<="))
    if r.check in ("in", "valid_values"):
        return ~F.coalesce(coerce.strip(c).isin(*[str(v).strip() for v in r.values]), no)
    if r.check == "not_in":
        return F.coalesce(coerce.strip(c).isin(*[str(v).strip() for v in r.values]), no)
    if r.check == "range":
        n = coerce.number_of(df, r.field)
        inside = n.isNotNull()
        if r.min is not None:
            inside = inside & (n >= F.lit(float(r.min)))
        if r.max is not None:
            inside = inside & (n <= F.lit(float(r.max)))
        return ~F.coalesce(inside, no)
    if r.check == "regex":
        return ~F.coalesce(coerce.strip(c).rlike(f"^(?:{r.pattern})"), no)
    if r.check in ("not_null", "not_empty"):
        return coerce.is_blank(c)
    if r.check in ("length", "min_length", "max_length", "exact_length"):
        lo, hi = r.min, r.max
        if r.check in ("min_length", "exact_length"):
            lo = r.value
        if r.check in ("max_length", "exact_length"):
            hi = r.value
        n = F.coalesce(F.char_length(c.cast("string")), F.lit(0))
        bad = no
        if lo is not None:
            bad = bad | (n < F.lit(int(lo)))
        if hi is not None:
            bad = bad | (n > F.lit(int(hi)))
        return bad
    if r.check in ("numeric", "float"):
        return coerce.is_filled(c) & coerce.number_of(df, r.field).isNull()
    if r.check == "integer":
        return coerce.is_filled(c) & coerce.integer(c).isNull()
    if r.check == "date_format":
        return coerce.is_filled(c) & ~F.coalesce(date_format_holds(c, str(r.value or ""), strict=r.pattern != "digits"), no)
    raise ValueError(f"unknown field check {r.check!r}")


# Date format names and their Spark patterns.
DATE_FORMAT_NAMES = {
    "CCYYMMDD": "yyyyMMdd",
    "YYYYMMDD": "yyyyMMdd",
    "MMDDYYYY": "MMddyyyy",
}


def date_format_holds(c: Column, fmt: str, strict: bool = True) -> Column:
    """Digits of the right count, and (strict) a day that exists."""
    pattern = DATE_FORMAT_NAMES.get(fmt.upper())
    s = coerce.strip(c)
    if pattern is None:
        return s.rlike(r"^\d+$")
    digits = s.rlike(r"^\d{8}$")
    return digits & F.try_to_timestamp(s, F.lit(pattern)).isNotNull() if strict else digits


def cross_is_bad(df: DataFrame, r: CrossFieldRule) -> Column:
    if r.check == "depends_on":
        return coerce.is_filled(F.col(r.right)) & coerce.is_blank(F.col(r.left))
    if r.check == "mutually_exclusive":
        filled = [coerce.is_filled(F.col(n)).cast("int") for n in r.fields if n in df.columns]
        return reduce(lambda a, b: a + b, filled) > 1 if filled else F.lit(False)
    if r.compare_as == "number":
        left, right = coerce.number_of(df, r.left), coerce.number_of(df, r.right)
    elif r.compare_as == "date":
        left, right = [
            coerce.day(F.col(n), r.date_pattern) if df.schema[n].dataType.typeName() == "string" else F.col(n)
            for n in (r.left, r.right)
        ]
    else:
        left, right = F.col(r.left).cast("string"), F.col(r.right).cast("string")
    return ~F.coalesce(_compare(left, r.check, right), F.lit(r.check == "!="))


def _expected(r: FieldRule) -> str | None:
    if r.value is not None:
        return str(r.value)
    if r.values:
        return ",".join(str(v).strip() for v in r.values)
    return r.pattern


def _code(rule_id: str, kind: str) -> str:
    return f"BR_{rule_id.upper().replace(' ', '_')}_{kind}"


def _label(r) -> str:
    return r.description or r.name or r.id


def _columns_needed(r) -> list[str]:
    if isinstance(r, FieldRule):
        return [r.field]
    if isinstance(r, CrossFieldRule):
        return [] if r.check == "mutually_exclusive" else [r.left, r.right]
    return list(r.keys) + ([r.target] if r.target else [])


def row_check(df: DataFrame, r) -> ValueCheck:
    """A field or cross-field rule as a check on the columns of ``df``."""
    if isinstance(r, FieldRule):
        value = F.col(r.field).cast("string")
        bad = field_is_bad(df, r)
        shown, expected, kind = r.field, _expected(r), "FIELD"
    else:
        names = [n for n in r.fields if n in df.columns] if r.check == "mutually_exclusive" else [r.left, r.right]
        value = F.concat_ws(" vs ", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
        bad = cross_is_bad(df, r)
        shown, expected, kind = ", ".join(names), f"{names[0]} {r.check} {names[-1]}", "CROSS"
    code = getattr(r, "issue_code", None) or _code(r.id, kind)
    return ValueCheck(_scope(r.when) & bad, r.id, r.name or r.id, r.severity, shown, value, expected, code, f"{_label(r)} (got: ", ")")


# ------------------------------------------------------ cross-row verdicts
def _group_metrics(df: DataFrame, i: int, r: GroupRule, row_number: Column) -> list[Column]:
    if r.check == "consistent":
        t = F.col(r.target)
        return [F.min(t).alias(f"_lo{i}"), F.max(t).alias(f"_hi{i}")]
    if r.check == "sequential":
        # A fraction or a number beyond 64 bits is no sequence number: it counts as missing, so the group is bad.
        n = coerce.number_of(df, r.target)
        s = F.when(n == F.floor(n), n.try_cast("bigint"))
        return [F.count_distinct(s).alias(f"_d{i}"), F.min(s).alias(f"_lo{i}"), F.max(s).alias(f"_hi{i}")]
    if r.check == "group_count":
        n = coerce.number_of(df, r.target)
        return [F.min_by(n, F.when(n.isNotNull(), row_number)).alias(f"_v{i}")]
    if r.check == "group_sum":
        n = F.coalesce(coerce.number_of(df, r.target), F.lit(0.0))
        return [F.sum(n.try_cast(f"decimal(30,{r.scale})") if r.scale is not None else n).alias(f"_v{i}")]
    return []


def _group_is_bad(i: int, r: GroupRule) -> Column:
    n = F.col("_n")
    if r.check in ("unique", "unique_composite"):
        return n > 1
    if r.check == "consistent":
        return F.coalesce(F.col(f"_lo{i}") != F.col(f"_hi{i}"), F.lit(False))
    if r.check == "sequential":
        whole = (F.col(f"_d{i}") == n) & (F.col(f"_lo{i}") == 1) & (F.col(f"_hi{i}") == n)
        return ~F.coalesce(whole, F.lit(False))
    if r.check == "group_count":
        return F.coalesce(F.col(f"_v{i}") != n, F.lit(False))
    bad = F.lit(False)
    if r.min is not None:
        bad = bad | (F.col(f"_v{i}") < F.lit(r.min))
    if r.max is not None:
        bad = bad | (F.col(f"_v{i}") > F.lit(r.max))
    return F.coalesce(bad, F.lit(False))


def _plain_number(n: Column) -> Column:
    """A whole number without decimals, any other as it is."""
    return F.coalesce(F.when(n == F.floor(n), n.try_cast("bigint").cast("string")), n.cast("string"))


def _group_message(i: int, r: GroupRule, value: Column) -> Column:
    shown = F.coalesce(value, F.lit("null"))
    label = _label(r)
    key = r.keys[0]
    group = F.concat(F.lit(f"{key} = "), F.col(key).cast("string"))
    if r.check == "unique":
        return F.concat(F.lit(f"{label}: more than one row has {key} = "), shown)
    if r.check == "unique_composite":
        return F.concat(F.lit(f"{label}: more than one row has ("), shown, F.lit(")"))
    if r.check == "consistent":
        return F.concat(F.lit(f"{label}: rows with "), group, F.lit(f" disagree on {r.target}"))
    if r.check == "sequential":
        return F.concat(F.lit(f"{label}: {r.target} does not count 1, 2, 3 and on where "), group)
    if r.check == "group_count":
        return F.concat(F.lit(f"{label}: "), group, F.lit(" has "), F.col("_n").cast("string"), F.lit(" rows and declares "), _plain_number(F.col(f"_v{i}")))
    return F.concat(F.lit(f"{label}: {r.target} adds up to "), F.col(f"_v{i}").cast("string"), F.lit(" where "), group, F.lit(f", outside [{r.min}, {r.max}]"))


def shared_keys(rules: list[GroupRule]) -> list[list[GroupRule]]:
    """Cross-row rules by common keys and scope, in order."""
    shared: dict = {}
    for r in rules:
        shared.setdefault((r.keys, r.check == "unique_composite", str(r.when)), []).append(r)
    return list(shared.values())


def group_columns(rules: list[GroupRule], within=()) -> list[str]:
    keys = list(rules[0].keys)
    return [*keys, *[c for c in within if c not in keys]]


def group_members(df: DataFrame, rules: list[GroupRule], row_number: Column, ids=(), within=()) -> DataFrame:
    """The rows that cross-row rules with shared keys look at, with only the columns that they need."""
    first = rules[0]
    shared = group_columns(rules, within)
    rows = df.filter(_scope(first.when)) if first.when is not None else df
    if first.check != "unique_composite":
        rows = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in first.keys]))
    carried = [c for c in ids if c not in shared]
    targets = sorted({r.target for r in rules if r.target and r.target not in [*shared, *carried]})
    return rows.select(row_number.cast("bigint").alias("row_number"), *shared, *carried, *targets)


def group_partials(rows: DataFrame, rules: list[GroupRule], within=()) -> DataFrame:
    """What the verdicts need of some members, in a form that adds up.

    One row per group; where a rule asks for a sequence, one per group and
    number, because only those can be counted across parts.
    """
    numbers = {}
    for i, r in enumerate(rules):
        if r.check == "sequential":
            n = coerce.number_of(rows, r.target)
            numbers[f"_s{i}"] = F.when(n == F.floor(n), n.try_cast("bigint"))
    metrics = [F.count(F.lit(1)).alias("_n")]
    for i, r in enumerate(rules):
        if r.check == "group_count":
            n = coerce.number_of(rows, r.target)
            metrics.append(F.min(F.when(n.isNotNull(), F.struct(F.col("row_number").alias("at"), n.alias("v")))).alias(f"_v{i}"))
        elif r.check != "sequential":
            metrics += _group_metrics(rows, i, r, F.col("row_number"))
    return rows.withColumns(numbers).groupBy(*group_columns(rules, within), *numbers).agg(*metrics)


def merged_groups(partials: DataFrame, rules: list[GroupRule], within=()) -> DataFrame:
    """Partials of any number of parts as one row per group."""
    metrics = [F.sum("_n").alias("_n")]
    for i, r in enumerate(rules):
        if r.check == "consistent":
            metrics += [F.min(f"_lo{i}").alias(f"_lo{i}"), F.max(f"_hi{i}").alias(f"_hi{i}")]
        elif r.check == "sequential":
            metrics += [F.count_distinct(f"_s{i}").alias(f"_d{i}"), F.min(f"_s{i}").alias(f"_lo{i}"), F.max(f"_s{i}").alias(f"_hi{i}")]
        elif r.check == "group_count":
            metrics.append(F.min(f"_v{i}")["v"].alias(f"_v{i}"))
        elif r.check == "group_sum":
            metrics.append(F.sum(f"_v{i}").alias(f"_v{i}"))
    return partials.groupBy(*group_columns(rules, within)).agg(*metrics)


def member_violations(rows: DataFrame, groups: DataFrame, rules: list[GroupRule], ids=(), within=()) -> DataFrame:
    """The violations of members whose group breaks a rule; rows meet their group once."""
    first = rules[0]
    keys, shared = list(first.keys), group_columns(rules, within)
    composite = first.check == "unique_composite"
    any_bad = reduce(lambda a, b: a | b, [_group_is_bad(i, r) for i, r in enumerate(rules)])
    joined = rows_of_groups(rows, groups, shared, "_n", any_bad, null_safe=composite or len(shared) > len(keys))

    checks = []
    for i, r in enumerate(rules):
        if composite:
            value = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
            shown = ", ".join(keys)
        else:
            shown = r.target or keys[0]
            value = F.col(shown).cast("string")
        what = violation(
            r.id, r.name or r.id, r.severity, shown, value, _group_message(i, r, value), None, _code(r.id, "CROSS")
        )
        checks.append((_group_is_bad(i, r), what))
    return explode_checks(joined, F.col("row_number"), checks, ids)


def group_violations(df: DataFrame, rules: list[GroupRule], row_number: Column, ids=(), within=()) -> DataFrame:
    """Violations of cross-row rules that share keys and scope.

    One aggregation serves all rules; groups that break any of them are joined
    back to their rows once.  Groups never cross the columns ``within``.
    """
    rows = group_members(df, rules, row_number, ids, within)
    metrics = [F.count(F.lit(1)).alias("_n")]
    for i, r in enumerate(rules):
        metrics += _group_metrics(df, i, r, F.col("row_number"))
    groups = rows.groupBy(*group_columns(rules, within)).agg(*metrics)
    return member_violations(rows, groups, rules, ids, within)


# ------------------------------------------------------------------- entry
def validate(df: DataFrame, rules, row_id="_row", ids=None, within=()) -> DataFrame:
    """All violations of ``rules`` in ``df``.

    ``row_id`` names (or is) the column that numbers a row in the output, and
    ``ids`` the columns that tell rows with one number apart; by default that
    is ``_file``, if there is one.  Cross-row rules look at all rows, or at
    those that agree in the columns ``within``.  A rule whose column does not
    exist yields one ``info`` finding at file level instead of silently
    passing; on a stream, which can not carry such a row, it is an error.
    """
    row_number = F.col(row_id) if isinstance(row_id, str) else row_id
    ids = [c for c in ("_file",) if c in df.columns and not (isinstance(row_id, str) and row_id == c)] if ids is None else list(ids)
    active = rules.active() if isinstance(rules, RuleSet) else [r for r in rules if r.enabled]
    known = set(df.columns)
    skipped = [r for r in active if any(n not in known for n in _columns_needed(r)) or _nothing_to_compare(r, known)]
    if skipped and df.isStreaming:
        raise ValueError(f"rules without their columns on a stream: {', '.join(r.id for r in skipped)}")
    usable = [r for r in active if r not in skipped]

    parts = []
    row_rules = [r for r in usable if not isinstance(r, GroupRule)]
    if row_rules:
        parts.append(explode_value_checks(df, row_number, [row_check(df, r) for r in row_rules], ids))
    group_rules = [r for r in usable if isinstance(r, GroupRule)]
    parts += [group_violations(df, same_key, row_number, ids, within) for same_key in shared_keys(group_rules)]
    if skipped or not parts:
        rows = []
        for r in skipped:
            gone = ", ".join(n for n in _columns_needed(r) or r.fields if n not in known)
            rows.append((r.id, r.name or r.id, "info", 0, gone, None, f"rule skipped, no column {gone}", None, "SKIPPED", FILE))
        nameless = {c: F.lit(None).cast(df.schema[c].dataType) for c in ids}
        parts.append(literal_violations(df.sparkSession, rows).withColumns(nameless) if ids else literal_violations(df.sparkSession, rows))
    return reduce(DataFrame.unionByName, parts).select(*ids, *VIOLATION_COLUMNS)


def _nothing_to_compare(r, known: set[str]) -> bool:
    return isinstance(r, CrossFieldRule) and r.check == "mutually_exclusive" and not any(n in known for n in r.fields)


def is_clean(df: DataFrame, rules) -> Column:
    """True where a row passes every row-local rule (no violations are built)."""
    bad = [row_check(df, r).bad for r in rules if not isinstance(r, GroupRule)]
    return ~reduce(lambda a, b: a | b, bad)


def rule_statistics(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Counts per rule and severity, and the share of rows without violation.

    Violations are first reduced per row, so no distinct over the wide
    violation rows is needed.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_row = of_rows(violations).groupBy(*row_identity(violations)).agg(F.lit(1).alias("one"))
    affected = per_row.agg(F.count("one").alias("n")).scalar()
    rate = F.when(total > 0, F.round((total - affected) * 100.0 / total, 2)).otherwise(F.lit(100.0))
    counts = violations.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("violations"))
    return counts.withColumn("compliance_rate", rate.cast("double"))
