"""Files that mix record types: classification and checks between the types.

Records carry ``_record_type``, a row number ``_row`` and one or more batch
columns (a file, a batch id).  Every check works per batch, for any number of
batches at once; rows meet their batch's totals through
``rows_of_groups``, so one batch may hold most of the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import coerce
from tablewright.operators.groups import rows_of_groups
from tablewright.operators.rules import validate
from tablewright.operators.violations import FILE, VIOLATION_COLUMNS, VIOLATION_SCHEMA, explode_found, violation
from tablewright.session import written_once
from tablewright.sources.layouts import slice_fields

WHOLE = "_batch"
TYPE = "_record_type"


@dataclass(frozen=True)
class RecordType:
    """A type known by its discriminator value, or by being first or last."""

    name: str
    match: str | None = None
    position: str | None = None
    expect: str = "any"


@dataclass(frozen=True)
class RecordLayout:
    """A type for files without one discriminator: tried in the order
    discriminator, line length, default."""

    name: str
    discriminator: tuple | None = None
    length: int | None = None
    default: bool = False


def discriminator(position: int, length: int) -> Column:
    return coerce.strip(F.substring("value", position, length))


def classify_records(
    lines: DataFrame, types: list[RecordType], disc: Column, batch: list[str] | None = None, row: str = "_row"
) -> DataFrame:
    """Adds ``_record_type``; lines of no known type get null.

    Blank lines are dropped.  The first and last line of a batch go to the
    types that claim those positions, whatever their discriminator says.
    """
    rows = lines.filter(coerce.is_filled(F.col("value"))) if "value" in lines.columns else lines
    kind = F.lit(None).cast("string")
    for t in reversed([t for t in types if t.match]):
        kind = F.when(disc == t.match, t.name).otherwise(kind)
    first = next((t.name for t in types if t.position == "first"), None)
    last = next((t.name for t in types if t.position == "last"), None)
    if first is None and last is None:
        return rows.withColumn(TYPE, kind)
    keys = batch or [WHOLE]
    keyed = rows if batch else rows.withColumn(WHOLE, F.lit(0))
    ends = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_lo"), F.max(row).alias("_hi"))
    placed = rows_of_groups(keyed, ends, keys, "_n")
    if last is not None:
        kind = F.when(F.col(row) == F.col("_hi"), last).otherwise(kind)
    if first is not None:
        kind = F.when(F.col(row) == F.col("_lo"), first).otherwise(kind)
    return placed.withColumn(TYPE, kind).select(*rows.columns, TYPE)


def classify_layouts(lines: DataFrame, layouts: list[RecordLayout]) -> DataFrame:
    """Adds ``_record_type`` and ``_ambiguous`` (names that match on one level).

    A line that matches two types on the first level where any matches is
    ambiguous and keeps a null type.
    """

    def names(level) -> Column:
        found = [F.when(cond, F.lit(l.name)) for l, cond in level]
        return F.filter(F.array(*found), lambda n: n.isNotNull()) if found else F.array().cast("array<string>")

    by_value = names([(l, coerce.strip(F.substring("value", l.discriminator[0], l.discriminator[1])) == l.discriminator[2]) for l in layouts if l.discriminator])
    by_length = names([(l, F.char_length("value") == l.length) for l in layouts if l.length is not None and not l.discriminator])
    fallback = names([(l, F.lit(True)) for l in layouts if l.default])
    chosen = F.when(F.size(by_value) > 0, by_value).when(F.size(by_length) > 0, by_length).otherwise(fallback)
    return (
        lines.withColumn("_found", chosen)
        .withColumn(TYPE, F.when(F.size("_found") == 1, F.get("_found", F.lit(0))))
        .withColumn("_ambiguous", F.when(F.size("_found") > 1, F.array_join("_found", ",")))
        .drop("_found")
    )


def unknown_records(records: DataFrame, disc: Column, action: str = "warn", batch: list[str] | None = None) -> DataFrame:
    """Violations for lines of no known type (``skip``, ``warn``, ``error``)."""
    severity = "error" if action == "error" else "warning"
    message = F.concat(F.lit("no record type for mark "), disc)
    what = violation("CT_UNKNOWN_RECORD_TYPE", "unknown_record_type", severity, "discriminator", disc, message, None, "CT_UNKNOWN")
    rows = records.filter(F.col(TYPE).isNull() & F.lit(action != "skip"))
    return _finish(rows.select(*(batch or []), F.col("_row").cast("bigint").alias("row_number"), what.alias("v")), batch)


def _finish(found: DataFrame, batch: list[str] | None) -> DataFrame:
    return found.select(*(batch or []), "row_number", "v.*").select(*(batch or []), *VIOLATION_COLUMNS)


def _keyed(records: DataFrame, batch: list[str] | None) -> tuple[DataFrame, list[str]]:
    return (records, batch) if batch else (records.withColumn(WHOLE, F.lit(0)), [WHOLE])


def _totals(keyed: DataFrame, keys: list[str], batch: list[str] | None, aggs: list[Column]) -> DataFrame:
    """One row per batch; a whole-table check yields a row for no rows too."""
    if batch:
        return keyed.groupBy(*keys).agg(*aggs)
    return keyed.agg(*aggs).withColumn(WHOLE, F.lit(0))


def _of(name: str) -> Column:
    return F.coalesce(F.col(TYPE) == name, F.lit(False))


def _amount(fields: list[str], kind: str) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(coerce.decimal(F.col(c), kind), F.lit(0).cast(kind)) for c in fields])


def _aggregate(figure: tuple) -> Column:
    """``("count", type)`` or ``("sum", type, fields, scale)`` of a batch."""
    if figure[0] == "count":
        return F.count_if(_of(figure[1]))
    _, name, fields, scale = figure
    return F.coalesce(F.sum(F.when(_of(name), _amount(fields, f"decimal(28,{scale})"))), F.lit(0))


class BatchFigures:
    """Counts and sums per batch that several checks read: one aggregation, written once."""

    def __init__(self, records: DataFrame, batch: list[str] | None, figures: list[tuple]):
        keyed, keys = _keyed(records, batch)
        self.names = {f: f"_f{i}" for i, f in enumerate(dict.fromkeys(figures))}
        self.table = written_once(_totals(keyed, keys, batch, [_aggregate(f).alias(n) for f, n in self.names.items()]))


def _figures(keyed: DataFrame, keys: list[str], batch: list[str] | None, shared: BatchFigures | None, **wanted: tuple) -> DataFrame:
    """One row per batch with the wanted figures, from the shared table if there is one."""
    if shared is None:
        return _totals(keyed, keys, batch, [_aggregate(f).alias(n) for n, f in wanted.items()])
    return shared.table.select(*keys, *[F.col(shared.names[f]).alias(n) for n, f in wanted.items()])


def _file_level(found: DataFrame, check: str, severity: str, field: str, value: Column, message: Column, batch, code: str | None = None, rule: str | None = None) -> DataFrame:
    what = violation(rule or f"CT_{check}", check, severity, field, value, message, None, code or f"CT_{check.upper().replace('_', '-')}", FILE)
    return _finish(found.select(*(batch or []), F.lit(0).cast("bigint").alias("row_number"), what.alias("v")), batch)


def expect_cardinality(records: DataFrame, types: list[RecordType], batch: list[str] | None = None) -> DataFrame:
    """``exactly_one`` and ``at_least_one`` per type and batch."""
    keyed, keys = _keyed(records, batch)
    counts = _totals(keyed, keys, batch, [F.count_if(_of(t.name)).alias(f"n{i}") for i, t in enumerate(types)])
    found = []
    for i, t in enumerate(types):
        n = F.col(f"n{i}")
        shown = n.cast("string")
        if t.expect == "exactly_one":
            bad, code, text = n != 1, "CT_EXPECT_EXACTLY_ONE", f"{t.name}: one row wanted, rows there: "
        elif t.expect == "at_least_one":
            bad, code, text = n < 1, "CT_EXPECT_AT_LEAST_ONE", f"{t.name}: some row wanted, rows there: "
        else:
            continue
        message = F.concat(F.lit(text), shown)
        found.append(F.when(bad, violation("CT_EXPECT", "expect_cardinality", "error", t.name, shown, message, None, code, FILE)))
    kept = [*(batch or []), F.lit(0).cast("bigint").alias("row_number")]
    return explode_found(counts, kept, F.array(*found)).select(*(batch or []), *VIOLATION_COLUMNS)


def required_companion(records: DataFrame, when_type: str, requires_type: str, batch=None, severity: str = "error", shared: BatchFigures | None = None) -> DataFrame:
    """Batches that hold one type but not the type it needs."""
    keyed, keys = _keyed(records, batch)
    found = _figures(keyed, keys, batch, shared, a=("count", when_type), b=("count", requires_type)).filter("a > 0 AND b = 0")
    message = F.lit(f"{when_type} rows come without any {requires_type} row")
    return _file_level(found, "required_companion", severity, requires_type, F.lit(None), message, batch)


def expect_count(records: DataFrame, record_type: str, exactly: int, batch=None, severity: str = "error", shared: BatchFigures | None = None) -> DataFrame:
    keyed, keys = _keyed(records, batch)
    found = _figures(keyed, keys, batch, shared, n=("count", record_type)).filter(F.col("n") != exactly)
    shown = F.col("n").cast("string")
    message = F.concat(F.lit(f"{record_type}: {exactly} rows wanted, rows there: "), shown)
    return _file_level(found, "expect_count", severity, "row_count", shown, message, batch)


def header_trailer_count(records: DataFrame, record_type: str, declared: str, count_of: str, batch=None, severity: str = "error", shared: BatchFigures | None = None) -> DataFrame:
    """A declared number of rows against the rows of another type."""
    keyed, keys = _keyed(records, batch)
    totals = _figures(keyed, keys, batch, shared, _actual=("count", count_of), _n=("count", record_type))
    wanted = F.col(declared).cast("string")
    rows = rows_of_groups(keyed.filter(_of(record_type)).select(*keys, declared), totals, keys, "_n")
    found = rows.filter(coerce.integer(wanted) != F.col("_actual"))
    message = F.concat(F.lit(f"{record_type}.{declared} counts "), wanted, F.lit(f", {count_of} rows there: "), F.col("_actual").cast("string"))
    return _file_level(found, "header_trailer_count", severity, declared, wanted, message, batch)


def header_trailer_sum(
    records: DataFrame, record_type: str, declared: str, count_of: str, sum_of: list[str], batch=None, scale: int = 4, tolerance: float = 1e-9, severity: str = "error",
    shared: BatchFigures | None = None,
) -> DataFrame:
    """A declared total against the sum of one or more detail fields.

    Amounts and totals are read as decimals, so no cent is lost in large sums
    and the order of rows does not matter.
    """
    keyed, keys = _keyed(records, batch)
    totals = _figures(keyed, keys, batch, shared, _actual=("sum", count_of, tuple(sum_of), scale), _n=("count", record_type))
    wanted = F.col(declared).cast("string")
    rows = rows_of_groups(keyed.filter(_of(record_type)).select(*keys, declared), totals, keys, "_n")
    found = rows.filter(F.abs(coerce.decimal(wanted, "decimal(38,9)") - F.col("_actual").cast("decimal(38,9)")) > F.lit(tolerance).cast("decimal(38,9)"))
    message = F.concat(F.lit(f"{record_type}.{declared} totals "), wanted, F.lit(f", {count_of} rows add up to "), F.col("_actual").cast("string"))
    return _file_level(found, "header_trailer_sum", severity, declared, wanted, message, batch)


def header_detail_consistent(
    records: DataFrame, header_field: str, detail_field: str, header_type: str = "header", detail_type: str = "detail", batch=None, row: str = "_row", severity: str = "error"
) -> DataFrame:
    """Detail rows whose field differs from the first header's field."""
    keyed, keys = _keyed(records, batch)
    head = F.min_by(F.col(header_field).cast("string"), F.when(_of(header_type), F.col(row)))
    totals = _totals(keyed, keys, batch, [head.alias("_head"), F.count_if(_of(detail_type)).alias("_n")])
    detail = keyed.filter(_of(detail_type)).select(*keys, row, F.col(detail_field).cast("string").alias("_detail"))
    found = rows_of_groups(detail, totals, keys, "_n", F.col("_head").isNotNull()).filter(coerce.strip(F.col("_detail")) != coerce.strip(F.col("_head")))
    message = F.concat(F.lit(f"{detail_field} is "), F.col("_detail"), F.lit(f", the header's {header_field} is "), F.col("_head"))
    what = violation("CT_header_detail_consistent", "header_detail_consistent", severity, detail_field, F.col("_detail"), message, None, "CT_HEADER-DETAIL-CONSISTENT")
    return _finish(found.select(*(batch or []), F.col(row).cast("bigint").alias("row_number"), what.alias("v")), batch)


def header_trailer_match(
    records: DataFrame, header_field: str, trailer_field: str, header_type: str = "header", trailer_type: str = "trailer", batch=None, row: str = "_row", severity: str = "error"
) -> DataFrame:
    """The first header's field against the first trailer's field."""
    keyed, keys = _keyed(records, batch)

    def first(field: str, name: str) -> Column:
        return F.min_by(F.col(field).cast("string"), F.when(_of(name), F.col(row)))

    # First fields are texts, for which rows are sorted: only those of the two types.
    ends = keyed.filter(_of(header_type) | _of(trailer_type))
    found = _totals(ends, keys, batch, [first(header_field, header_type).alias("h"), first(trailer_field, trailer_type).alias("t")])
    found = found.filter(coerce.strip(F.col("h")) != coerce.strip(F.col("t")))
    message = F.concat(F.lit(f"header {header_field} is "), F.col("h"), F.lit(f", trailer {trailer_field} is "), F.col("t"))
    return _file_level(found, "header_trailer_match", severity, f"{header_field}/{trailer_field}", F.concat_ws(" vs ", "h", "t"), message, batch)


def type_sequence(records: DataFrame, expected: list[str], batch=None, row: str = "_row", severity: str = "error") -> DataFrame:
    """First occurrences of the expected types, in the expected order.

    Only first rows per type are gathered: at most one entry per listed type.
    """
    keyed, keys = _keyed(records, batch)
    firsts = [F.min(F.when(_of(t), F.col(row))).alias(f"at{i}") for i, t in enumerate(expected)]
    totals = _totals(keyed, keys, batch, firsts)
    entries = F.array(*[F.when(F.col(f"at{i}").isNotNull(), F.struct(F.col(f"at{i}").alias("at"), F.lit(t).alias("t"))) for i, t in enumerate(expected)])
    present = F.filter(entries, lambda e: e.isNotNull())
    seen = F.transform(F.array_sort(present), lambda e: e["t"])
    wanted = F.transform(present, lambda e: e["t"])
    found = totals.withColumn("_seen", F.array_join(seen, ",")).withColumn("_wanted", F.array_join(wanted, ",")).filter("_seen <> _wanted")
    message = F.concat(F.lit("record types come as "), F.col("_seen"), F.lit(", wanted as "), F.col("_wanted"))
    return _file_level(found, "type_sequence", severity, "record_type_sequence", F.col("_seen"), message, batch)


def validate_per_type(records: DataFrame, per_type: dict[str, tuple[list, list]], row: str = "_row") -> DataFrame:
    """Run each type's layout and rules on its lines.

    ``per_type`` maps a type to ``(layout, rules)``; an empty layout means the
    records already carry their fields.
    """
    parts = []
    for name, (layout, rules) in per_type.items():
        rows = records.filter(_of(name))
        fields = slice_fields(rows, layout) if layout else rows
        parts.append(validate(fields, rules, row).withColumn(TYPE, F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class CrossTypeRule:
    """A check between record types with its arguments; ``message`` replaces the check's own text."""

    check: str
    args: dict
    severity: str = "error"
    message: str | None = None


# Entries of a rule file and the argument each of them sets; ``!`` marks those a rule must have.
CROSS_TYPE_CHECKS = {
    "required_companion": (required_companion, {"when_type": "when_type!", "requires_type": "requires_type!"}),
    "header_trailer_count": (header_trailer_count, {"record_type": "record_type!", "trailer_field": "declared!", "count_of": "count_of"}),
    "header_trailer_sum": (header_trailer_sum, {"record_type": "record_type!", "trailer_field": "declared!", "count_of": "count_of", "sum_of": "sum_of!"}),
    "header_detail_consistent": (
        header_detail_consistent,
        {"header_field": "header_field!", "detail_field": "detail_field!", "when_type": "header_type", "count_of": "detail_type"},
    ),
    "header_trailer_match": (
        header_trailer_match,
        {"header_field": "header_field!", "trailer_field": "trailer_field!", "when_type": "header_type", "record_type": "trailer_type"},
    ),
    "type_sequence": (type_sequence, {"expected_order": "expected!"}),
    "expect_count": (expect_count, {"record_type": "record_type!", "exactly": "exactly!"}),
}
# Types that a rule counts or adds up when it names none.
COUNTED_TYPE = "detail"
# Figures per batch that a check reads; checks that are not listed gather other things.
CHECK_FIGURES = {
    "required_companion": lambda a: [("count", a["when_type"]), ("count", a["requires_type"])],
    "header_trailer_count": lambda a: [("count", a["count_of"]), ("count", a["record_type"])],
    "header_trailer_sum": lambda a: [("sum", a["count_of"], tuple(a["sum_of"]), a.get("scale", 4)), ("count", a["record_type"])],
    "expect_count": lambda a: [("count", a["record_type"])],
}


def cross_type_rule(spec: dict) -> CrossTypeRule:
    """A rule from its dictionary form; a missing or unknown entry is an error, not a rule that never fires."""
    check = spec.get("check")
    if check not in CROSS_TYPE_CHECKS:
        raise ValueError(f"unknown check between record types {check!r}; known: {', '.join(sorted(CROSS_TYPE_CHECKS))}")
    given = {k: v for k, v in spec.items() if v is not None and v != "" and v != []}
    if check == "header_trailer_sum" and "sum_of" not in given and "sum_field" in given:
        given["sum_of"] = [given["sum_field"]]
    args = {}
    for entry, target in CROSS_TYPE_CHECKS[check][1].items():
        name = target.rstrip("!")
        if entry in given:
            args[name] = given[entry]
        elif name == "count_of":
            args[name] = COUNTED_TYPE
        elif target.endswith("!"):
            raise ValueError(f"{check} needs {entry}")
    return CrossTypeRule(check, args, given.get("severity", "error"), given.get("message"))


def record_types_from_dict(spec: dict) -> tuple[list[RecordType], Column]:
    """The types and the discriminator of a record-type file.

    ``{"discriminator": {"position": 1, "length": 3}, "record_types": {name: {"match", "position", "expect"}}}``
    """
    known = {"any", "exactly_one", "at_least_one"}
    types = []
    for name, t in spec["record_types"].items():
        if not t.get("match") and t.get("position") not in ("first", "last"):
            raise ValueError(f"record type {name} has neither a value to match nor a position")
        if t.get("expect", "any") not in known:
            raise ValueError(f"record type {name} expects {t['expect']!r}; known: {', '.join(sorted(known))}")
        types.append(RecordType(name, t.get("match") or None, t.get("position") or None, t.get("expect", "any")))
    mark = spec["discriminator"]
    return types, discriminator(mark["position"], mark["length"])


def check_across_types(records: DataFrame, rules: list, batch: list[str] | None = None) -> DataFrame:
    """Violations of all rules (``CrossTypeRule`` or dictionaries) as one table.

    Counts and sums of all rules are gathered in one pass when the function is called.
    """
    rules = [cross_type_rule(rule) if isinstance(rule, dict) else rule for rule in rules]
    counting = [r for r in rules if r.check in CHECK_FIGURES]
    figures = [f for r in counting for f in CHECK_FIGURES[r.check](r.args)]
    shared = {"shared": BatchFigures(records, batch, figures)} if len(counting) > 1 else {}
    found = []
    for r in rules:
        rows = CROSS_TYPE_CHECKS[r.check][0](records, **r.args, batch=batch, severity=r.severity, **(shared if r in counting else {}))
        found.append(rows if r.message is None else rows.withColumn("message", F.lit(r.message)))
    if not found:
        none = F.from_json(F.lit("{}"), VIOLATION_SCHEMA)
        return records.where("false").select(*(batch or []), none.alias("v")).select(*(batch or []), "v.*")
    return reduce(DataFrame.unionByName, found)
