"""Schema and contract checks over a catalogue of columns.

A catalogue row is ``(dataset, column_name, ordinal, type, nullable)``; a spec row
is ``(dataset, column_name, required, ...)``.  ``(dataset, column_name)`` is unique
on both sides.  Either may also come packed: one row per dataset with arrays
instead of values, as long as a table is wide.

Thousands of datasets are checked against their specs by one join on ``dataset``
of packed rows; names are compared inside a row, so they are not shuffled or
sorted one by one, and only findings become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import coerce

KEY = ["dataset", "column_name"]

# Database types that a declared type may be stored in.
COMPATIBLE_TYPES = {
    "string": ["VARCHAR2", "CHAR", "NVARCHAR2", "NCHAR", "CLOB", "NCLOB"],
    "number": ["NUMBER", "INTEGER", "FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE"],
    "decimal": ["NUMBER", "FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE"],
    "integer": ["NUMBER", "INTEGER"],
    "date": ["DATE", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE", "TIMESTAMP WITH LOCAL TIME ZONE"],
    "boolean": ["NUMBER", "CHAR", "VARCHAR2"],
}


def catalogue_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Catalogue of DataFrames, from their schemas only."""
    rows = [
        (name, f.name, i, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "dataset string, column_name string, ordinal int, type string, nullable boolean")


def packed(entries: DataFrame, *fields: str) -> DataFrame:
    """One row per dataset with an array for each of the given fields."""
    if isinstance(entries.schema["column_name"].dataType, T.ArrayType):
        return entries.select("dataset", *fields)
    rows = entries.groupBy("dataset").agg(F.collect_list(F.struct(*fields)).alias("_entries"))
    return rows.select("dataset", *[F.col("_entries")[f].alias(f) for f in fields])


def _names(where=None) -> Column:
    """Names of the entries for which ``where`` holds on their fields."""
    if where is None:
        return F.col("column_name")
    return F.filter("column_name", lambda _, i: where(lambda field: F.get(F.col(field), i)))


def _side_by_side(catalogue: DataFrame, spec: DataFrame, have: dict[str, Column], want: dict[str, Column], how: str) -> DataFrame:
    """Lists made of either side, on one row per dataset."""
    return catalogue.select("dataset", *[c.alias(n) for n, c in have.items()]).join(spec.select("dataset", *[c.alias(n) for n, c in want.items()]), "dataset", how)


def _listed(both: DataFrame, names: Column, **labels: str) -> DataFrame:
    """One row per name, with labels."""
    return both.select("dataset", F.explode(names).alias("column_name"), *[F.lit(v).alias(n) for n, v in labels.items()])


def _labelled(both: DataFrame, found: list[tuple[Column, dict[str, str]]]) -> DataFrame:
    """One row per name and list of names, with the labels of the list."""

    def rows(names: Column, labels: dict[str, str]) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("column_name"), *[F.lit(v).alias(k) for k, v in labels.items()]))

    return both.select("dataset", F.inline(F.concat(*[rows(*f) for f in found])))


def _none_if_absent(name: str) -> Column:
    """A list of one side, empty where that side lacks the dataset."""
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def schema_missing(catalogue: DataFrame, spec: DataFrame) -> DataFrame:
    """Declared columns that the data lacks."""
    both = _side_by_side(packed(catalogue, "column_name"), packed(spec, "column_name"), {"have": _names()}, {"want": _names()}, "right")
    return _listed(both, F.array_except("want", _none_if_absent("have")), issue_code="VAL_SCHEMA_MISSING_FIELD")


def schema_unexpected(catalogue: DataFrame, spec: DataFrame) -> DataFrame:
    """Columns in the data that nobody declared."""
    both = _side_by_side(packed(catalogue, "column_name"), packed(spec, "column_name"), {"have": _names()}, {"want": _names()}, "left")
    return _listed(both, F.array_except("have", _none_if_absent("want")), issue_code="VAL_SCHEMA_UNEXPECTED_FIELD")


def unmapped_columns(catalogue: DataFrame, spec: DataFrame, side: str = "source") -> DataFrame:
    """Both directions at once: data not mapped, and mapped but absent."""
    both = _side_by_side(packed(catalogue, "column_name"), packed(spec, "column_name"), {"have": _names()}, {"want": _names()}, "full")
    have, want = _none_if_absent("have"), _none_if_absent("want")
    return _labelled(both, [(F.array_except(have, want), {"finding": f"unmapped_{side}"}), (F.array_except(want, have), {"finding": f"missing_in_{side}"})])


def schema_check(catalogue: DataFrame, spec: DataFrame) -> DataFrame:
    """Missing required (error), unexpected and missing optional (warnings)."""
    due = _names(lambda e: e("required"))
    both = _side_by_side(packed(catalogue, "column_name"), packed(spec, "column_name", "required"), {"have": _names()}, {"want": _names(), "due": due}, "full")
    have, want, due = (_none_if_absent(n) for n in ("have", "want", "due"))
    return _labelled(both, [
        (F.array_except(have, want), {"finding": "unexpected", "severity": "warning"}),
        (F.array_except(due, have), {"finding": "missing_required", "severity": "error"}),
        (F.array_except(F.array_except(want, due), have), {"finding": "missing_optional", "severity": "warning"}),
    ])


def column_lists(catalogue: DataFrame) -> DataFrame:
    """Column names of each dataset in order (as long as a table is wide)."""
    lists = packed(catalogue, "column_name", "ordinal")
    in_order = F.sort_array(F.arrays_zip("ordinal", "column_name"))
    return lists.select("dataset", in_order["column_name"].alias("columns"))


def structure_compatible(catalogue: DataFrame, pairs: DataFrame, expected_order: list[str] | None = None) -> DataFrame:
    """Structural findings for pairs of datasets ``(left, right)``.

    A different column count ends the check of a pair; then names on one side
    only; then, where an order is declared and the names are the same, order.
    """
    names = column_lists(catalogue)
    both = pairs.join(names.select(F.col("dataset").alias("left"), F.col("columns").alias("l")), "left").join(
        names.select(F.col("dataset").alias("right"), F.col("columns").alias("r")), "right"
    )
    gone_right, gone_left = F.array_sort(F.array_except("l", "r")), F.array_sort(F.array_except("r", "l"))

    def finding(kind: str, where: str | None, columns: Column) -> Column:
        return F.struct(F.lit(kind).alias("finding"), F.lit(where).cast("string").alias("in_file"), columns.cast("string").alias("columns"))

    counts = F.concat_ws(" vs ", F.size("l").cast("string"), F.size("r").cast("string"))
    same_names = (F.size(gone_right) == 0) & (F.size(gone_left) == 0)
    found = [
        F.when(F.size("l") != F.size("r"), finding("column_count_mismatch", None, counts)),
        F.when((F.size("l") == F.size("r")) & (F.size(gone_right) > 0), finding("missing_columns", "right", F.array_join(gone_right, ","))),
        F.when((F.size("l") == F.size("r")) & (F.size(gone_left) > 0), finding("missing_columns", "left", F.array_join(gone_left, ","))),
    ]
    if expected_order:
        wanted = F.array(*[F.lit(n) for n in expected_order])
        applies = (F.size("l") == F.size("r")) & same_names & (F.array_sort("l") == F.array_sort(wanted))
        found.append(F.when(applies & ((F.col("l") != wanted) | (F.col("r") != wanted)), finding("column_order_mismatch", None, F.array_join("l", ","))))
    return both.select("left", "right", F.inline(F.filter(F.array(*found), lambda f: f.isNotNull())))


# ------------------------------------------------------------------ contracts
def contract_columns(catalogue: DataFrame, spec: DataFrame) -> DataFrame:
    """Mapped columns the table lacks; NOT NULL columns that are not mapped."""
    both = _side_by_side(
        packed(catalogue, "column_name", "nullable"), packed(spec, "column_name", "required"),
        {"have": _names(), "filled": _names(lambda e: ~e("nullable"))}, {"want": _names(), "due": _names(lambda e: e("required"))}, "full")
    have, filled, want, due = (_none_if_absent(n) for n in ("have", "filled", "want", "due"))
    return _labelled(both, [
        (F.array_except(due, have), {"finding": "required_column_absent", "severity": "error"}),
        (F.array_except(F.array_except(want, due), have), {"finding": "optional_column_absent", "severity": "warning"}),
        (F.array_except(filled, want), {"finding": "not_null_column_unmapped", "severity": "warning"}),
    ])


def types_compatible(declared: Column, stored: Column) -> Column:
    ok = F.lit(False)
    for kind, types in COMPATIBLE_TYPES.items():
        ok = F.when(F.lower(declared) == kind, F.upper(stored).isin(*types)).otherwise(ok)
    return ok


def contract_types(catalogue: DataFrame, spec: DataFrame) -> DataFrame:
    """Columns whose stored type can not hold the declared type."""
    # A dataset has few types: a row carries each of them once, with its names.
    def by_kind(field: str) -> Column:
        return F.transform(F.array_distinct(field), lambda k: F.struct(k.alias("kind"), F.filter("column_name", lambda _, i: F.get(F.col(field), i).eqNullSafe(k)).alias("names")))

    both = _side_by_side(
        packed(catalogue, "column_name", "type"), packed(spec, "column_name", "data_type"), {"have": by_kind("type")}, {"want": by_kind("data_type")}, "inner")

    # Names meet for each pair of types that does not fit.
    def of_type(stored: Column) -> Column:
        unfit = F.filter("want", lambda declared: ~types_compatible(declared["kind"], stored["kind"]))
        return F.flatten(F.transform(unfit, lambda declared: of_pair(stored, declared)))

    def of_pair(stored: Column, declared: Column) -> Column:
        met = F.array_intersect(stored["names"], declared["names"])
        return F.transform(met, lambda n: F.struct(n.alias("column_name"), stored["kind"].alias("type"), declared["kind"].alias("data_type")))

    return both.select("dataset", F.inline(F.flatten(F.transform("have", of_type))))


def contract_nullability(catalogue: DataFrame, spec: DataFrame) -> DataFrame:
    """Required columns that the table allows to be null."""
    both = _side_by_side(
        packed(catalogue, "column_name", "nullable"), packed(spec, "column_name", "required"),
        {"have": _names(lambda e: e("nullable"))}, {"want": _names(lambda e: e("required"))}, "inner")
    return _listed(both, F.array_intersect("have", "want"), finding="required_but_nullable")


def contract_date_format(catalogue: DataFrame, spec: DataFrame) -> DataFrame:
    """Date formats on columns that are no dates; times on plain dates."""
    concerned = _names(lambda e: (F.lower(e("data_type")) == "date") | e("date_format").isNotNull())
    timed = _names(lambda e: F.upper(e("date_format")).rlike("HH|MI|SS"))
    others = _names(lambda e: ~F.upper(e("type")).isin(*COMPATIBLE_TYPES["date"]))
    dates = _names(lambda e: F.upper(e("type")) == "DATE")
    both = _side_by_side(
        packed(catalogue, "column_name", "type"), packed(spec, "column_name", "data_type", "date_format"),
        {"others": others, "dates": dates}, {"concerned": concerned, "timed": timed}, "inner")
    return _labelled(both, [
        (F.array_intersect("others", "concerned"), {"finding": "not_a_date_type"}),
        (F.array_intersect("dates", "timed"), {"finding": "time_on_date"}),
    ])


def contract_key_sets(declared: DataFrame, constraints: DataFrame) -> DataFrame:
    """Datasets whose declared keys equal none of their key constraints.

    ``declared`` is ``(dataset, column_name)``, ``constraints`` is ``(dataset,
    constraint, column_name)``; datasets without constraints are not judged.
    """
    want = declared.groupBy("dataset").agg(F.array_sort(F.collect_set(F.upper("column_name"))).alias("keys"))
    have = constraints.groupBy("dataset", "constraint").agg(F.array_sort(F.collect_set(F.upper("column_name"))).alias("set"))
    met = want.join(have, "dataset").groupBy("dataset").agg(F.bool_or(F.col("keys") == F.col("set")).alias("met"))
    return met.filter("NOT met").select("dataset", F.lit("keys_match_no_constraint").alias("finding"))


def _one_row_per_column(df: DataFrame, columns: list[str], aggs: list[Column], fields: list[tuple[str, str]], limits: dict[str, list]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.lit(v).alias(n) for n, v in limits[c]],
            *[F.col(f"{prefix}{i}").alias(name) for prefix, name in fields],
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def observed_nulls(df: DataFrame, required: list[str]) -> DataFrame:
    """Nulls and blanks in required columns, in one pass."""
    aggs = [F.count_if(coerce.is_blank(F.col(c))).alias(f"b{i}") for i, c in enumerate(required)]
    out = _one_row_per_column(df, required, aggs, [("b", "blank_rows")], {c: [] for c in required})
    return out.withColumn("holds", F.col("blank_rows") == 0)


def observed_lengths(df: DataFrame, max_lengths: dict[str, int]) -> DataFrame:
    """Longest text per column against its declared maximum, in one pass."""
    names = list(max_lengths)
    aggs = [F.coalesce(F.max(F.char_length(F.col(c).cast("string"))), F.lit(0)).alias(f"m{i}") for i, c in enumerate(names)]
    out = _one_row_per_column(df, names, aggs, [("m", "observed_length")], {c: [("declared_length", max_lengths[c])] for c in names})
    return out.withColumn("holds", F.col("observed_length") <= F.col("declared_length"))


def _written_digits(c: str) -> Column:
    """A number in plain digits as it stands, without rounding; null if it is none."""
    text = coerce.strip(F.col(c))
    plain = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.ltrim(text, F.lit("+-")))
    # Doubles write large and small values with an exponent: shift the point in the digits.
    parts = F.split(F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]{1,3}$"), F.ltrim(F.upper(text), F.lit("+-"))), "E")
    power = F.get(parts, F.lit(1)).try_cast("int")
    whole, rest = F.substring_index(F.get(parts, F.lit(0)), ".", 1), F.get(F.split(F.get(parts, F.lit(0)), r"\."), F.lit(1))
    rest = F.coalesce(rest, F.lit(""))
    up = F.concat(whole, F.rpad(rest, F.greatest(power, F.char_length(rest)), "0"))
    raised = F.concat(F.substr(up, F.lit(1), F.char_length(whole) + power), F.lit("."), F.substr(up, F.char_length(whole) + power + 1))
    down = F.concat(F.repeat(F.lit("0"), F.greatest(-power, F.lit(0))), whole, rest)
    lowered = F.concat(F.substr(down, F.lit(1), F.char_length(whole)), F.lit("."), F.substr(down, F.char_length(whole) + 1))
    return F.coalesce(plain, F.when(power >= 0, raised).otherwise(lowered))


def observed_precision(df: DataFrame, declared: dict[str, tuple[int, int]]) -> DataFrame:
    """Digits before and after the point against ``(precision, scale)``.

    Digits are counted as written.  A value that is no number does not hold.
    """
    names = list(declared)
    aggs = []
    for i, c in enumerate(names):
        digits = _written_digits(c)
        digits = F.when(digits.contains("."), digits).otherwise(F.concat(digits, F.lit(".")))
        before = F.greatest(F.char_length(F.ltrim(F.substring_index(digits, ".", 1), F.lit("0"))), F.lit(1))
        after = F.char_length(F.rtrim(F.substring_index(digits, ".", -1), F.lit("0")))
        odd = F.count_if(coerce.is_filled(F.col(c)) & digits.isNull())
        aggs += [F.max(before).alias(f"b{i}"), F.max(after).alias(f"a{i}"), odd.alias(f"o{i}")]
    limits = {c: [("precision", p), ("scale", s)] for c, (p, s) in declared.items()}
    out = _one_row_per_column(df, names, aggs, [("b", "digits_before"), ("a", "digits_after"), ("o", "unreadable")], limits)
    return out.withColumn("holds", (F.col("unreadable") == 0) & (F.col("digits_before") <= F.col("precision") - F.col("scale")) & (F.col("digits_after") <= F.col("scale")))


def observed_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Are the declared keys unique in the data?"""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_repeats"))
    return out.select(F.lit(",".join(keys)).alias("keys"), "repeated_keys", "rows_in_repeats", (F.col("repeated_keys") == 0).alias("holds"))


def reconcile_drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issue counts per mapping now and in a baseline run.

    Inputs have ``mapping, errors, warnings``.  Unchanged mappings are left out.
    """
    new = current.select("mapping", F.col("errors").alias("new_errors"), F.col("warnings").alias("new_warnings"), F.lit(True).alias("n"))
    old = baseline.select("mapping", F.col("errors").alias("old_errors"), F.col("warnings").alias("old_warnings"), F.lit(True).alias("o"))
    both = new.join(old, "mapping", "full_outer")
    de, dw = F.col("new_errors") - F.col("old_errors"), F.col("new_warnings") - F.col("old_warnings")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when((de != 0) | (dw != 0), "changed")
    return both.select(
        "mapping", status.alias("status"), "old_errors", "new_errors", de.alias("delta_errors"), "old_warnings", "new_warnings", dw.alias("delta_warnings")
    ).filter("status IS NOT NULL")


def drift_totals(drift: DataFrame) -> DataFrame:
    return drift.agg(
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "removed").alias("removed"),
        F.count_if(F.col("status") == "changed").alias("changed"),
        F.coalesce(F.sum(F.when(F.col("delta_errors") > 0, F.col("delta_errors"))), F.lit(0)).cast("bigint").alias("new_errors"),
        F.coalesce(F.sum(F.when(F.col("delta_warnings") > 0, F.col("delta_warnings"))), F.lit(0)).cast("bigint").alias("new_warnings"),
    )
