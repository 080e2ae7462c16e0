"""Keyed and positional comparison of two tables.

Totals come from aggregations alone, so they are exact for repeated keys and
no pair of rows is ever built for them.  Details are built where their number
is linear in the rows; keys repeated on both sides are answered by exact pair
counts per field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import coerce
from tablewright.functions import transforms as tf
from tablewright.operators.groups import HOT_SHARE, rows_of_groups
from tablewright.operators.profile import pct
from tablewright.operators.violations import explode_found
from tablewright.session import written_once
from tablewright.sources.rows import number_rows

ROW_COLUMNS = ("_row", "_file")


def value_columns(left: DataFrame, right: DataFrame, keys: list[str], ignore=()) -> list[str]:
    shared = set(right.columns)
    return [c for c in left.columns if c not in keys and c not in ignore and c not in ROW_COLUMNS and c in shared]


def key_balance(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key on each side; reduced before the shuffle."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return both.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def only_in_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    balance = key_balance(left, right, keys)
    return rows_of_groups(left, balance, keys, "n_left", F.col("n_right") == 0, null_safe=True).select(*left.columns)


def only_in_right(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return only_in_left(right, left, keys)


def duplicate_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once on a side."""
    return key_balance(left, right, keys).filter("n_left > 1 OR n_right > 1")


# ------------------------------------------------------------------ details
def difference_type(left: Column, right: Column, same_type: bool = True) -> Column:
    other = "value_difference" if same_type else "type_mismatch"
    return (
        F.when(left.isNull() & right.isNull(), "both_null")
        .when(left.isNull(), "null_to_value")
        .when(right.isNull(), "value_to_null")
        .otherwise(other)
    )


def empty_difference_type(left: Column, right: Column) -> Column:
    """The text form of ``difference_type``: null and '' count as empty."""
    le, re = F.coalesce(left == "", F.lit(True)), F.coalesce(right == "", F.lit(True))
    return (
        F.when(le & re, "both_empty").when(le, "empty_to_value").when(re, "value_to_empty").otherwise("value_difference")
    )


def string_difference(left: Column, right: Column) -> Column:
    """Lengths, and whether only case or outer white space differs."""
    return F.struct(
        (F.char_length(right) - F.char_length(left)).alias("length_diff"),
        (F.lower(left) == F.lower(right)).alias("case_only"),
        (coerce.strip(left) == coerce.strip(right)).alias("whitespace_diff"),
        F.char_length(left).alias("length_left"),
        F.char_length(right).alias("length_right"),
    )


def numeric_difference(left: Column, right: Column) -> Column:
    """Absolute and relative change (infinite from zero) and change of sign."""
    diff = right - left
    return F.struct(
        diff.alias("absolute_difference"),
        F.when(left == 0, F.lit(float("inf"))).otherwise(F.try_divide(diff, left) * 100).alias("percent_change"),
        ((left < 0) != (right < 0)).alias("sign_change"),
    )


def _differs(left: Column, right: Column, nulls_differ: bool) -> Column:
    differs = ~left.eqNullSafe(right)
    return differs | (left.isNull() & right.isNull()) if nulls_differ else differs


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    """Values of different kinds (text against number) always differ."""
    return a == b or (isinstance(a, T.NumericType) and isinstance(b, T.NumericType))


def _digits(kind: T.DataType) -> tuple[int, int]:
    """Digits before and after the point that a whole or decimal type can hold."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}[kind.simpleString()], 0


def _common_type(a: T.DataType, b: T.DataType) -> str | None:
    """A type that holds every value of two numeric types exactly, if there is one."""
    binary = [isinstance(x, (T.DoubleType, T.FloatType)) for x in (a, b)]
    if any(binary):
        return "double" if all(binary) else None
    before, after = (max(x) for x in zip(_digits(a), _digits(b), strict=True))
    if not after and before <= 19 and not any(isinstance(x, T.DecimalType) for x in (a, b)):
        return "bigint"
    return f"decimal({before + after},{after})" if before + after <= 38 else None


def number_form(c: Column) -> Column:
    """Sign, digits without zeros at their ends, and power of ten of any number, as text.

    Equal numbers have equal forms whatever their types, and nothing has to fit
    into a common type.  Binary floating point counts as the decimal that it
    is written as; NaN and infinities are their names.
    """
    text = c.cast("string")
    mantissa = F.regexp_replace(text, "^-|E.*$", "")
    exponent = F.coalesce(F.regexp_extract(text, "E([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0"))
    core = F.rtrim(digits, F.lit("0"))
    decimals = F.char_length(F.regexp_extract(mantissa, "[.]([0-9]*)$", 1))
    power = exponent - decimals + F.char_length(digits) - F.char_length(core)
    form = F.concat(F.when(text.startswith("-"), "-").otherwise(""), core, F.lit("e"), power.cast("string"))
    return F.when(~text.rlike("^-?[0-9]"), text).when(core == "", F.lit("0")).otherwise(form)


def _aligned(left: DataFrame, right: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Both sides with numeric columns of different types made comparable.

    Where a type holds both exactly they are cast to it.  Otherwise the column
    becomes its ``number_form``, and a further column, named in the third
    result, keeps the value as the side wrote it.
    """
    casts, shown, taken = {}, {}, {*left.columns, *right.columns}
    for n, c in enumerate(names):
        a, b = left.schema[c].dataType, right.schema[c].dataType
        if a == b or not _comparable(a, b):
            continue
        kind = _common_type(a, b)
        if kind:
            casts[c] = F.col(c).cast(kind)
        else:
            casts[c] = number_form(F.col(c))
            shown[c] = next(x for x in (f"_shown{n}{'_' * i}" for i in range(len(taken) + 1)) if x not in taken)
    if not casts:
        return left, right, {}
    texts = {name: F.col(c).cast("string") for c, name in shown.items()}
    return *(side.withColumns(texts).withColumns(casts) for side in (left, right)), shown


def schema_differences(left: DataFrame, right: DataFrame, keys: list[str], ignore=()) -> tuple[list[str], list[str]]:
    """Columns that only one side has: of ``left``, of ``right``."""
    skipped = {*keys, *ignore, *ROW_COLUMNS}

    def extra(a: DataFrame, b: DataFrame) -> list[str]:
        return [c for c in a.columns if c not in skipped and c not in b.columns]

    return extra(left, right), extra(right, left)


def _field_diffs(pairs: DataFrame, keys: list[str], fields: list[tuple[str, bool]], nulls_differ: bool, shown: dict[str, str] | None = None) -> DataFrame:
    """Explode rows holding ``_l`` and ``_r`` structs into differing fields."""
    entries = []
    for name, same_type in fields:
        a, b = F.col("_l")[name], F.col("_r")[name]
        seen = (shown or {}).get(name, name)
        differs = _differs(a, b, nulls_differ) if same_type else a.isNotNull() | b.isNotNull() | F.lit(nulls_differ)
        entries.append(
            F.when(
                differs,
                F.struct(
                    F.lit(name).alias("field"),
                    F.col("_l")[seen].cast("string").alias("left_value"),
                    F.col("_r")[seen].cast("string").alias("right_value"),
                    difference_type(a, b, same_type).alias("diff_type"),
                    F.lit(1).cast("bigint").alias("pairs"),
                ),
            )
        )
    return explode_found(pairs, keys, F.array(*entries))


def _unique_diff(left: DataFrame, right: DataFrame, keys, fields, nulls_differ, shown=None, checked: bool = True) -> DataFrame:
    """Diff of sides without repeated keys: one equi-join, null keys meet.

    Unless ``checked``, the right side is reduced to its keys first (in the
    shuffle that the join needs anyway), and a key that repeats is an error.
    """
    if not checked:
        right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first("_r").alias("_r"))
        told = F.raise_error(F.lit(f"a key repeats on the right side, which unique_keys rules out: {', '.join(keys)}"))
        right = right.withColumn("_r", F.when(F.col("_n") > 1, told).otherwise(F.col("_r")))
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_r")
    same_key = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return _field_diffs(left.join(other, same_key), keys, fields, nulls_differ, shown)


def keyed_diff(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    ignore=(),
    nulls_differ: bool = False,
    unique_keys: bool = False,
) -> DataFrame:
    """One row per differing field of rows that share a key.

    Columns: the keys, ``field, left_value, right_value, diff_type, pairs``.
    With ``unique_keys`` the caller states that no key repeats, and the diff is
    one equi-join; a key that does repeat on the right is an error, one that
    repeats on the left is compared row by row.  Otherwise the keys are counted first (this runs a job), and
    only if some repeat are they told apart: a key that is single on one side
    is paired with each of its rows on the other side; a key repeated on both
    sides yields one ``many_to_many`` row per field with the exact number of
    differing pairs, because listing them would be quadratic.
    """
    names = value_columns(left, right, keys, ignore)
    fields = [(c, _comparable(left.schema[c].dataType, right.schema[c].dataType)) for c in names]
    left, right, shown = _aligned(left, right, names)
    out = [*keys, "field", "left_value", "right_value", "diff_type", "pairs"]
    packed_left = left.select(*keys, F.struct(*names, *shown.values()).alias("_l"))
    packed_right = right.select(*keys, F.struct(*names, *shown.values()).alias("_r"))
    if unique_keys:
        return _unique_diff(packed_left, packed_right, keys, fields, nulls_differ, shown, checked=False).select(*out)

    # Repeated keys with a partner; a narrow aggregation, written because the
    # steps below read it several times.
    repeats = written_once(key_balance(left, right, keys).filter("n_left > 0 AND n_right > 0 AND (n_left > 1 OR n_right > 1)"))
    if repeats.isEmpty():
        return _unique_diff(packed_left, packed_right, keys, fields, nulls_differ, shown).select(*out)

    # Both sides meet in one aggregation; for a single row ``min`` is the row.
    both = packed_left.withColumn("_r", F.lit(None).cast(packed_right.schema["_r"].dataType)).unionByName(
        packed_right.withColumn("_l", F.lit(None).cast(packed_left.schema["_l"].dataType))
    )
    single = both.groupBy(*keys).agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.min("_l").alias("_l"), F.min("_r").alias("_r")
    ).filter("n_left = 1 AND n_right = 1")

    many_left = written_once(rows_of_groups(packed_left, repeats, keys, "n_left", null_safe=True))
    many_right = written_once(rows_of_groups(packed_right, repeats, keys, "n_right", null_safe=True))
    one_left = many_left.filter("n_left = 1").select(*keys, "n_right", "_l")
    fan_right = rows_of_groups(many_right.filter("n_left = 1").select(*keys, "_r"), one_left, keys, "n_right", null_safe=True)
    one_right = many_right.filter("n_right = 1").select(*keys, "n_left", "_r")
    fan_left = rows_of_groups(many_left.filter("n_right = 1").select(*keys, "_l"), one_right, keys, "n_left", null_safe=True)
    both_many = "n_left > 1 AND n_right > 1"
    return reduce(
        DataFrame.unionByName,
        [
            _field_diffs(single, keys, fields, nulls_differ, shown).select(*out),
            _field_diffs(fan_right, keys, fields, nulls_differ, shown).select(*out),
            _field_diffs(fan_left, keys, fields, nulls_differ, shown).select(*out),
            _many_to_many(many_left.filter(both_many), many_right.filter(both_many), keys, fields, nulls_differ).select(*out),
        ],
    )


def _many_to_many(left: DataFrame, right: DataFrame, keys, fields, nulls_differ) -> DataFrame:
    """Exact number of differing pairs per key and field, from value counts."""

    def long(rows: DataFrame, side: str) -> DataFrame:
        # Values of different kinds never agree: their texts are kept apart by side.
        texts = [(n, F.col(side)[n].cast("string") if same else F.concat(F.lit(side), F.col(side)[n].cast("string"))) for n, same in fields]
        cells = F.array(*[F.struct(F.lit(n).alias("field"), value.alias("value")) for n, value in texts])
        return rows.select(*keys, F.inline(cells))

    both = long(left, "_l").withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).unionByName(
        long(right, "_r").withColumn("l", F.lit(0)).withColumn("r", F.lit(1))
    )
    counted = both.groupBy(*keys, "field", "value").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    same = F.col("l") * F.col("r")
    if nulls_differ:
        same = F.when(F.col("value").isNotNull(), same).otherwise(0)
    pairs = counted.groupBy(*keys, "field").agg((F.sum("l") * F.sum("r") - F.sum(same)).alias("pairs"))
    nothing = F.lit(None).cast("string")
    return pairs.filter("pairs > 0").select(
        *keys, "field", nothing.alias("left_value"), nothing.alias("right_value"), F.lit("many_to_many").alias("diff_type"), "pairs"
    )


# ------------------------------------------------- details by cancellation
def _contents(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct contents with their number of rows per side."""
    both = left.select(*columns, F.lit(1).alias("_nl"), F.lit(0).alias("_nr")).unionByName(
        right.select(*columns, F.lit(0).alias("_nl"), F.lit(1).alias("_nr"))
    )
    return both.groupBy(*columns).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr"))


def _left_over(rows: DataFrame, contents: DataFrame, columns: list[str], keys: list[str], own: str, other: str, ids: list[str]) -> DataFrame:
    """Rows of a side that no equal row of the other side cancels, numbered within their key.

    Of equal rows those with the smallest ids are cancelled.  Numbers come
    from one distributed sort and from where contents and keys begin in it, so
    no key or content is gathered in a task.
    """
    surplus = contents.filter(F.col(own) > F.col(other)).select(*columns, F.col(own).alias("_own"), F.col(other).alias("_gone"))
    placed = number_rows(rows_of_groups(rows, surplus, columns, "_own", null_safe=True), [*columns, *ids], "_num")
    begun = placed.groupBy(*columns).agg(F.min("_num").alias("_first"), F.count(F.lit(1)).alias("_size"))
    placed = rows_of_groups(placed, begun, columns, "_size", null_safe=True)
    left = placed.filter(F.col("_num") - F.col("_first") >= F.col("_gone")).drop("_own", "_gone", "_first", "_size", "_num")
    left = number_rows(left, [*keys, *columns[len(keys):], *ids], "_num")
    begun = left.groupBy(*keys).agg(F.min("_num").alias("_first"), F.count(F.lit(1)).alias("_size"))
    left = rows_of_groups(left, begun, keys, "_size", null_safe=True)
    return left.withColumn("_place", F.col("_num") - F.col("_first")).drop("_num", "_first", "_size")


def matched_diff(left: DataFrame, right: DataFrame, keys: list[str], ignore=(), ids=None) -> DataFrame:
    """Differences between rows that share a key, each with its source rows.

    Equal rows of both sides cancel each other, as often as both have them.
    What is left of a key is paired in the order of its values, the first row
    of one side with the first of the other, and every field that differs in a
    pair is listed with both values.  A row without a partner is listed once,
    with no field, as ``extra_in_left`` or ``extra_in_right``.  So repeated
    keys never multiply, and the result is linear in the rows that differ.
    Keys that only one side has are left to ``only_in_left`` and ``only_in_right``.

    ``ids`` are the columns that name a source row (by default ``_row`` and
    ``_file``, where both sides have them); they come back as structs
    ``left_row`` and ``right_row``.  Numbers of different types are compared
    exactly.  Contents are counted and rows numbered first: this runs jobs.
    """
    ids = [c for c in ROW_COLUMNS if c in left.columns and c in right.columns] if ids is None else list(ids)
    names = [c for c in value_columns(left, right, keys, ignore) if c not in ids]
    fields = [(c, _comparable(left.schema[c].dataType, right.schema[c].dataType)) for c in names]
    left, right, shown = _aligned(left, right, names)
    # Text and numbers never agree: such columns meet as texts that tell the side.
    apart = [c for c, same in fields if not same]
    for c in apart:
        shown[c] = next(x for x in (f"_text{'_' * i}" + c for i in range(99)) if x not in left.columns and x not in right.columns)
    tagged = [
        side.withColumns({shown[c]: F.col(c).cast("string") for c in apart}).withColumns({c: F.concat(F.lit(tag), F.col(c).cast("string")) for c in apart})
        for side, tag in ((left, "left "), (right, "right "))
    ]
    columns = [*keys, *names]
    # Written values can differ between equal numbers; any of them will do.
    left, right = (side.select(*columns, *shown.values(), *ids) for side in tagged)
    contents = written_once(_contents(left, right, columns))
    shared = contents.groupBy(*keys).agg(F.sum("_nl").alias("_l"), F.sum("_nr").alias("_r")).filter("_l > 0 AND _r > 0")
    uneven = contents.filter("_nl <> _nr").groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    keyed = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    open_keys = written_once(shared.join(uneven.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), keyed, "left_semi").withColumn("_size", F.col("_l") + F.col("_r")))
    # Only contents of keys that both sides have.
    in_play = written_once(rows_of_groups(contents.filter("_nl <> _nr"), open_keys.select(*keys, "_size"), keys, "_size", null_safe=True).drop("_size"))
    sides = []
    for side, own, other, place in ((left, "_nl", "_nr", "_l"), (right, "_nr", "_nl", "_r")):
        rest = _left_over(side, in_play, columns, keys, own, other, ids)
        sides.append(rest.select(*keys, "_place", F.struct(*names, *shown.values(), F.struct(*ids).alias("_id") if ids else F.lit(None).cast("int").alias("_id")).alias(place)))
    other = sides[1].select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_place").alias("_at"), "_r")
    pairs = sides[0].join(other, keyed & (F.col("_place") == F.col("_at")), "full_outer")
    pairs = pairs.withColumns({k: F.coalesce(F.col(k), F.col(f"_k_{k}")) for k in keys})
    rows = [F.col("_l")["_id"].alias("left_row"), F.col("_r")["_id"].alias("right_row")]
    changed = _field_diffs(
        pairs.filter("_l IS NOT NULL AND _r IS NOT NULL").withColumns({"left_row": rows[0], "right_row": rows[1]}), [*keys, "left_row", "right_row"], fields, False, shown
    ).drop("pairs")
    nothing = F.lit(None).cast("string")
    kind = F.when(F.col("_r").isNull(), "extra_in_left").otherwise("extra_in_right")
    extra = pairs.filter("_l IS NULL OR _r IS NULL").select(*keys, *rows, nothing.alias("field"), nothing.alias("left_value"), nothing.alias("right_value"), kind.alias("diff_type"))
    return changed.select(*extra.columns).unionByName(extra)


def field_difference_stats(diffs: DataFrame) -> DataFrame:
    """Differences per field and type."""
    return diffs.groupBy("field", "diff_type").agg(F.sum("pairs").alias("differences"))


def most_different_field(diffs: DataFrame) -> DataFrame:
    """Fields with differences, and the field with most of them."""
    per_field = diffs.groupBy("field").agg(F.sum("pairs").alias("n"))
    return per_field.agg(
        F.count(F.lit(1)).alias("fields_with_differences"),
        F.max_by("field", F.struct("n", "field")).alias("most_different_field"),
        F.max("n").alias("differences"),
    )


# ------------------------------------------------------------------- totals
def compare_summary(left: DataFrame, right: DataFrame, keys: list[str], ignore=(), nulls_differ: bool = False) -> DataFrame:
    """Totals of a comparison in one row.

    Rows are reduced to distinct contents with a count per side, then to keys.
    For a key with L and R rows of which S pairs agree, ``L * R - S`` pairs
    differ; repeated keys are exact without building pairs.  Values of
    different kinds (text against number) differ unless both are null, as in
    the details.  Columns that one side lacks are counted.
    """
    names = value_columns(left, right, keys, ignore)
    extra_left, extra_right = schema_differences(left, right, keys, ignore)
    apart = [c for c in names if not _comparable(left.schema[c].dataType, right.schema[c].dataType)]
    left, right, _ = _aligned(left, right, names)
    if apart:
        left = left.withColumns({c: F.concat(F.lit("left "), F.col(c).cast("string")) for c in apart})
        right = right.withColumns({c: F.concat(F.lit("right "), F.col(c).cast("string")) for c in apart})
    both = left.select(*keys, *names, F.lit(1).alias("_nl"), F.lit(0).alias("_nr")).unionByName(
        right.select(*keys, *names, F.lit(0).alias("_nl"), F.lit(1).alias("_nr"))
    )
    contents = both.groupBy(*keys, *names).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr"))
    same = F.col("_nl") * F.col("_nr")
    if nulls_differ and names:
        whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        same = F.when(whole, same).otherwise(F.lit(0))
    per_key = contents.groupBy(*keys).agg(F.sum("_nl").alias("l"), F.sum("_nr").alias("r"), F.sum(same).alias("s"))
    zero = F.lit(0)
    totals = per_key.agg(
        F.coalesce(F.sum("l"), zero).cast("bigint").alias("total_rows_left"),
        F.coalesce(F.sum("r"), zero).cast("bigint").alias("total_rows_right"),
        F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("l"))), zero).cast("bigint").alias("only_in_left"),
        F.coalesce(F.sum(F.when(F.col("l") == 0, F.col("r"))), zero).cast("bigint").alias("only_in_right"),
        F.coalesce(F.sum(F.col("l") * F.col("r") - F.col("s")), zero).cast("bigint").alias("rows_with_differences"),
        F.count_if(F.col("l") > 1).alias("duplicate_keys_left"),
        F.count_if(F.col("r") > 1).alias("duplicate_keys_right"),
    )
    return totals.withColumns({
        "matching_rows": F.col("total_rows_left") - F.col("only_in_left") - F.col("rows_with_differences"),
        "columns_only_in_left": F.lit(len(extra_left)).cast("bigint"),
        "columns_only_in_right": F.lit(len(extra_right)).cast("bigint"),
    })


def compare_status(summary: DataFrame) -> DataFrame:
    """Adds ``passed`` / ``failed``: any missing, extra or different row or column fails."""
    counts = ("only_in_left", "only_in_right", "rows_with_differences", "columns_only_in_left", "columns_only_in_right")
    clean = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in counts])
    return summary.withColumn("status", F.when(clean, "passed").otherwise("failed"))


def baseline_regression(targets: list[tuple[str, DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """Summary and verdict of current output against baseline, per target."""
    parts = [
        compare_status(compare_summary(current, baseline, keys)).withColumn("target", F.lit(name))
        for name, current, baseline, keys in targets
    ]
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------- positional
def positional_diff(left: DataFrame, right: DataFrame, ignore=(), row: str = "_row") -> DataFrame:
    """Row i against row i of two numbered tables; null equals ''.

    Rows beyond the shorter table appear once as ``only_in_left`` or
    ``only_in_right``.  Row numbers are unique, so the join is one to one.
    """
    names = value_columns(left, right, [row], ignore)

    def text(df, side):
        cells = [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]
        return df.select(row, F.struct(*cells).alias(side))

    both = text(left, "_l").join(text(right, "_r"), row, "full_outer")
    entry = "struct<field:string,left_value:string,right_value:string,diff_type:string>"

    def made(field, a, b, kind):
        return F.struct(field.alias("field"), a.alias("left_value"), b.alias("right_value"), F.lit(kind).alias("diff_type")).cast(entry)

    nothing = F.lit(None).cast("string")
    changed = F.array(*[
        F.when(F.col("_l")[n] != F.col("_r")[n], made(F.lit(n), F.col("_l")[n], F.col("_r")[n], "value_difference")) for n in names
    ])
    entries = (
        F.when(F.col("_r").isNull(), F.array(made(nothing, nothing, nothing, "only_in_left")))
        .when(F.col("_l").isNull(), F.array(made(nothing, nothing, nothing, "only_in_right")))
        .otherwise(changed)
    )
    return explode_found(both, [F.col(row).alias("row_number")], entries)


# -------------------------------------------------------- expected vs actual
def transform_mismatch(source: DataFrame, targets: list, actual: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """Source value, transformed value and delivered value per row and field.

    ``targets`` are the target fields of the mapping and ``fields`` maps those
    to report to their source columns.  Source and transformed values come
    from one projection, so only the delivered rows are joined.
    A key that repeats on both sides has no defined partner and is an error:
    keys are counted first (this runs a job).
    """
    balance = written_once(key_balance(source, actual, keys))
    if not balance.filter("n_left > 1 AND n_right > 1").isEmpty():
        raise ValueError(f"keys {keys} repeat on both sides")
    build = {t.name: t for t in targets}
    made = F.struct(*[
        F.struct(F.col(c).cast("string").alias("s"), tf.fit(build[name].build(), build[name].length).alias("t")).alias(f"f{i}")
        for i, (name, c) in enumerate(fields.items())
    ])
    given = F.struct(*[F.col(name).cast("string").alias(f"f{i}") for i, name in enumerate(fields)])
    made_rows, given_rows = source.select(*keys, made.alias("_made")), actual.select(*keys, given.alias("_given"))
    # Keys that are single on both sides, or lack a partner, join as they are.  A key that repeats on one side is
    # single on the other, which becomes its verdict: hot keys are split off and never shuffled.
    many = balance.filter("n_left > 0 AND n_right > 0 AND (n_left > 1 OR n_right > 1)")
    if many.isEmpty():
        joined = made_rows.join(given_rows, keys, "left")
    else:
        repeated = many.withColumn("_size", F.col("n_left") + F.col("n_right")).select(*keys, "n_left", "n_right", "_size")
        made_many = written_once(rows_of_groups(made_rows, repeated, keys, "_size"))
        given_many = written_once(rows_of_groups(given_rows, repeated, keys, "_size"))
        fan = [
            rows_of_groups(made_many.filter("n_left > 1").select(*keys, "_made"), given_many.filter("n_left > 1").select(*keys, "_given", "_size"), keys, "_size"),
            rows_of_groups(given_many.filter("n_right > 1").select(*keys, "_given"), made_many.filter("n_right > 1").select(*keys, "_made", "_size"), keys, "_size"),
        ]
        # Null keys have no partner; those and all that does not repeat stay in the plain join.
        hot_free = [_without_groups(rows, repeated, keys) for rows in (made_rows, given_rows)]
        joined = hot_free[0].join(hot_free[1], keys, "left").select(*keys, "_made", "_given")
        joined = reduce(DataFrame.unionByName, [joined, *[f.select(*keys, "_made", "_given") for f in fan]])
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("field"),
            F.col("_made")[f"f{i}"]["s"].alias("source_value"),
            F.col("_made")[f"f{i}"]["t"].alias("transformed_value"),
            F.col("_given")[f"f{i}"].alias("file_value"),
        )
        for i, name in enumerate(fields)
    ])
    return joined.select(*keys, F.inline(cells)).withColumn("match", F.col("transformed_value").eqNullSafe(F.col("file_value")))


def _without_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of other keys than those of ``groups``; hot groups leave before the shuffle."""
    total = groups.agg(F.sum("_size").alias("_total")).scalar()
    hot = groups.filter(F.col("_size") * HOT_SHARE > total).select(*keys)
    return rows.join(F.broadcast(hot), keys, "left_anti").join(groups.select(*keys), keys, "left_anti")


def mismatch_totals(mismatches: DataFrame) -> DataFrame:
    per_field = mismatches.groupBy("field").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("match")).alias("matched"), F.count_if(~F.col("match")).alias("mismatched")
    )
    return per_field.withColumn("match_pct", pct(F.col("matched"), F.col("total")))
