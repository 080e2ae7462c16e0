"""Profiles and quality metrics over whole tables.

Every profile is one or two aggregations.  Per-column distinct counts go
through a long ``(column, value)`` form that is reduced before any distinct is
taken, so the number of shuffles does not grow with the number of columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import coerce
from tablewright.operators.violations import ROW, row_identity
from tablewright.session import written_once

# Date layouts that are tried, with their display names.
DATE_LAYOUTS = [
    ("YYYY-MM-DD", "yyyy-MM-dd"),
    ("MM/DD/YYYY", "MM/dd/yyyy"),
    ("DD/MM/YYYY", "dd/MM/yyyy"),
    ("YYYYMMDD", "yyyyMMdd"),
    ("MM-DD-YYYY", "MM-dd-yyyy"),
    ("DD-MM-YYYY", "dd-MM-yyyy"),
    ("YYYY/MM/DD", "yyyy/MM/dd"),
]


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage rounded, 0 for an empty whole."""
    share = F.when(whole > 0, part.cast("double") * 100.0 / whole).otherwise(F.lit(0.0))
    return F.round(share, digits)


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value)`` with every value as text."""
    columns = columns or df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def _long_counts(counts: DataFrame, names: list[tuple], columns: list[str]) -> DataFrame:
    """Turn one wide row of counters into one row per counter."""
    entries = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, key)], *[F.col(src).alias(dst) for src, dst in values])
        for key, values in names
    ]
    return counts.select(F.inline(F.array(*entries)))


def mapping_rule_counts(df: DataFrame, rules: list[tuple[str, str, dict]]) -> DataFrame:
    """Violations per ``(column, rule type, parameters)`` in a single pass.

    Length and range rules pass nulls, ``regex`` fails them, ``not_null``
    counts real nulls only.
    """
    counters, names = [], []
    for i, (column, kind, p) in enumerate(rules):
        c = F.col(column)
        if kind == "not_null":
            bad = c.isNull()
        elif kind == "min_length":
            bad = F.char_length(c) < int(p.get("length", 0))
        elif kind == "max_length":
            bad = F.char_length(c) > int(p.get("length", 999999))
        elif kind == "regex":
            bad = ~F.coalesce(c.rlike(f"^(?:{p.get('pattern', '')})"), F.lit(False))
        elif kind == "range":
            n = coerce.number_of(df, column)
            bad = (n < F.lit(float(p.get("min", "-inf")))) | (n > F.lit(float(p.get("max", "inf"))))
        elif kind == "in_list":
            bad = ~c.isin(*p["values"])
        else:
            bad = F.lit(False)
        counters.append(F.count_if(bad).alias(f"v{i}"))
        names.append(((column, kind), [(f"v{i}", "violations")]))
    return _long_counts(df.agg(*counters), names, ["column_name", "rule_type"])


def required_empty_totals(df: DataFrame, required: list[str]) -> DataFrame:
    """Blank values per required column."""
    counters = [F.count(F.lit(1)).alias("n")] + [F.count_if(coerce.is_blank(F.col(c))).alias(f"e{i}") for i, c in enumerate(required)]
    names = [((c,), [(f"e{i}", "empty_rows"), ("n", "total_rows")]) for i, c in enumerate(required)]
    return _long_counts(df.agg(*counters), names, ["field"])


def _copies(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))


def top_duplicates(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most repeated whole rows."""
    return _copies(df).filter("copies > 1").orderBy(F.desc("copies"), *df.columns).limit(n)


def duplicate_summary(df: DataFrame) -> DataFrame:
    sums = _copies(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.count_if(F.col("copies") > 1).alias("duplicated_groups"),
        F.coalesce(F.max("copies"), F.lit(0)).alias("most_copies"),
    )
    extra = F.col("total_rows") - F.col("unique_rows")
    return sums.withColumn("duplicate_rows", extra).withColumn("duplicate_pct", pct(extra, F.col("total_rows")))


def quality_metrics(df: DataFrame, ignore: tuple[str, ...] = ("_row",)) -> DataFrame:
    """Completeness, uniqueness and the weighted score of a table.

    Null cells are counted on the reduced rows (times their copies), so the
    table is read once.
    """
    columns = [c for c in df.columns if c not in ignore]
    nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("bigint") for c in columns])
    reduced = df.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    m = reduced.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.coalesce(F.sum(nulls * F.col("_copies")), F.lit(0)).alias("null_cells"),
    )
    width = len(columns)
    cells = F.col("total_rows") * width
    filled = cells - F.col("null_cells")
    completeness = F.when(cells > 0, filled * 100.0 / cells).otherwise(F.lit(0.0))
    uniqueness = F.when(F.col("total_rows") > 0, F.col("unique_rows") * 100.0 / F.col("total_rows")).otherwise(F.lit(0.0))
    completeness, uniqueness = completeness.cast("double"), uniqueness.cast("double")
    return m.select(
        "total_rows",
        F.lit(width).cast("bigint").alias("total_columns"),
        cells.alias("total_cells"),
        filled.alias("filled_cells"),
        "null_cells",
        F.round(completeness, 2).alias("completeness_pct"),
        "unique_rows",
        (F.col("total_rows") - F.col("unique_rows")).alias("duplicate_rows"),
        F.round(uniqueness, 2).alias("uniqueness_pct"),
        F.round(completeness * 0.6 + uniqueness * 0.4, 2).alias("quality_score"),
    )


def column_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: totals, fill rate and distinct values.

    ``approximate`` swaps exact distinct counting for a sketch of fixed size.
    Samples of the values come from ``sample_values``.
    """
    values = long_values(df, columns)
    if approximate:
        per_column = values.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("total_values"),
            F.count("value").alias("filled_count"),
            F.approx_count_distinct("value").alias("unique_count"),
        )
        return _fill_rates(per_column)
    counted = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    per_column = counted.groupBy("column_name").agg(
        F.sum("n").alias("total_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled_count"),
        F.count("value").alias("unique_count"),
    )
    return _fill_rates(per_column)


def _fill_rates(per_column: DataFrame) -> DataFrame:
    return per_column.select(
        "column_name",
        "total_values",
        (F.col("total_values") - F.col("filled_count")).alias("null_count"),
        "filled_count",
        pct(F.col("filled_count"), F.col("total_values")).alias("fill_rate_pct"),
        "unique_count",
        pct(F.col("unique_count"), F.col("filled_count")).alias("unique_ratio_pct"),
    )


def sample_values(df: DataFrame, columns: list[str] | None = None, n: int = 5) -> DataFrame:
    """The ``n`` smallest distinct values of each column.

    All columns share one scan.  Values are reduced to distinct ones, of which
    every task passes on only its ``n`` smallest per column.
    """
    values = long_values(df, columns).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(W.partitionBy("column_name").orderBy("value"))
    return values.withColumn("_place", place).filter(F.col("_place") <= n).select("column_name", "value")


def numeric_profile(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Minimum, maximum, mean, median and sample deviation per column.

    The median is exact; ``accuracy`` switches to a sketch of bounded size.
    Values are scanned once: what they are reduced to for the median, distinct
    values with their number of rows, gives the other figures too.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), coerce.number_of(df, c).alias("x")) for c in columns])
    values = df.select(F.inline(pairs)).filter("x IS NOT NULL")
    if accuracy is not None:
        stats = [
            F.min("x").alias("min"),
            F.max("x").alias("max"),
            F.round(F.avg("x"), 4).alias("mean"),
            F.round(F.stddev_samp("x"), 4).alias("std_dev"),
        ]
        return values.groupBy("column_name").agg(*stats, F.percentile_approx("x", 0.5, accuracy).alias("median"))
    counted = values.groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("n"))
    placed = written_once(counted.orderBy("column_name", "x").withColumn("_part", F.spark_partition_id()))
    return _weighted_moments(placed).join(_exact_medians(placed), "column_name")


def _weighted_moments(counted: DataFrame) -> DataFrame:
    """Figures of distinct values ``x`` that stand for ``n`` rows each; deviations are taken from the mean."""
    sums = counted.groupBy("column_name").agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.sum("n").alias("_rows"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("_mean")
    )
    # One row per column of the table.
    around = counted.join(F.broadcast(sums.select("column_name", "_mean")), "column_name")
    spread = around.groupBy("column_name").agg(F.sum(F.col("n") * F.pow(F.col("x") - F.col("_mean"), F.lit(2))).alias("_spread"))
    deviation = F.sqrt(F.try_divide(F.col("_spread"), F.col("_rows") - 1))
    return sums.join(spread, "column_name").select("column_name", "min", "max", F.round("_mean", 4).alias("mean"), F.round(deviation, 4).alias("std_dev"))


def _exact_medians(placed: DataFrame) -> DataFrame:
    """Median of ``x`` per column without gathering a column in one task.

    Value counts were sorted over range partitions and written.  The counts
    per partition say which partition holds the middle rows of a column
    (at most two), and only those are looked into.
    """
    parts = placed.groupBy("column_name", "_part").agg(F.sum("n").alias("in_part"))
    ordered = W.partitionBy("column_name").orderBy("_part")
    total = F.sum("in_part").over(W.partitionBy("column_name"))
    ranked = parts.select(
        "column_name", "_part", "in_part", (F.sum("in_part").over(ordered) - F.col("in_part")).alias("before"),
        F.floor((total + 1) / 2).alias("low"), (F.floor(total / 2) + 1).alias("high"),
    )
    holding = ranked.filter("(before < low AND before + in_part >= low) OR (before < high AND before + in_part >= high)")
    inside = placed.join(F.broadcast(holding), ["column_name", "_part"])
    upto = F.sum("n").over(W.partitionBy("column_name", "_part").orderBy("x")) + F.col("before")
    placed_at = inside.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("from") < F.col(rank)) & (F.col("upto") >= F.col(rank)), F.col("x")))

    return placed_at.groupBy("column_name").agg(((at("low") + at("high")) / 2).alias("median"))


def string_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shortest, longest and average text per column, in one pass."""
    counters, names = [], []
    for i, c in enumerate(columns):
        n = F.char_length(F.col(c).cast("string")).cast("bigint")
        counters += [F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}"), F.round(F.avg(n), 2).alias(f"av{i}")]
        names.append(((c,), [(f"lo{i}", "min_length"), (f"hi{i}", "max_length"), (f"av{i}", "avg_length")]))
    return _long_counts(df.agg(*counters), names, ["column_name"])


def null_empty_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls and blank texts per column, count and percentage."""
    columns = columns or df.columns
    counters, names = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        counters += [F.count_if(F.col(c).isNull()).alias(f"u{i}"), F.count_if(coerce.strip(F.col(c)) == "").alias(f"b{i}")]
        names.append(((c,), [(f"u{i}", "null_count"), (f"b{i}", "empty_count"), ("n", "total_rows")]))
    out = _long_counts(df.agg(*counters), names, ["column_name"])
    return out.withColumn("null_pct", pct(F.col("null_count"), F.col("total_rows"))).withColumn(
        "empty_pct", pct(F.col("empty_count"), F.col("total_rows"))
    )


def looks_like_date_name(c: Column) -> Column:
    return F.lower(c).rlike("date|time|dt|timestamp")


def parse_day(s: Column, pattern: str) -> Column:
    """Parse stripped text in a fixed-digit date pattern.

    A look at the shape comes first: a failed parse costs far more than a
    regular expression, and most values of most columns are no dates.
    """
    shape = re.sub("[yMd]+", lambda m: f"[0-9]{{{len(m.group())}}}", pattern)
    return F.when(s.rlike(f"^{shape}$"), F.try_to_timestamp(s, F.lit(pattern)))


def _iso(s: Column) -> Column:
    # The leading year keeps bare numbers out of the ISO parser.
    return F.when(s.rlike(r"^[0-9]{4}-"), s.try_cast("timestamp"))


def _any_date(c: Column) -> Column:
    """A timestamp from ISO text or one of the usual layouts, else null."""
    s = coerce.strip(c)
    return F.coalesce(_iso(s), *[parse_day(s, p) for _, p in DATE_LAYOUTS])


def infer_column_types(values: DataFrame) -> DataFrame:
    """Kind of each column of a long ``(column_name, value)`` table.

    ``empty``, ``datetime``, ``numeric`` or ``string``.  Columns named like a
    date need 80 % eight-digit days or 50 % parseable dates; for the others
    every value must agree.
    """
    s = coerce.strip(F.col("value"))
    general = F.coalesce(_iso(s), *[parse_day(s, p) for n, p in DATE_LAYOUTS if n != "YYYYMMDD"])
    eight = parse_day(s, "yyyyMMdd")
    filled = values.filter("value IS NOT NULL")
    shares = values.select("column_name").distinct().join(
        filled.groupBy("column_name").agg(
            F.avg(eight.isNotNull().cast("int")).alias("eight"),
            F.avg(F.coalesce(general, eight).isNotNull().cast("int")).alias("dates"),
            F.bool_and(coerce.number(F.col("value")).isNotNull()).alias("all_numbers"),
            F.bool_and(general.isNotNull()).alias("all_dates"),
        ),
        "column_name",
        "left",
    )
    dated = looks_like_date_name(F.col("column_name"))
    kind = (
        F.when(F.col("eight").isNull(), "empty")
        .when(dated & ((F.col("eight") >= 0.8) | (F.col("dates") >= 0.5)), "datetime")
        .when(F.col("all_numbers"), "numeric")
        .when(~dated & F.col("all_dates"), "datetime")
        .otherwise("string")
    )
    return shares.select("column_name", kind.alias("inferred_type"))


def date_profile(df: DataFrame, columns: list[str], as_of: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Range, validity and future dates per column; ``as_of`` stands for "now".

    Columns with fewer than half valid dates are left out.
    """
    patterns = patterns or {}
    counters, names = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType.typeName()
        if kind in ("timestamp", "date", "timestamp_ntz"):
            d = F.col(c).cast("timestamp")
        else:
            d = F.try_to_timestamp(coerce.strip(F.col(c)), F.lit(patterns[c])) if c in patterns else _any_date(F.col(c))
        counters += [
            F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.count(d).alias(f"ok{i}"),
            F.count_if(d > F.lit(as_of).cast("timestamp")).alias(f"fu{i}"), F.count_if(F.col(c).isNull()).alias(f"nu{i}"),
        ]
        names.append(((c,), [(f"lo{i}", "lo"), (f"hi{i}", "hi"), (f"ok{i}", "valid_date_count"), (f"fu{i}", "future_date_count"),
                             (f"nu{i}", "null_date_count"), ("n", "n")]))
    long = _long_counts(df.agg(*counters), names, ["column_name"]).filter("n > 0 AND valid_date_count * 2 >= n")
    bad = F.col("n") - F.col("valid_date_count")
    return long.select(
        "column_name",
        F.date_format("lo", "yyyy-MM-dd HH:mm:ss").alias("earliest_date"),
        F.date_format("hi", "yyyy-MM-dd HH:mm:ss").alias("latest_date"),
        F.floor((F.unix_micros("hi") - F.unix_micros("lo")) / F.lit(86_400_000_000)).cast("bigint").alias("date_range_days"),
        "valid_date_count",
        pct(F.col("valid_date_count"), F.col("n")).alias("valid_date_pct"),
        bad.alias("invalid_date_count"),
        pct(bad, F.col("n")).alias("invalid_date_pct"),
        "future_date_count",
        pct(F.col("future_date_count"), F.col("n")).alias("future_date_pct"),
        "null_date_count",
        pct(F.col("null_date_count"), F.col("n")).alias("null_date_pct"),
    )


def detect_date_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Date layouts that more than 80 % of a column's values follow."""
    counters, names = [], []
    for i, c in enumerate(columns):
        s = coerce.strip(F.col(c))
        for j, (label, pattern) in enumerate(DATE_LAYOUTS):
            share = F.avg(F.when(F.col(c).isNotNull(), parse_day(s, pattern).isNotNull().cast("int")))
            counters.append(F.round(share, 4).alias(f"s{i}_{j}"))
            names.append(((c, label), [(f"s{i}_{j}", "share")]))
    return _long_counts(df.agg(*counters), names, ["column_name", "date_format"]).filter("share > 0.8")


def validation_summary(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Row totals, error and warning counts, and the overall verdict."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_row = violations.groupBy(*row_identity(violations), "level").agg(
        F.count_if(F.col("severity").isin("error", "critical")).alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    sums = per_row.agg(
        F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warning_count"),
        F.count_if((F.col("errors") > 0) & (F.col("level") == ROW)).alias("bad_rows"),
    )
    return sums.select(
        total.alias("total_rows"),
        F.greatest(total - F.col("bad_rows"), F.lit(0)).cast("bigint").alias("valid_rows"),
        "error_count",
        "warning_count",
        (F.col("error_count") == 0).alias("valid"),
    )
