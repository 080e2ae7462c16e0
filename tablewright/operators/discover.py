"""Detection of formats, layouts, record types and drift over whole corpora.

Input is one table of lines ``(file, line, content)`` for any number of files.
Everything is decided from all lines of a file, never from a sample, and from
aggregates that are reduced before the shuffle, so one file may hold most of
the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import coerce
from tablewright.operators.groups import rows_of_groups
from tablewright.session import written_once

# Delimiters and their format names, in order of preference.
DELIMITERS = {"pipe_delimited": "|", "csv": ",", "tsv": "\t"}

# Drift detection.
LEADING_BLANK_SHARE = 0.8
BOUNDARY_SHARE = 0.5
SEARCH_RADIUS = 15
LARGE_OFFSET = 5
LEAST_LINES = 3

# Where a discriminator usually stands; callers may widen the search.
MAX_POSITION, MAX_LENGTH = 11, 6


def _count_of(delimiter: str) -> Column:
    return (F.char_length("content") - F.char_length(F.replace("content", F.lit(delimiter), F.lit("")))).cast("bigint")


def _spread(c: Column, name: str) -> list[Column]:
    """Aggregates that tell whether a number takes one, two or more values."""
    wide = c.cast("decimal(19,0)")
    return [
        F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"),
        F.sum(wide).alias(f"{name}_sum"), F.sum((c * c).cast("decimal(19,0)")).alias(f"{name}_squares"),
    ]


def _at_most_two(name: str) -> Column:
    """All values equal the minimum or the maximum.

    Each term of the sum of (x - min)(max - x) is 0 at both ends and positive
    in between, so the sum is 0 only if nothing lies in between.  It follows
    from plain sums, which need no distinct.
    """
    lo, hi = F.col(f"{name}_min").cast("decimal(19,0)"), F.col(f"{name}_max").cast("decimal(19,0)")
    n = F.col("line_count").cast("decimal(19,0)")
    between = (lo + hi) * F.col(f"{name}_sum") - F.col(f"{name}_squares") - n * lo * hi
    return between == 0


def detect_format(lines: DataFrame, file: str = "file") -> DataFrame:
    """Best format per file with its confidence; 0.5 or less is unknown."""
    aggs = [F.count(F.lit(1)).alias("line_count")]
    for name, d in DELIMITERS.items():
        aggs += _spread(_count_of(d), name)
    aggs += _spread(F.char_length("content").cast("bigint"), "length")
    per_file = lines.filter("content <> ''").groupBy(file).agg(*aggs)

    def delimited(name: str, one: Column, two: float, some: float) -> Column:
        lo, hi = F.col(f"{name}_min"), F.col(f"{name}_max")
        return F.when((lo == hi) & (lo > 0), one).when(_at_most_two(name) & (lo > 0), two).when(hi > 0, some).otherwise(0.0)

    any_delimiter = F.greatest(*[F.col(f"{n}_max") for n in DELIMITERS]) > 0
    pipe = delimited("pipe_delimited", F.lit(0.95), 0.75, 0.5)
    csv = delimited("csv", F.when(F.col("pipe_delimited_max") == 0, 0.9).otherwise(0.6), 0.7, 0.4)
    tsv = delimited("tsv", F.lit(0.9), 0.7, 0.4)
    fixed = (
        F.when(F.col("line_count") < LEAST_LINES, 0.0)
        .when(F.col("length_min") == F.col("length_max"), F.when(any_delimiter, 0.3).otherwise(0.85))
        .when(_at_most_two("length"), 0.6)
        .otherwise(0.2)
    )
    scored = per_file.select(file, "line_count", pipe.alias("p"), csv.alias("c"), tsv.alias("t"), fixed.alias("f")).withColumn(
        "confidence", F.greatest("p", "c", "t", "f")
    )
    best = F.lit("unknown")
    for name, col in reversed([("pipe_delimited", "p"), ("csv", "c"), ("tsv", "t"), ("fixed_width", "f")]):
        best = F.when(F.col(col) == F.col("confidence"), name).otherwise(best)
    return scored.select(file, F.when(F.col("confidence") > 0.5, best).otherwise("unknown").alias("format"), "confidence", "line_count")


def modal_column_count(lines: DataFrame, delimiter: str, file: str = "file") -> DataFrame:
    """The most common number of columns per file; the first seen wins a tie."""
    counted = lines.groupBy(file, (_count_of(delimiter) + 1).alias("n")).agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"))
    return counted.groupBy(file).agg(F.max_by("n", F.struct("lines", -F.col("first"))).alias("column_count"))


# Positions of one bitmap; a bigint holds them without its sign.
BITMAP = 60


def infer_boundaries(lines: DataFrame, file: str = "file") -> DataFrame:
    """Fields of fixed-width files: runs of positions filled on some line.

    Each ``BITMAP`` characters of a line become one bitmap of filled positions,
    and the bitmaps of a file are combined by OR before the shuffle.  The runs
    are then found over at most one line width per file.  A file with blank
    lines only is one field.
    """
    width = F.char_length("content")
    starts = F.sequence(F.lit(0), F.floor((width - 1) / BITMAP).cast("int"))
    pieces = lines.filter("content <> ''").select(file, width.alias("width"), "content", F.explode(starts).alias("piece"))
    # The first character is the lowest bit.
    text = F.reverse(F.substring(F.col("content"), F.col("piece") * BITMAP + 1, F.lit(BITMAP)))
    bits = F.conv(F.translate(F.regexp_replace(text, "[^ ]", "1"), " ", "0"), 2, 10).cast("bigint")
    used = pieces.groupBy(file, "piece").agg(F.bit_or(bits).alias("bits"), F.max("width").alias("width"))
    places = F.filter(F.sequence(F.lit(0), F.lit(BITMAP - 1)), lambda i: F.getbit(F.col("bits"), i) == 1)
    filled = used.select(file, F.explode(F.transform(places, lambda i: F.col("piece") * BITMAP + i)).alias("i"))
    # Consecutive positions share the difference to their rank.
    rank = F.row_number().over(W.partitionBy(file).orderBy("i"))
    runs = filled.withColumn("run", F.col("i") - rank).groupBy(file, "run").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"))
    blank_only = used.groupBy(file).agg(F.max(F.col("bits") != 0).alias("any"), F.max("width").alias("hi")).filter("NOT any")
    spans = runs.select(file, "lo", "hi").unionByName(blank_only.select(file, F.lit(0).alias("lo"), "hi"))
    number = F.row_number().over(W.partitionBy(file).orderBy("lo"))
    return spans.select(file, number.alias("field_number"), F.col("lo").alias("start"), F.col("hi").alias("end"))


DAY_TEXT = "^(?:19|20)[0-9]{6}$"
NUMBER_TEXT = r"^[+-]?[0-9]+(?:\.[0-9]+)?$"


def infer_types(values: DataFrame, by: list[str]) -> DataFrame:
    """``date``, ``number`` or ``string``: every filled value must agree."""
    s = coerce.strip(F.col("value"))
    filled = F.coalesce(s != "", F.lit(False))
    per = values.groupBy(*by).agg(
        F.bool_and(F.when(filled, s.rlike(DAY_TEXT))).alias("days"), F.bool_and(F.when(filled, s.rlike(NUMBER_TEXT))).alias("numbers")
    )
    return per.select(*by, F.when(F.col("days"), "date").when(F.col("numbers"), "number").otherwise("string").alias("data_type"))


def infer_mapping(lines: DataFrame, file: str = "file") -> DataFrame:
    """Draft mapping of every file: its format, fields, positions and types.

    Files of unknown format get no fields.  The formats (one row per file) and
    the fixed-width fields are written once because several steps read them.
    """
    formats = written_once(detect_format(lines, file))
    filled = lines.filter("content <> ''").select(file, "line", "content")
    typed = rows_of_groups(filled, formats.filter("format <> 'unknown'").select(file, "format", "line_count"), [file], "line_count")

    bounds = written_once(infer_boundaries(typed.filter("format = 'fixed_width'").select(file, "content"), file))
    spans = bounds.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("field_number", "start", "end"))).alias("spans"))
    sized = written_once(spans.join(formats.select(file, "line_count"), file))
    sliced = rows_of_groups(filled.select(file, "content"), sized, [file], "line_count").select(file, "content", F.explode("spans").alias("s"))
    cut = F.substring(F.col("content"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    fixed_types = infer_types(sliced.select(file, F.col("s.field_number").alias("field_number"), cut.alias("value")), [file, "field_number"])
    fixed_fields = bounds.join(fixed_types, [file, "field_number"]).select(
        file, "field_number", "data_type", F.col("start").alias("position"), (F.col("end") - F.col("start")).alias("length")
    )

    pattern = F.lit(None).cast("string")
    for name, d in DELIMITERS.items():
        pattern = F.when(F.col("format") == name, re.escape(d)).otherwise(pattern)
    parts = typed.filter(F.col("format").isin(*DELIMITERS)).withColumn("parts", F.split("content", pattern, -1))
    sizes = parts.groupBy(file, F.size("parts").alias("n")).agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"))
    counts = sizes.groupBy(file).agg(F.max_by("n", F.struct("lines", -F.col("first"))).alias("column_count"))
    cells = parts.select(file, F.posexplode("parts").alias("i", "value")).withColumn("field_number", F.col("i") + 1)
    nothing = F.lit(None).cast("int")
    delimited_fields = (
        infer_types(cells, [file, "field_number"]).join(counts, file).filter("field_number <= column_count")
        .select(file, "field_number", "data_type", nothing.alias("position"), nothing.alias("length"))
    )
    number = F.col("field_number").cast("string")
    name = F.concat(F.lit("FIELD_"), F.when(F.char_length(number) >= 3, number).otherwise(F.lpad(number, 3, "0")))
    fields = fixed_fields.unionByName(delimited_fields)
    return formats.select(file, "format").join(fields, file).select(file, "format", "field_number", name.alias("name"), "data_type", "position", "length")


# Items that a frequency sketch keeps apart; its counts are off by 3.5 / SKETCH_ITEMS of the lines at most.
SKETCH_ITEMS = 1024
# Sketches of one aggregation.
SKETCHES = 120
MOST_VALUES = 8


def _promising_cells(rows: DataFrame, file: str, cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cells whose eight most frequent values can cover half of the lines of some file.

    One scan, no row per cell: every cell has a mergeable frequency sketch per
    file.  What the sketches may miss is allowed for, so no candidate is lost.
    """
    sketches = [F.call_function("approx_top_k", F.substring("content", p, n), F.lit(MOST_VALUES), F.lit(SKETCH_ITEMS)).alias(f"c{i}") for i, (p, n) in enumerate(cells)]
    counted = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"), *sketches)
    least = 0.5 - 2 * MOST_VALUES * 3.5 / SKETCH_ITEMS
    held = [
        F.max(F.aggregate(F.col(f"c{i}"), F.lit(0).cast("bigint"), lambda s, x: s + x["count"]) >= F.col("n") * least).alias(f"c{i}")
        for i in range(len(cells))
    ]
    verdict = counted.agg(*held).first()
    return [cell for i, cell in enumerate(cells) if verdict[f"c{i}"]]


def detect_discriminator(lines: DataFrame, file: str = "file", max_position: int | None = None, max_length: int = MAX_LENGTH) -> DataFrame:
    """Candidate record-type fields per file, best first.

    A candidate has 2 to 8 values that repeat and cover at least half of the
    lines, and lies within the shortest line of its file.  Fields of up to
    ``max_length`` characters are tried at all starts within the longest of the
    files' shortest lines, or up to ``max_position``.

    Sketches rule out most cells of this grid first, in one scan where the grid
    is small.  In a wide grid they go by length: a longer field covers no more
    than its start does, so only starts that are left are tried further.  The
    values of what remains are counted exactly.  This runs jobs.
    """
    rows = lines.filter(coerce.is_filled(F.col("content")))
    if max_position is None:
        least = rows.groupBy(file).agg(F.min(F.char_length("content")).alias("n"))
        max_position = least.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    starts, left = list(range(1, max_position + 1)), []
    lengths = [range(1, max_length + 1)] if len(starts) * max_length <= SKETCHES else [[n] for n in range(1, max_length + 1)]
    for tried in lengths:
        cells = [(p, n) for p in starts for n in tried]
        found = [c for at in range(0, len(cells), SKETCHES) for c in _promising_cells(rows, file, cells[at : at + SKETCHES])]
        left += found
        starts = sorted({p for p, _ in found})
    entries = [F.struct(F.lit(p).alias("position"), F.lit(n).alias("length"), F.substring("content", p, n).alias("v")) for p, n in left]
    grid = F.array(*entries) if entries else F.expr("cast(array() as array<struct<position:int,length:int,v:string>>)")
    counted = rows.select(file, F.inline(grid)).filter(F.char_length("v") == F.col("length")).groupBy(file, "position", "length", "v").agg(F.count(F.lit(1)).alias("n"))
    repeating = counted.filter("n >= 2").groupBy(file, "position", "length").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("covered"), F.min("v").alias("least_value"), F.max("v").alias("greatest_value")
    )
    sizes = rows.groupBy(file).agg(F.count(F.lit(1)).alias("total"), F.min(F.char_length("content")).alias("shortest"))
    found = repeating.filter(F.col("distinct_values").between(2, MOST_VALUES)).join(sizes, file)
    return (
        found.filter("position + length - 1 <= shortest AND covered * 2 >= total")
        .withColumn("confidence", F.round(F.col("covered") / F.col("total"), 4))
        .select(file, "position", "length", "distinct_values", "confidence", "least_value", "greatest_value")
    )


def best_discriminator(candidates: DataFrame, file: str = "file") -> DataFrame:
    """Highest coverage, then more values, then earlier, then longer."""
    order = F.struct("confidence", "distinct_values", -F.col("position"), "length")
    return candidates.groupBy(file).agg(F.max_by(F.struct("position", "length", "confidence"), order).alias("b")).select(file, "b.*")


@dataclass(frozen=True)
class DeclaredField:
    name: str
    start: int
    length: int


def fixed_width_drift(lines: DataFrame, layout: list, file: str = "file") -> DataFrame:
    """Fields whose declared start is blank while text begins nearby.

    ``layout`` items have ``name, start`` (1-based) ``and length``.  Text
    starts are counted once per file and position and shared by all fields.
    """
    rows = lines.filter(coerce.is_filled(F.col("content")))  # never empty
    total = F.count(F.lit(1)).alias("total")
    blanks = [F.count_if(F.coalesce(coerce.strip(F.substring("content", f.start, 1)) == "", F.lit(True))).alias(f"b{i}") for i, f in enumerate(layout)]
    per_file = rows.groupBy(file).agg(total, *blanks).filter(F.col("total") >= LEAST_LINES)
    declared = F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.lit(f.start).alias("expected_start"), F.lit(f.length).alias("length"), F.col(f"b{i}").alias("blank"))
        for i, f in enumerate(layout)
    ])
    suspects = per_file.select(file, "total", F.inline(declared)).filter(F.col("blank") > F.col("total") * LEADING_BLANK_SHARE)

    # A start is a filled position whose left neighbour is blank; with a blank
    # put in front, position p and its left neighbour are characters p+1 and p.
    # Only positions near a declared start can matter, wherever in the line they are.
    head = F.concat(F.lit(" "), F.translate("content", "\t\r\n\f", "    "))
    near_any = sorted({p for f in layout for p in range(max(1, f.start - SEARCH_RADIUS), f.start + SEARCH_RADIUS)})
    places = rows.select(file, head.alias("head")).select(file, "head", F.explode(F.array(*map(F.lit, near_any))).alias("at")).filter(F.col("at") < F.char_length("head"))
    starts = places.filter((F.substr("head", F.col("at"), F.lit(1)) == " ") & (F.substr("head", F.col("at") + 1, F.lit(1)) != " "))
    counted = starts.groupBy(file, "at").agg(F.count(F.lit(1)).alias("score"))
    near = (F.col("at") >= F.col("expected_start") - SEARCH_RADIUS) & (F.col("at") < F.col("expected_start") + SEARCH_RADIUS) & (F.col("at") != F.col("expected_start"))
    best = (
        suspects.join(counted, file).filter(near)
        .groupBy(file, "name", "expected_start", "length", "total")
        .agg(F.max_by("at", F.struct("score", -F.col("at"))).alias("actual_start"), F.max("score").alias("score"))
        .filter(F.col("score") > F.col("total") * BOUNDARY_SHARE)
    )
    offset = F.abs(F.col("actual_start") - F.col("expected_start"))
    return best.select(
        file, "name", "expected_start", "actual_start", F.col("length").alias("expected_length"),
        F.when(offset > LARGE_OFFSET, "error").otherwise("warning").alias("severity"), F.lit("position").alias("reason"),
    )


def delimited_drift(lines: DataFrame, fields: list[str], delimiter: str, file: str = "file") -> DataFrame:
    """Missing and unexpected header columns, or a wrong column count.

    The first filled line of a file is its header if any of its values is not
    a number.
    """
    filled = coerce.is_filled(F.col("content"))
    first = lines.groupBy(file).agg(F.min_by("content", F.when(filled, F.col("line"))).alias("first")).filter("first IS NOT NULL")
    columns = F.transform(F.split("first", re.escape(delimiter), -1), lambda c: coerce.strip(c))
    heads = first.select(file, columns.alias("c"))
    has_header = F.exists("c", lambda c: (c != "") & ~c.rlike(r"^-*\.*[0-9][0-9.]*$"))
    wanted = F.array(*[F.lit(f) for f in fields])

    def entries(names: Column, severity: str, reason: str) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(severity).alias("severity"), F.lit(reason).alias("reason")))

    missing = entries(F.array_except(wanted, "c"), "error", "column_missing")
    unexpected = entries(F.filter(F.array_except("c", wanted), lambda n: n != ""), "warning", "unexpected_column")
    count = entries(F.array(F.lit("_column_count")), "error", "column_count_mismatch")
    found = F.when(has_header, F.concat(missing, unexpected)).when(F.size("c") != len(fields), count)
    return heads.select(file, F.size("c").alias("actual_columns"), F.inline(found))


FORMAT_ALIASES = {
    "csv": ",",
    "pipe": "|", "pipe-delimited": "|", "psv": "|",
    "tsv": "\t", "tab": "\t",
    "fixed": None, "fixed-width": None, "fixed_width": None, "": None,
}


def drift_report(lines: DataFrame, mapping: dict, file: str = "file") -> DataFrame:
    """Drift of files against one mapping, with the files that were skipped.

    Output: file, name, severity, reason.  Reasons for skipping: too_short,
    no_fields, unsupported_format.
    """
    named = [mapping[k] for k in ("format", "file_format") if mapping.get(k)]
    fmt = str(named[0]).lower() if named else ""
    fields = mapping.get("fields", [])
    out = [file, "name", "severity", "reason"]
    nothing = F.lit(None).cast("string")
    filled = F.count_if(coerce.is_filled(F.col("content")))
    files = lines.groupBy(file).agg(filled.alias("filled"))
    if fmt not in FORMAT_ALIASES or not fields:
        why = "unsupported_format" if fmt not in FORMAT_ALIASES else "no_fields"
        return files.select(file, nothing.alias("name"), F.lit("skipped").alias("severity"), F.lit(why).alias("reason"))
    delimiter = FORMAT_ALIASES[fmt]
    least = LEAST_LINES if delimiter is None else 1
    short = files.filter(F.col("filled") < least).select(file, nothing.alias("name"), F.lit("skipped").alias("severity"), F.lit("too_short").alias("reason"))
    if delimiter is None:
        layout = [DeclaredField(f.get("name", ""), int(f["position"]), int(f["length"])) for f in fields if f.get("position") is not None and f.get("length")]
        found = fixed_width_drift(lines, layout, file)
    else:
        found = delimited_drift(lines, [f.get("name", "") for f in fields], delimiter, file)
    return found.select(*out).unionByName(short)
