"""Folders of files: inventory, line search, archives, and error extracts."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import os
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.violations import of_rows, row_identity
from tablewright.sources.rows import number_file_rows, number_reported_rows

LARGE_FILE = 1024**3
SMALL_FILE = 10
# Bytes read at once from a stream.
PIECE = 8 * 1024**2


def read_lines(spark: SparkSession, path: str, name_glob: str | None = None) -> DataFrame:
    """Physical lines with ``_file`` and the 1-based ``_row`` in the file."""
    reader = spark.read.option("pathGlobFilter", name_glob) if name_glob else spark.read
    return number_file_rows(reader.text(path))


def _one_slash_form(path: Column) -> Column:
    """Local paths are shown with one or three slashes; settle on one."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def open_stored(place: str):
    """A seekable stream of a file in the store that its URI names; nothing is read ahead of its use."""
    store, path = FileSystem.from_uri(place if "://" in place else re.sub("^file:/+", "file:///", place))
    return store.open_input_file(path)


def stream_digests(places: DataFrame, place: str = "path") -> DataFrame:
    """``place, sha256, error`` of files of any size.

    A task reads its files in pieces and carries the state of the hash, so it
    holds one piece whatever the size.  A file that can not be read has the
    reason in ``error``.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for where in batch.column(0).to_pylist():
                state = hashlib.sha256()
                try:
                    with open_stored(where) as stream:
                        while piece := stream.read(PIECE):
                            state.update(piece)
                    out.append((where, state.hexdigest(), None))
                except (OSError, pa.ArrowException) as why:
                    out.append((where, None, f"{type(why).__name__}: {why}"))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[place, "sha256", "error"])

    return places.select(place).mapInArrow(digests, f"`{place}` string, sha256 string, error string")


def file_inventory(spark: SparkSession, path: str, name_glob: str | None = None, in_one_piece: int = 256 * 1024**2) -> DataFrame:
    """Size, time, line count, SHA-256 and a size note per file.

    Every file that is not empty gets its digest.  Contents of up to
    ``in_one_piece`` bytes are hashed in the scan (the filter is pushed into
    it); longer files are read as streams by tasks of their own.
    ``sha256_status`` is ``hashed``, ``empty``, or says why a stream could not
    be read.  Lines are counted by a text scan that splits files.
    """
    reader = spark.read.format("binaryFile")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    files = reader.load(path)
    place = _one_slash_form(F.col("_metadata.file_path")).alias("file")
    scanned = files.select(place, F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    # A scan leaves out empty files; the listing that Spark keeps has them.
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string").select(_one_slash_form(F.col("file")).alias("file"))
    meta = listed.join(scanned, "file", "left").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
    small = files.filter(F.col("length") <= in_one_piece).select(place, F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("error"))
    streamed = stream_digests(files.filter(F.col("length") > in_one_piece).select("path"))
    hashes = small.unionByName(streamed.withColumn("file", _one_slash_form(F.col("path"))).drop("path"))
    text = spark.read.option("pathGlobFilter", name_glob) if name_glob else spark.read
    lines = text.text(path).groupBy(place).agg(F.count(F.lit(1)).alias("line_count"))
    note = (
        F.when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") < SMALL_FILE, "very small")
        .when(F.col("size_bytes") > LARGE_FILE, "large").otherwise("ok")
    )
    return (
        meta.join(hashes, "file", "left").join(lines, "file", "left")
        .withColumn("line_count", F.coalesce("line_count", F.lit(0)))
        .withColumn("name", F.element_at(F.split("file", "/"), -1))
        .withColumn("note", note)
        .withColumn("sha256_status", F.when(F.col("sha256").isNotNull(), "hashed").otherwise(F.coalesce("error", F.lit("empty"))))
        .drop("error")
    )


def grep_lines(lines: DataFrame, needle: str, content: str = "content") -> DataFrame:
    """Lines that contain a literal text."""
    return lines.filter(F.col(content).contains(needle))


def grep_files(spark: SparkSession, path: str, needle: str, name_glob: str | None = None) -> DataFrame:
    """``file, line, content`` of every matching line in a folder.

    Lines without a match are counted but not carried.
    """
    reader = spark.read.option("pathGlobFilter", name_glob) if name_glob else spark.read
    lines = number_reported_rows(reader.text(path), F.col("value").contains(needle))
    return lines.select(
        F.element_at(F.split("_file", "/"), -1).alias("file"), F.col("_row").alias("line"), F.rtrim("value").alias("content")
    )


def top_hits(hits: DataFrame, n: int, order_by=("file", "line")) -> DataFrame:
    """The first ``n`` hits, as a search page shows them."""
    return hits.orderBy(*order_by).limit(n)


def hit_totals(hits: DataFrame, shown: int, file: str = "file") -> DataFrame:
    """Number of hits and of files, and whether a page of ``shown`` is cut."""
    per_file = hits.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"), F.count(F.lit(1)).alias("matched_files")).withColumn(
        "truncated", F.col("total_matches") > shown
    )


def _members(name: str, stream) -> Iterator[tuple[str, io.BufferedIOBase]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(stream) as z:
            for info in z.infolist():
                if not info.is_dir():
                    with z.open(info) as f:
                        yield info.filename, f
    else:
        with tarfile.open(fileobj=stream, mode="r:gz") as tar:
            for member in tar:
                if member.isfile():
                    yield member.name, tar.extractfile(member)


def _searched(archives: DataFrame, opened, needle: str, file_glob: str, batch: int) -> DataFrame:
    """Hits in archives whose first column is a path; ``opened`` makes a stream of a row."""
    schema = pa.schema([("archive", pa.string()), ("file", pa.string()), ("line", pa.int64()), ("content", pa.string()), ("error", pa.string())])

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for frame in frames:
            # Contents become Python objects one archive at a time.
            for at in range(frame.num_rows):
                row = [column[at] for column in frame.columns]
                name = os.path.basename(row[0].as_py())
                try:
                    with opened(*row) as stream:
                        for member, f in _members(name, stream):
                            if not fnmatch.fnmatch(os.path.basename(member), file_glob):
                                continue
                            for number, line in enumerate(io.TextIOWrapper(f, "utf-8", "replace"), 1):
                                if needle in line:
                                    found.append((name, member, number, line.rstrip(), None))
                                    if len(found) >= batch:
                                        yield as_batch(found)
                                        found = []
                except (OSError, EOFError, zlib.error, zipfile.BadZipFile, tarfile.TarError, pa.ArrowException) as why:
                    found.append((name, None, None, None, f"{type(why).__name__}: {why}"))
        if found:
            yield as_batch(found)

    return archives.mapInArrow(search, "archive string, file string, line bigint, content string, error string")


def search_archives(archives: DataFrame, needle: str, file_glob: str = "*", batch: int = 10_000) -> DataFrame:
    """``archive, file, line, content`` of matching lines inside zip and tar.gz.

    ``archives`` has ``path`` and ``content``.  They are spread over tasks;
    members are read line by line and hits are handed on in batches, so a task
    never holds a whole member.  An archive that can not be read to its end
    yields one row with the reason in ``error`` and no file.
    """
    return _searched(archives.select("path", "content"), lambda path, content: io.BytesIO(content.as_py() or b""), needle, file_glob, batch)


def grep_archives(spark: SparkSession, path: str, needle: str, archive_glob: str = "*", file_glob: str = "*", batch: int = 10_000) -> DataFrame:
    """Search the archives of a folder.

    Archives are listed by a scan that reads no contents and dealt over tasks,
    which open them as streams: the size of an archive is not bounded, and a
    task holds a buffer of it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", archive_glob).load(path)
    places = files.filter(F.col("path").rlike(r"\.(zip|tar\.gz|tgz)$")).select("path")
    return _searched(places, lambda path: open_stored(path.as_py()), needle, file_glob, batch)


def extract_error_rows(rows: DataFrame, violations: DataFrame, row_id="_row", header_row: int | None = None) -> DataFrame:
    """The original rows that have at least one violation, each once.

    Rows and violations meet on the row number and on every id column that the
    violations carry (such as ``_file``), null-safe.  ``header_row`` keeps that
    row number of every file as well (the header of a delimited file).
    Violations are reduced to these columns before the join.
    """
    number: Column = F.col(row_id) if isinstance(row_id, str) else row_id
    ids = row_identity(violations)
    bad = of_rows(violations).groupBy(*ids).agg(F.lit(1).alias("_bad"))
    bad = bad.select(*[F.col(c).alias(f"_bad_{c}") for c in ids])
    numbered = rows.withColumn("_number", number.cast("bigint"))
    same = [F.col("_number" if c == "row_number" else c).eqNullSafe(F.col(f"_bad_{c}")) for c in ids]
    found = numbered.join(bad, reduce(lambda a, b: a & b, same), "left_semi")
    if header_row is not None:
        header = numbered.filter(F.col("_number") == header_row)
        found = header.unionByName(found.filter(F.col("_number") != header_row))
    return found.drop("_number")
