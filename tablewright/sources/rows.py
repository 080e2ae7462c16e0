"""Row numbers without gathering rows in one task.

A row number needs to know how many rows come before.  The numbered frame is
written once to the shared folder that the cluster names, so that the
row positions are data: a lost executor or a changed file split can not give
two answers within one query.  The number of rows per partition is then turned
into offsets; that table has one row per partition and is safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.session import written_once

# monotonically_increasing_id keeps the partition above bit 33.
PARTITION_BITS = 33


def _written_once(df: DataFrame) -> DataFrame:
    return written_once(df.withColumn("_at", F.monotonically_increasing_id()))


def number_rows(df: DataFrame, order_by: list, name: str = "_row") -> DataFrame:
    """Number rows 1, 2, 3, ... in the order of ``order_by``.

    The position of a row in the input is the last sort key, so even a third
    of all rows with one sort value is spread over many range partitions.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = _written_once(tied.orderBy(*order_by, "_tie").drop("_tie"))
    part = F.shiftright("_at", PARTITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND((1 << PARTITION_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, inside + F.col("_before") + 1)
        .drop("_at", "_part", "_before")
    )


def number_file_rows(lines: DataFrame, name: str = "_row") -> DataFrame:
    """Number the physical lines of each file; ``lines`` comes from a text scan.

    Adds ``_file``.  A block of a file is read in order by one task, so the
    line number is the position in the block plus the lines of earlier blocks
    of the same file.
    """
    placed = _written_once(
        lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    )
    blocks = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("_file").orderBy("_block")) - F.col("_n")
    offsets = blocks.select("_file", "_block", "_first", earlier.alias("_before"))
    # One row per file block: Spark broadcasts it when it is small, and joins
    # by shuffle otherwise; no block exceeds the split size, so no skew.
    return (
        placed.join(offsets, ["_file", "_block"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_at", "_block", "_first", "_before")
    )


def number_reported_rows(lines: DataFrame, reported: Column, name: str = "_row") -> DataFrame:
    """The ``reported`` lines of a text scan with ``_file`` and their number in it.

    Numbers are resolved late: a line carries its file, block and place, and
    only lines that are reported meet an index with one row per file block.
    The other lines are counted, but neither written nor joined.  Both scans
    belong to one plan and so see the same blocks.
    """
    placed = lines.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    blocks = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("_file").orderBy("_block")) - F.col("_n")
    index = blocks.select("_file", "_block", "_first", earlier.alias("_before"))
    # Places are given before lines are left out: the id is not deterministic, so no filter passes it.
    found = placed.filter(reported)
    return found.join(index, ["_file", "_block"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_block", "_first", "_before")
