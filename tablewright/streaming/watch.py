"""Rules over arriving files: a stream of batches, or an unbounded table.

Cross-row rules need a unit that is whole.  ``landed`` takes the rows of one
batch together, ``file`` those of one file, and ``all`` everything that has
arrived so far, however it was dealt over files and batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators import profile
from tablewright.operators.mapping import mask_columns, transform_rows
from tablewright.operators.rules import (
    GroupRule, RuleSet, group_members, group_partials, member_violations, merged_groups, shared_keys, validate,
)

UNITS = ("landed", "file", "all")


@dataclass(frozen=True)
class WatchTarget:
    """Where landed batches are read from and results are kept."""

    folder: str
    schema: str
    results: str
    checkpoint: str
    format: str = "parquet"
    options: tuple = ()
    name_glob: str | None = None
    files_per_batch: int | None = None


def read_arriving(spark: SparkSession, target: WatchTarget) -> DataFrame:
    reader = spark.readStream.format(target.format).schema(target.schema).options(**dict(target.options))
    if target.name_glob:
        reader = reader.option("pathGlobFilter", target.name_glob)
    if target.files_per_batch:
        reader = reader.option("maxFilesPerTrigger", target.files_per_batch)
    return reader.load(target.folder).withColumn("_file", F.col("_metadata.file_path"))


def _group_rules(rules, columns) -> list[GroupRule]:
    """Active cross-row rules whose columns exist; the others are reported as skipped with the row rules."""
    active = rules.active() if isinstance(rules, RuleSet) else [r for r in rules if r.enabled]
    return [r for r in active if isinstance(r, GroupRule) and {*r.keys, *([r.target] if r.target else [])} <= set(columns)]


def watch_and_validate(
    spark: SparkSession, target: WatchTarget, rules, row_id, available_now: bool = True, every: str = "1 minute", unit: str = "landed"
) -> StreamingQuery:
    """Validate each landed batch and keep its violations and totals.

    All kinds of rules run; ``unit`` says which rows a cross-row rule sees
    together.  Violations name their file.  What a batch writes goes to folders
    of its own that a repeated batch overwrites, so a restart after a failure
    leaves every result exactly once.

    With ``unit="all"`` a batch keeps the members of its groups and adds one
    partial state per group to the state table; nothing written before is read
    or rewritten, so a batch costs what it brings.  ``landed_violations``
    merges the states and reports every row of a broken group, those of
    earlier batches included, once; the totals of a batch are then those of
    its row rules.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept_back = _group_rules(rules, batch.columns) if unit == "all" else []
        active = rules.active() if isinstance(rules, RuleSet) else [r for r in rules if r.enabled]
        found = validate(batch, [r for r in active if r not in kept_back], row_id, within=("_file",) if unit == "file" else ())
        place = f"{target.results}/violations/batch_id={batch_id}"
        found.write.mode("overwrite").parquet(place)
        row_number = F.col(row_id) if isinstance(row_id, str) else row_id
        for n, same in enumerate(shared_keys(kept_back)):
            members = f"{target.results}/members/{n}/batch_id={batch_id}"
            group_members(batch, same, row_number, ("_file",)).write.mode("overwrite").parquet(members)
            states = group_partials(batch.sparkSession.read.parquet(members), same)
            states.write.mode("overwrite").parquet(f"{target.results}/groups/{n}/batch_id={batch_id}")
        # The totals read the violations just written; rules run once.
        kept = batch.sparkSession.read.parquet(place)
        profile.validation_summary(batch, kept).write.mode("overwrite").parquet(f"{target.results}/metrics/batch_id={batch_id}")

    writer = read_arriving(spark, target).writeStream.foreachBatch(handle).option("checkpointLocation", target.checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def stream_violations(stream: DataFrame, rules, row_id) -> DataFrame:
    """Row-local rules on an unbounded table; the output is append-only."""
    if any(isinstance(r, GroupRule) for r in rules):
        raise ValueError("cross-row rules need a batch: use watch_and_validate")
    return validate(stream, rules, row_id)


def stream_clean_rows(stream: DataFrame, keep: Column) -> DataFrame:
    return stream.filter(keep)


def stream_transform(stream: DataFrame, targets: list, keep=()) -> DataFrame:
    return transform_rows(stream, targets, keep)


def stream_mask(stream: DataFrame, spec: dict, seed: int = 0) -> DataFrame:
    return mask_columns(stream, spec, seed)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that has arrived, append it as parquet, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_results(spark: SparkSession, target: WatchTarget) -> tuple[DataFrame, DataFrame]:
    """Violations and totals of all batches so far."""
    return spark.read.parquet(f"{target.results}/violations"), spark.read.parquet(f"{target.results}/metrics").withColumn("batch_id", F.col("batch_id"))


def landed_violations(spark: SparkSession, target: WatchTarget, rules) -> DataFrame:
    """Violations of everything that arrived under ``unit="all"``, each row and rule once.

    ``rules`` are those of the watch.  The partial states of all batches are
    merged, and members of broken groups are joined to the verdict with hot
    groups apart.
    """
    parts = [read_results(spark, target)[0].drop("batch_id")]
    columns = [*spark.createDataFrame([], target.schema).columns, "_file"]
    for n, same in enumerate(shared_keys(_group_rules(rules, columns))):
        groups = merged_groups(spark.read.parquet(f"{target.results}/groups/{n}"), same)
        members = spark.read.parquet(f"{target.results}/members/{n}").drop("batch_id")
        parts.append(member_violations(members, groups, same, ("_file",)).select(*parts[0].columns))
    return reduce(DataFrame.unionByName, parts)


def merge_states(spark: SparkSession, target: WatchTarget, rules, folder: str) -> list[DataFrame]:
    """One row per group so far, for each set of rules with shared keys, written to ``folder``: for reports on groups."""
    columns = [*spark.createDataFrame([], target.schema).columns, "_file"]
    out = []
    for n, same in enumerate(shared_keys(_group_rules(rules, columns))):
        merged_groups(spark.read.parquet(f"{target.results}/groups/{n}"), same).write.mode("overwrite").parquet(f"{folder}/{n}")
        out.append(spark.read.parquet(f"{folder}/{n}"))
    return out
