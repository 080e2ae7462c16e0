"""Session settings the operators are written for."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextvars import ContextVar, Token
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

# Settings worth having on any cluster.  Shuffle partitions are
# left to adaptive execution, which merges small ones and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


class Scratch:
    """The tables of ``written_once`` made inside its ``with`` blocks.

    ``discard`` deletes those tables and no others, so whoever opened the
    scope decides about its own steps only.  Scopes nest: a table belongs to
    the innermost open one.
    """

    _open: ContextVar[tuple[Scratch, ...]] = ContextVar("open_scratch", default=())

    def __init__(self) -> None:
        self.folders: list[str] = []
        self._tokens: list[Token] = []

    def __enter__(self) -> Scratch:
        self._tokens.append(Scratch._open.set((*Scratch._open.get(), self)))
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.reset(self._tokens.pop())

    @classmethod
    def own(cls, folder: str) -> None:
        if scopes := cls._open.get():
            scopes[-1].folders.append(folder)

    def discard(self, spark: SparkSession, keep: DataFrame | None = None) -> None:
        """Delete the scope's tables but those that ``keep`` reads; results that read them must be written."""
        read = [_bare(f) for f in keep.inputFiles()] if keep is not None else []
        left = [folder for folder in self.folders if any(f.startswith(_bare(folder) + "/") for f in read)]
        for folder in self.folders:
            if folder not in left:
                remove_folder(spark, folder)
        self.folders = left


def _bare(place: str) -> str:
    """A path without scheme, authority and doubled slashes, in which local paths are written in several ways."""
    return re.sub("^[a-z0-9+.-]+:(//[^/]*)?", "", unquote(place)).replace("//", "/")


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("tablewright")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names.

    Only a local session, where all tasks see one disk, may fall back to a
    temporary folder; elsewhere a missing setting is an error, because the
    folder of one machine would split or lose intermediate data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location, for derived files."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_once(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write an intermediate result that several branches read.

    The table goes to the shared checkpoint folder, so a lost executor costs a
    re-read and not a recomputation, branches can not see different rows, and
    each branch reads only the columns it needs.  A caller that has used up
    the table hands it to ``discard``; a lazy result may still read it, so the
    rest is deleted by ``remove_scratch``, once results have been written.
    ``codec`` replaces the session's compression, for tables of whole texts.
    """
    folder = scratch_folder(df.sparkSession, "step")
    (df.write.option("compression", codec) if codec else df.write).parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._written_to = folder
    Scratch.own(folder)
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``written_once`` that nothing will read again."""
    remove_folder(table.sparkSession, table._written_to)


def remove_scratch(spark: SparkSession) -> None:
    """Delete all that this application keeps in the checkpoint location."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        remove_folder(spark, folder)
