"""Delimited files as tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_delimited(
    spark: SparkSession, path: str, names: list[str] | None = None, sep: str = "|", header: bool = False
) -> DataFrame:
    """Read every column as text.

    A field that is present but empty is '', a field that a short line lacks
    is null, and ``_malformed`` holds a line with the wrong number of fields.
    Without ``names`` the header, or else the first line, sets the columns.
    """
    options = {"sep": sep, "header": str(header).lower(), "mode": "PERMISSIVE", "quote": '"', "escape": '"'}
    if names is None:
        first = spark.read.options(**options).csv(path)
        names = first.columns if header else [f"col_{i + 1}" for i in range(len(first.columns))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_malformed"]])
    rows = spark.read.options(**options, columnNameOfCorruptRecord="_malformed").schema(schema).csv(path)
    filled = [F.when(F.col("_malformed").isNull(), F.coalesce(n, F.lit(""))).otherwise(F.col(n)).alias(n) for n in names]
    return rows.select(*filled, "_malformed")


def write_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = True) -> None:
    """Write text with nulls as empty fields."""
    df.write.mode("overwrite").csv(path, sep=sep, header=header, nullValue="", emptyValue="")
