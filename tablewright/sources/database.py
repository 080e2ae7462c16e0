"""Database tables and queries through Spark's JDBC source."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def project_table(df: DataFrame, columns=None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Columns, filter and row cap; a JDBC source gets all three pushed down."""
    out = df.filter(where) if where else df
    out = out.select(*columns) if columns else out
    return out.limit(limit) if limit else out


def _sql_value(value) -> str:
    """A number or a date as an SQL literal."""
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return str(value)


def range_splits(column: str, lo, hi, partitions: int) -> list[str]:
    """Predicates of equal ranges of a whole number, or of whole days; each row in exactly one.

    The outer ranges are open, so rows that arrive after the bounds were read
    are not lost; nulls belong to the first.  Fewer values than partitions
    give fewer predicates; without bounds (no rows) there is one.
    """
    if partitions < 1:
        raise ValueError("at least one partition is needed")
    if lo is None or hi is None:
        return ["1 = 1"]
    lo, hi = (v.date() if isinstance(v, datetime) else v for v in (lo, hi))
    width = (hi - lo).days if isinstance(lo, date) else int(hi) - int(lo)
    steps = sorted({width * i // partitions for i in range(1, partitions)} - {0})
    cuts = [_sql_value(lo + timedelta(days=n) if isinstance(lo, date) else int(lo) + n) for n in steps]
    return cut_splits(column, cuts)


def cut_splits(column: str, cuts: list[str]) -> list[str]:
    """Predicates between ascending SQL literals, for keys that equal ranges would split unevenly."""
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def remainder_splits(column: str, partitions: int) -> list[str]:
    """Predicates by the remainder of a whole number; even where ranges of the key are not, and no bounds are read.

    The absolute value covers databases in which a negative number has a
    negative remainder as well as those in which it has none.
    """
    if partitions < 1:
        raise ValueError("at least one partition is needed")
    if partitions == 1:
        return ["1 = 1"]
    hit = f"ABS(MOD({column}, {partitions}))"
    return [f"{hit} = 0 OR {column} IS NULL", *[f"{hit} = {i}" for i in range(1, partitions)]]


def split_balance(df: DataFrame, splits: list[str]) -> DataFrame:
    """Rows per predicate, and how many of them another predicate claims too; one scan.

    A split without rows is listed with 0.  ``split`` is -1 for rows that no
    predicate claims.
    """
    hits = F.array(*[F.coalesce(F.expr(p), F.lit(False)) for p in splits])
    claimed = F.size(F.filter(hits, lambda h: h))
    first = F.coalesce(F.array_position(hits, True), F.lit(0)).cast("int") - 1
    found = df.select(first.alias("split"), (claimed > 1).alias("_twice")).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_twice")).alias("claimed_twice"))
    every = df.sparkSession.range(len(splits)).select(F.col("id").cast("int").alias("split"), F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("claimed_twice"))
    return found.unionByName(every).groupBy("split").agg(F.sum("rows").alias("rows"), F.sum("claimed_twice").alias("claimed_twice"))


def key_bounds(df: DataFrame, column: str) -> tuple:
    """Smallest and largest key; (None, None) without rows."""
    return tuple(df.agg(F.min(column), F.max(column)).first())


def scan_table(
    spark: SparkSession,
    url: str,
    table: str,
    columns=None,
    where: str | None = None,
    limit: int | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    properties: dict | None = None,
    split: str = "range",
) -> DataFrame:
    """Read a table; with a partition column, over ``partitions`` connections."""
    df = _scan(spark, url, table, partition_column, bounds, partitions, fetch_size, properties, split)
    return project_table(df, columns, where, limit)


def scan_query(
    spark: SparkSession,
    url: str,
    sql: str,
    properties: dict | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    split: str = "remainder",
) -> DataFrame:
    """Rows of any SELECT the database accepts.

    With a partition column of its result, each of ``partitions`` connections
    reads the rows of one predicate.
    """
    return _scan(spark, url, f"({sql}) rows_of_query", partition_column, bounds, partitions, fetch_size, properties, split)


def _scan(spark, url, relation, column, bounds, partitions, fetch_size, properties, split) -> DataFrame:
    options = {"fetchsize": str(fetch_size), **(properties or {})}
    if not column:
        return spark.read.format("jdbc").options(url=url, dbtable=relation, **options).load()
    if split == "remainder":
        splits = remainder_splits(column, partitions)
    elif split == "range":
        if bounds is None:
            ends = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {relation}"
            bounds = tuple(spark.read.format("jdbc").options(url=url, query=ends, **(properties or {})).load().first())
        splits = range_splits(column, *bounds, partitions)
    else:
        raise ValueError(f"unknown split {split!r}")
    return spark.read.jdbc(url, relation, predicates=splits, properties=options)


def query_views(spark: SparkSession, sql: str, tables: dict[str, DataFrame], params: dict | None = None) -> DataFrame:
    """A SELECT over DataFrames, ``{name}`` for tables and ``:name`` for values."""
    return spark.sql(sql, args=params or {}, **tables)


def first_rows(df: DataFrame, n: int, order_by: list) -> DataFrame:
    """The first ``n`` rows of an order; only ``n`` rows per task are kept."""
    return df.orderBy(*order_by).limit(n)


def table_stats(df: DataFrame) -> DataFrame:
    """Row count, column count and column names."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), F.lit(",".join(df.columns)).alias("column_names")
    )
