"""Run a registered query and its SQL twin and compare whole results."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "float": "FLOAT",
}


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sql_result(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    return names, types, cur.fetchall()


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL text; empty when equal."""
    names, types, rows = sql_result(con, sql)
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    for name, kind in df.dtypes:
        if TYPE_NAMES.get(kind, kind.upper()) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    got = Counter(tuple(r[n] for n in order) for r in df.collect())
    at = [names.index(n) for n in order]
    want = Counter(tuple(r[i] for i in at) for r in rows)
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        problems.append(f"rows {sum(got.values())} vs {sum(want.values())}; columns {order}; only spark {extra}; only sql {missing}")
    return problems
