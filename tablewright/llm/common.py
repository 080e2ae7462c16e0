"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
# The C library's own call where it has one; elsewhere memory is left as it is.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only, as bytes do."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text falls on the held-out remainder; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def append(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; a column of the input with the same name (in any case) gives way."""
    names = {n.lower() for n in columns}
    kept = [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(name for n in range(len(taken) + 1) if (name := "_" * n + w).lower() not in taken) for w in wanted]


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as a struct ``row``, and columns made from it: no name of the input can clash any more."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns ``names`` of packed rows, as they were."""
    return [F.col("row").getField(n).alias(n) for n in names]


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, and the next one needs the room."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def by_slices(make: Callable[[list], pa.Array], rows: int = 400) -> Callable[[pa.Array], pa.Array]:
    """Apply ``make`` to slices of a column, so that Python objects exist for a few rows at a time only."""

    def run(column: pa.Array) -> pa.Array:
        if not len(column):
            return make([])
        made = pa.concat_arrays([make(column.slice(at, rows).to_pylist()) for at in range(0, len(column), rows)])
        release_memory()
        return made

    return run


def in_pieces(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int):
    """Feed ``run`` with batches of at most ``rows`` rows, to bound what a batch holds."""

    def split(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def whole(batches):
        yield from run(split(batches))
        release_memory()

    return whole
