"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer when the smallest hash among its
inner s-mers stands at its first or last place.  Whether a k-mer is chosen
depends on itself alone, so the same passage has the same anchors in every
text.  The fingerprint deals the anchors' hashes over bins and keeps the least
of each bin; the share of bins that agree estimates the shared anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import append, in_pieces
from tablewright.session import written_once

K, S, BIN_BITS = 12, 5, 6
EMPTY = "----"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STARTS = (np.arange(1 << BIN_BITS, dtype=np.uint64)) << np.uint64(64 - BIN_BITS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` codes, from hashes of runs of powers of two."""
    out, done, have, length, base = None, 0, codes, 1, _BASE
    n = len(codes) - size + 1
    while length <= size:
        if size & length:
            part = have[done : done + n]
            out = part if out is None else out * base + part
            done += length
        if 2 * length > size:
            break
        have = have[:-length] * base + have[length:]
        length, base = 2 * length, np.uint64(int(base) ** 2 * 3 % (1 << 64))
    return out


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers; a text shorter than k is one anchor."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(codes) < k:
        return np.zeros(1, np.int64), _mixed(_windows(codes, len(codes)))
    inner = _mixed(_windows(codes, s))
    span = k - s + 1
    least, have = inner, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    n = len(codes) - k + 1
    at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    return at, _mixed(_windows(codes, k)[at])


def fingerprint_of(text: str | None) -> str:
    """Hexadecimal fingerprint: four digits per bin, ``----`` where a bin is empty."""
    hashes = np.sort(anchors(text or "")[1])
    if not len(hashes):
        return EMPTY * len(_STARTS)
    first = np.searchsorted(hashes, _STARTS)
    held = first < np.append(first[1:], len(hashes))
    return "".join(f"{int(hashes[i]) & 0xFFFF:04x}" if h else EMPTY for i, h in zip(first, held))


def likeness_of(a: str, b: str) -> float:
    """Share of bins, among those that either text fills, with the same anchor."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    filled = [p for p in pairs if p != (EMPTY, EMPTY)]
    return sum(x == y for x, y in filled) / len(filled)


def add_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text; null counts as empty.

    Equal texts have equal fingerprints.  Rows are independent; an input
    column called ``name`` gives way.
    """

    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(map(fingerprint_of, texts.to_pylist()), pa.string())

    return append(df, **{name: made(F.col(text).cast("string"))})


def _compared(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    quarter = len(text) // 4
    edited = text[: len(text) - quarter] + following[:quarter]
    edited_mark = mark if edited == text else fingerprint_of(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark, likeness_of(mark, edited_mark), likeness_of(mark, next_mark))


FIELDS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare_with_edit(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    The edited text has its last quarter replaced by the start of the next
    document, in the order of the key (null keys first, equal keys by a hash
    of the text), the first document following the last.  Null texts count as
    empty.  Rows are range-partitioned by key and compared with their
    neighbour as they stream by; only the first and last document of each
    partition are joined afterwards.
    """
    ids = df.schema[key].dataType
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    order: list[Column | str] = [F.col("doc_id").asc_nulls_first(), F.xxhash64("t"), "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    kind = ids.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edge int, part int, t string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, arrow = TaskContext.get().partitionId(), None, None

        def batch(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=["doc_id", *FIELDS, "edge", "part", "t"])

        for b in batches:
            arrow = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            out = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark = fingerprint_of(t)
                if before is None:
                    out.append((doc_id, *[None] * 6, 1, part, t))
                else:
                    out.append((*_compared(*before, t, mark), 0, part, None))
                before = (doc_id, t, mark)
            if out:
                yield batch(out)
        if before is not None:
            yield batch([(before[0], *[None] * 6, 2, part, before[1])])

    found = written_once(ranged.mapInArrow(in_pieces(run, 1000), schema))
    inner = found.where("edge = 0").select("doc_id", *FIELDS)
    # Two rows per partition: numbers of partitions only pass through the window.
    parts = found.where("edge = 1").select("part")
    following = parts.select("part", F.lead("part").over(W.orderBy("part")).alias("_next"), F.first("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_first"))
    following = following.select("part", F.coalesce("_next", "_first").alias("_next"))
    heads = found.where("edge = 1").select(F.col("part").alias("_next"), F.col("t").alias("_t"))
    tails = found.where("edge = 2").select("doc_id", "part", "t").join(following, "part").join(heads, "_next").drop("part", "_next")
    result = "doc_id {0}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double".format(kind)

    def edges(batches):
        for b in batches:
            if b.num_rows:
                rows = [_compared(i, t, fingerprint_of(t), n, fingerprint_of(n)) for i, t, n in zip(*[c.to_pylist() for c in b.columns])]
                types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", *FIELDS])

    return inner.unionByName(tails.mapInArrow(edges, result))
