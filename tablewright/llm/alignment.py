"""Token alignment of two tokenizers by products of byte incidence matrices.

Each tokenizer cuts the bytes of a text into tokens: a token-byte incidence
matrix, kept in compressed rows (CSR).  The row product A . B^T (Gustavson:
for every byte of a token of A, add the row of B^T at that byte) has an entry
for each pair of tokens that overlap, and its value is the number of shared
bytes.  Where tokens of both end at one byte a group ends; the product of the
group incidences links all tokens of a group, and as both sides of a group are
consecutive it is kept as one dense block per group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bpe import PRETOKEN, byte_characters, read_spec
from tablewright.llm.common import append, by_slices, release_memory
from tablewright.session import written_once

# Bytes of text whose matrices are built together, and nonzeros of one block of rows.
SLICE_BYTES = 1 << 20
BLOCK_NONZEROS = 1 << 20
# Links (distinct ones of each text) that share a dictionary, its rows in the table, and texts of one batch.
BLOCK_LINKS = 1 << 22
DICTIONARY_ROWS = 1 << 16
BATCH_ROWS = 1000


@dataclass
class Csr:
    """A sparse matrix: row i has entries in columns ``indices[indptr[i]:indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    n_columns: int

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(len(self.indptr) - 1, dtype=np.int32), np.diff(self.indptr))
        sizes = np.bincount(self.indices, minlength=self.n_columns)
        return Csr(starts_of(sizes), rows[order], len(self.indptr) - 1)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def token_bytes(sizes: np.ndarray) -> Csr:
    """Incidence of consecutive tokens and the bytes they cover."""
    starts = starts_of(sizes)
    return Csr(starts, np.arange(starts[-1], dtype=np.int32), int(starts[-1]))


def row_product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the entries of a . b, by rows of ``a`` in blocks.

    Each nonzero (i, k) of ``a`` contributes row k of ``b`` to row i of the
    product; equal positions of a row are then added up.
    """
    parts, n_rows, low = [], len(a.indptr) - 1, 0
    while low < n_rows:
        high = max(low + 1, int(np.searchsorted(a.indptr, a.indptr[low] + BLOCK_NONZEROS, "right")) - 1)
        inner = a.indices[a.indptr[low] : a.indptr[high]]
        lengths = np.diff(a.indptr[low : high + 1])
        first, sizes = b.indptr[inner], b.indptr[inner + 1] - b.indptr[inner]
        rows = np.repeat(np.repeat(np.arange(low, high), lengths), sizes)
        place = np.arange(len(rows)) - np.repeat(starts_of(sizes)[:-1] - first, sizes)
        spots = rows * b.n_columns + b.indices[place]
        if len(spots) and (spots[1:] < spots[:-1]).any():
            spots.sort()
        new = np.flatnonzero(np.concatenate([[True], spots[1:] != spots[:-1]])) if len(spots) else np.zeros(0, np.int64)
        parts.append((spots[new] // b.n_columns, spots[new] % b.n_columns, np.diff(np.append(new, len(spots)))))
        low = high
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class Links:
    """Tokens, links and groups of some texts, one after another.

    ``a_at``, ``b_at``, ``link_at`` and ``group_at`` hold where each text
    starts (and the last one ends) among the tokens, links and groups.  Group
    g spans tokens ``group_a[g]:group_a[g + 1]`` and ``group_b[g]:group_b[g + 1]``.
    """

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    shared: np.ndarray
    link_at: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    group_at: np.ndarray


class Aligner:
    """Two vocabularies: byte-level BPE (the tokenizers library's file) and pieces with byte fallback."""

    def __init__(self, spec: str, model: bytes):
        loaded, to_byte = json.loads(spec), byte_characters()
        special = {t["content"] for t in loaded["added_tokens"]}
        # The ids of this kind of vocabulary are its merge order.
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in loaded["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (1 + max(loaded["model"]["vocab"].values()))
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(raw) for raw in self.a_bytes])
        self.b_sizes = np.array([len(raw) for raw in self.b_bytes])
        self.a_texts, self.b_texts = [
            {end: np.array([f"{i}{end}" for i in range(len(known))], object) for end in ends}
            for known, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
        ]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both, none where a tokenizer does not give back the bytes of space and text."""
        if not text:
            return [], []
        spaced = " " + text
        raw = spaced.encode()
        a = self.a.encode_ordinary(spaced)
        b = self.b.encode(text)
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else ([], [])

    def links(self, texts: list[str | None]) -> Links:
        both = [self.tokens(t) for t in texts]
        a_at, b_at = [starts_of(np.array([len(x[side]) for x in both], np.int64)) for side in (0, 1)]
        a_ids, b_ids = [np.fromiter((i for x in both for i in x[side]), np.int32, at[-1]) for side, at in ((0, a_at), (1, b_at))]
        a, b = token_bytes(self.a_sizes[a_ids]), token_bytes(self.b_sizes[b_ids])
        link_a, link_b, shared = row_product(a, b.transposed())
        ends = np.intersect1d(a.indptr[1:], b.indptr[1:], assume_unique=True)
        group_a, group_b = [np.append(0, np.searchsorted(m.indptr[1:], ends, "right")) for m in (a, b)]
        return Links(
            a_ids, b_ids, a_at, b_at, link_a, link_b, shared, np.searchsorted(link_a, a_at),
            group_a, group_b, np.searchsorted(ends, a.indptr[a_at], "right"),
        )

    def group_digests(self, found: Links) -> list[str]:
        """Per text the digest of ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
        last_a, last_b = np.zeros(len(found.a_ids), bool), np.zeros(len(found.b_ids), bool)
        last_a[found.group_a[1:] - 1], last_b[found.group_b[1:] - 1] = True, True
        # Tokens of A come before those of B of the same group.
        n_a, n_b = np.diff(found.group_a), np.diff(found.group_b)
        spots_a = np.arange(len(found.a_ids)) + np.repeat(found.group_b[:-1], n_a)
        spots_b = np.arange(len(found.b_ids)) + np.repeat(found.group_a[1:], n_b)
        written = np.empty(len(found.a_ids) + len(found.b_ids), object)
        for ids, last, spots, names, end in ((found.a_ids, last_a, spots_a, self.a_texts, "|"), (found.b_ids, last_b, spots_b, self.b_texts, ";")):
            written[spots[~last]] = names[","][ids[~last]]
            written[spots[last]] = names[end][ids[last]]
        at = (found.a_at + found.b_at).tolist()
        return [
            hashlib.sha256("".join(written[low:high].tolist())[:-1].encode()).hexdigest() if high > low else ""
            for low, high in zip(at, at[1:], strict=False)
        ]

    def slices(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about ``SLICE_BYTES``; a longer text is alone."""
        low = held = 0
        for n, text in enumerate(texts):
            size = len(text or "")
            if n > low and held + size > SLICE_BYTES:
                yield low, n
                low, held = n, 0
            held += size
        if low < len(texts):
            yield low, len(texts)


@lru_cache(maxsize=1)
def aligner(spec: str, model: bytes) -> Aligner:
    return Aligner(spec, model)


def _vocabularies(df: DataFrame, path_a: str, path_b: str):
    """Both files, read on the driver; their size (a few MB) bounds what is sent to the tasks."""
    with open(path_b, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((read_spec(path_a), f.read()))


def token_links(df: DataFrame, path_a: str, path_b: str, text: str = "text", name: str = "alignment") -> DataFrame:
    """Add a struct with the tokens, links and groups of every whole text.

    ``a_ids`` and ``b_ids`` are the ids; ``links`` pairs positions of
    overlapping tokens with the number of bytes they share; ``groups`` holds
    for each group the ranges of positions on both sides, all of which are
    linked with each other.  Texts that are null, empty or not given back by
    one of the tokenizers have empty arrays.  Rows are independent; an input
    column called ``name`` gives way.
    """
    files = _vocabularies(df, path_a, path_b)
    kind = "struct<a_ids:array<int>,b_ids:array<int>,links:array<struct<a:int,b:int,bytes:int>>,groups:array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>>"

    @F.arrow_udf(kind)
    def linked(texts: pa.Array) -> pa.Array:
        known = aligner(*files.value)

        def some(part: list) -> pa.Array:
            made = [made_of(part[low:high]) for low, high in known.slices(part)]
            return pa.concat_arrays(made or [made_of([])])

        def made_of(part: list) -> pa.Array:
            found = known.links(part)
            link_doc = np.repeat(np.arange(len(part)), np.diff(found.link_at))
            group_doc = np.repeat(np.arange(len(part)), np.diff(found.group_at))
            links = [found.link_a - found.a_at[link_doc], found.link_b - found.b_at[link_doc], found.shared]
            ga, gb = found.a_at[group_doc], found.b_at[group_doc]
            groups = [found.group_a[:-1] - ga, found.group_a[1:] - ga, found.group_b[:-1] - gb, found.group_b[1:] - gb]

            def listed(at, values):
                return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

            def structs(columns, names):
                return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names)

            return pa.StructArray.from_arrays(
                [
                    listed(found.a_at, pa.array(found.a_ids, pa.int32())),
                    listed(found.b_at, pa.array(found.b_ids, pa.int32())),
                    listed(found.link_at, structs(links, ["a", "b", "bytes"])),
                    listed(found.group_at, structs(groups, ["a_from", "a_to", "b_from", "b_to"])),
                ],
                ["a_ids", "b_ids", "links", "groups"],
            )

        return by_slices(some)(texts)

    return append(df, **{name: linked(F.col(text).cast("string"))})


RESULTS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_group_links long"


def link_counts(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How each text's links fare in the whole table: the key, then ``RESULTS``.

    ``count`` of an id pair is the number of its links in all texts.
    ``count_sum`` adds the counts of a text's links, and ``n_best`` numbers
    those whose count is the highest of their B id (ties included).
    ``n_group_links`` is the number of token pairs that share a group.

    Texts are aligned once.  Blocks of texts keep a dictionary of their pairs,
    so what is shuffled by pair is one row for each block and pair, however
    often a pair occurs, and every block gets the counts of its dictionary
    back.  What is broadcast is bounded by the vocabulary: the highest count
    of each B id.  Texts without tokens (null, empty, not given back) have
    zeros and an empty digest; repeated rows count and come out as often as
    they occur; an empty table gives an empty one.  Only ``key`` and ``text``
    are read, so other columns can have any names.
    """
    files = _vocabularies(df, path_a, path_b)
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    stored = f"key {kind}, block long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, at array<int>, times array<int>, start int, pair array<long>, n array<long>"
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(*files.value)
        width = len(known.b_bytes)
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            times = np.concatenate([h[2] for h in held])
            totals = np.bincount(at, times, len(pairs)).astype(np.int64)
            low = 0
            for keys, _, _, ends, counts, digests in held:
                high = low + int(ends[-1])
                yield _batch(
                    len(keys), key=keys, block=pa.array(np.full(len(keys), block)), groups_sha256=pa.array(digests, pa.string()),
                    at=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[low:high], pa.int32())),
                    times=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times[low:high], pa.int32())),
                    **{n: pa.array(c, pa.int64()) for n, c in zip(numbers, counts, strict=True)},
                )
                low = high
            for start in range(0, len(pairs), DICTIONARY_ROWS):
                part = slice(start, start + DICTIONARY_ROWS)
                yield _batch(
                    1, block=pa.array([block]), start=pa.array([start], pa.int32()),
                    pair=pa.array([pairs[part]], pa.list_(pa.int64())), n=pa.array([totals[part]], pa.list_(pa.int64())),
                )
            release_memory()

        def _batch(length: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(length, f.type)) for f in shape], schema=shape)

        shape = None
        for batch in batches:
            if shape is None:
                shape = _arrow_schema(batch.schema.field("key").type)
            for top in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(top, BATCH_ROWS)
                texts = part.column("text").to_pylist()
                for low, high in known.slices(texts):
                    found = known.links(texts[low:high])
                    docs = high - low
                    spots = np.repeat(np.arange(docs), np.diff(found.link_at)) * (len(known.a_bytes) * width)
                    spots += found.a_ids[found.link_a].astype(np.int64) * width + found.b_ids[found.link_b]
                    spots, times = np.unique(spots, return_counts=True)
                    doc, pairs = np.divmod(spots, len(known.a_bytes) * width)
                    blocks = np.diff(found.group_a) * np.diff(found.group_b)
                    counts = [
                        np.diff(found.a_at), np.diff(found.b_at), np.diff(found.group_at), np.diff(found.link_at),
                        np.diff(starts_of(blocks)[found.group_at]),
                    ]
                    held.append((part.column("key").slice(low, docs), pairs, times, np.searchsorted(doc, np.arange(docs + 1)), counts, known.group_digests(found)))
                    size += len(pairs)
                    if size >= BLOCK_LINKS:
                        yield from flush()
                        block, held, size = block + 1, [], 0
        if held:
            yield from flush()

    def _arrow_schema(key_type: pa.DataType) -> pa.Schema:
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        return pa.schema([
            ("key", key_type), ("block", pa.int64()), *[(n, pa.int64()) for n in numbers], ("groups_sha256", pa.string()),
            ("at", ints), ("times", ints), ("start", pa.int32()), ("pair", longs), ("n", longs),
        ])

    table = written_once(rows.mapInArrow(aligned, stored))
    entries = table.where("pair IS NOT NULL").select("block", "start", F.posexplode(F.arrays_zip("pair", "n")).alias("place", "_e"))
    entries = entries.select("block", (F.col("start") + F.col("place")).alias("place"), F.col("_e.pair").alias("pair"), F.col("_e.n").alias("n"))
    counts = entries.groupBy("pair").agg(F.sum("n").alias("count"))
    width = len(aligner(*files.value).b_bytes)
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most"))
    marked = counts.join(F.broadcast(highest), F.col("pair") % width == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    replies = entries.select("block", "place", "pair").join(marked, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    texts = table.where("pair IS NULL").select("key", "block", *numbers, "groups_sha256", "at", "times")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for chunk_at, chunk_times in zip(left.column("at").chunks, left.column("times").chunks, strict=True):
            at, times = chunk_at.flatten().to_numpy(), chunk_times.flatten().to_numpy()
            ends = starts_of(chunk_at.value_lengths().to_numpy())
            for source, into in ((count, sums), (best, bests)):
                into.append(np.diff(starts_of(source[at] * times)[ends]))
        extra = {"n_best": np.concatenate(bests or [np.zeros(0, np.int64)]), "count_sum": np.concatenate(sums or [np.zeros(0, np.int64)])}
        columns = {"key": left.column("key"), **{n: left.column(n) for n in (*numbers, "groups_sha256")}, **{n: pa.array(v, pa.int64()) for n, v in extra.items()}}
        release_memory()
        return pa.table({n: columns[n] for n in order})

    order = ["key", *[c.split()[0] for c in RESULTS.split(", ")]]
    done = texts.groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(summed, f"key {kind}, {RESULTS}")
    return done.withColumnRenamed("key", key)
