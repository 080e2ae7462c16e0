"""Repeated passages by induced suffix sorting over shards of candidate text.

Two equal windows of ``size`` bytes share their smallest hashed k-gram, so
that value is a shard key: consecutive windows with the same value form a run,
and only runs whose value occurs at more than one place can hold a repeat.
These runs are cut out, equal cuts are counted once, and each shard of cuts is
suffix-sorted by induction:

* the sample suffixes (smaller than the suffix after them, larger than the one
  before) are ranked by words of four symbols, recursively inside tied groups;
* all others are induced: whoever leaves the queue of its first byte puts the
  suffix one byte longer into the queue of its own first byte, together with
  the common prefix with what went there before.  A queue per byte, first in
  first out, is a priority queue for (byte, rank); queues beyond a memory
  limit go to disk.

Adjacent suffixes with a common prefix of ``size`` are repeats.  A key whose
distinct cuts exceed a share of a shard (a passage with many different
surroundings) is dealt further before it is sorted: its windows hold the key's
gram at a known place, and each reaches far enough either to the left of it or
to the right to hold half of the bytes that are still open.  These bytes make
narrower keys, equal pieces are counted once again, and so on until the keys
fit: at the latest when a key is a window.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import by_slices, in_pieces, packed, release_memory, unpacked
from tablewright.operators.groups import rows_of_groups
from tablewright.session import discard, written_once

GRAM = 32
SHARD_BYTES = 2 << 20
HEAVY_BYTES = 1 << 20
SLICE = 1 << 20
RUN = 1024
QUEUE_BYTES = 64 << 20
CODEC = "zstd"  # texts and cuts take a third less room than by Spark's default, in the same time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _grams(codes: np.ndarray, power: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of every run of ``2 ** power`` codes."""
    have, length = codes, 1
    for _ in range(power):
        have = have[:-length] * base + have[length:]
        base = np.uint64(int(base) ** 2 * 3 % (1 << 64))
        length *= 2
    have = (have ^ (have >> np.uint64(33))) * _MIX
    return have ^ (have >> np.uint64(29))


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    have = 1
    while 2 * have <= span:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (span - have)], values[span - have :]) if have < span else values


def _runs_in(raw: bytes, size: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grams = _grams(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), GRAM.bit_length() - 1)
    span = size - GRAM + 1
    least = _sliding_min(grams, span)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    # A repetitive text is one long run: its pieces are equal, or few are different.
    pieces = -(-np.diff(np.append(first, len(least))) // RUN)
    if len(pieces) < pieces.sum():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + RUN * nth
    last = np.append(first[1:], len(least)) - 1
    values = least[first]
    twice = np.fromiter((np.count_nonzero(grams[a : b + span] == v) > 1 for a, b, v in zip(first, last, values)), np.int64, len(first))
    return values.view(np.int64), first + offset, last + offset, twice


def runs_of(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one smallest gram: value, first, last, whether the gram occurs twice in the run.

    Runs have at most ``RUN`` windows; a long text is read in overlapping slices.
    """
    if len(raw) < size:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    starts = range(0, len(raw) - size + 1, SLICE)
    found = [_runs_in(raw[at : at + SLICE + size - 1], size, at) for at in starts]
    return tuple(np.concatenate(c) for c in zip(*found))


def _halves(part: tuple[int, int, int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Windows p to q, all of which hold the bytes [a, b): those that reach half of what is open to the left, and the rest."""
    p, q, a, b = part
    left = (size - (b - a) + 1) // 2
    far = a - left
    halves = [(p, min(q, far), far, b), (max(p, far + 1), q, a, a + size - left + 1)]
    return [h for h in halves if h[0] <= h[1]] if left else [part]


def narrower(cut: bytes, m: int, a: int, b: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a cut whose windows hold the bytes [a, b), or the gram hashed to m if that range is empty.

    (key, p, q, a, b) each: windows p to q hold the bytes [a, b), from which the
    key is made.  Windows with equal bytes have equal keys, wherever they are.
    """
    last = len(cut) - size
    if a < b:
        parts = [(0, last, a, b)]
    else:
        grams = _grams(np.frombuffer(cut, np.uint8).astype(np.uint64) + np.uint64(1), GRAM.bit_length() - 1)
        at = np.flatnonzero(grams.view(np.int64) == m).tolist()
        # A window's first occurrence counts.
        parts = [(max(before + 1, 0), min(g, last), g, g + GRAM) for before, g in zip([-1, *at], at) if before < last]
    parts = [h for part in parts for half in _halves(part, size) for h in _halves(half, size)]
    seed = m % (1 << 64)
    return [(xxhash.xxh64_intdigest(cut[a:b], seed) - (1 << 63), p, q, a, b) for p, q, a, b in parts]


class Queue:
    """First-in first-out store of (position, common prefix) pairs of 32 bits; beyond a limit it lives on disk."""

    def __init__(self, limit: int):
        self.limit, self.held, self.chunks, self.file, self.on_disk = limit, 0, [], None, 0

    def push(self, pairs: np.ndarray) -> None:
        pairs = pairs.astype(np.int32)
        self.chunks.append(pairs)
        self.held += pairs.nbytes
        if self.held > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # a spill of this task only; gone when closed
            for c in self.chunks:
                self.file.write(np.ascontiguousarray(c).tobytes())
                self.on_disk += len(c)
            self.chunks, self.held = [], 0

    def pull(self) -> np.ndarray | None:
        """All pairs that are waiting, in order."""
        if not self.on_disk and not self.chunks:
            return None
        chunks = self.chunks
        if self.on_disk:
            self.file.seek(0)
            chunks = [np.frombuffer(self.file.read(), np.int32).reshape(-1, 2), *chunks]
            self.file.close()
            self.file, self.on_disk = None, 0
        self.chunks, self.held = [], 0
        return np.concatenate(chunks)


def _words(symbols: np.ndarray) -> np.ndarray:
    padded = np.concatenate([symbols, np.zeros(4, symbols.dtype)]).astype(np.uint64)
    n, s = len(symbols), np.uint64(16)
    return ((padded[:n] << s | padded[1 : n + 1]) << s | padded[2 : n + 2]) << s | padded[3 : n + 3]


def _equal_symbols(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading symbols that words share, of four."""
    differ = a ^ b
    return np.where(differ == 0, 4, np.where(differ < 1 << 16, 3, np.where(differ < 1 << 32, 2, np.where(differ < 1 << 48, 1, 0))))


def _words_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = words[np.minimum(at, len(words) - 1)]
    found[at >= len(words)] = 0
    return found


def _common(words: np.ndarray, a: int, b: int, size: int) -> int:
    """Common prefix of suffixes a and b, at most ``size``."""
    steps = np.arange(0, size, 4)
    equal = _equal_symbols(_words_at(words, a + steps), _words_at(words, b + steps))
    short = np.flatnonzero(equal < 4)
    return min(size, int(4 * short[0] + equal[short[0]])) if len(short) else size


def _rank_sample(words: np.ndarray, sample: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample suffixes in order of their first ``size`` symbols, and each one's common prefix with the one before.

    Sorted by words, recursively within tied groups; only groups whose next words differ are sorted again.
    """
    order = sample[np.argsort(words[sample], kind="stable")]
    common = np.full(len(order), size)
    w, depth, at = words[order], 0, np.arange(len(order))
    head = np.zeros(len(order), bool)
    head[:1], common[:1] = True, 0
    while len(at):
        if depth:
            w = _words_at(words, order[at] + depth)
        differs = np.append(False, (w[1:] != w[:-1]) & ~head[1:])
        if differs.any():
            if depth:
                group = np.cumsum(head) - 1
                mixed = np.zeros(group[-1] + 1, bool)
                mixed[group[differs]] = True
                sub = np.flatnonzero(mixed[group])
                by = sub[np.lexsort((w[sub], group[sub]))]
                order[at[sub]], w[sub] = order[at[by]], w[by]
                differs = np.append(False, (w[1:] != w[:-1]) & ~head[1:])
            new = np.flatnonzero(differs)
            common[at[new]] = depth + _equal_symbols(w[new], w[new - 1])
            head[new] = True
        if not depth or differs.any():
            tied = ~(head & np.append(head[1:], True))
            at, head = at[tied], head[tied]
        depth += 4
        if depth >= size:
            break
    return order, np.minimum(common, size)


def _deal(queues: list[Queue], since: np.ndarray, symbols: np.ndarray, batch: np.ndarray, keep, size: int) -> None:
    """Queue the predecessors of a scanned batch, each with its common prefix with the one queued before it."""
    position, common = batch[:, 0], batch[:, 1]
    before = position - 1
    at = np.flatnonzero(before >= 0)
    char = symbols[before[at]]
    ok = keep(char, before[at])
    at, char = at[ok], char[ok]
    if len(at):
        by = np.argsort(char, kind="stable")
        at, char = at[by], char[by]
        starts = np.flatnonzero(np.append(True, char[1:] != char[:-1]))
        # min of common over (previous of the same byte, this]; the first of a byte also covers earlier batches.
        lo = np.append(-1, at[:-1])
        lo[starts] = -1
        bounds = np.stack([lo + 1, at + 1], axis=1).ravel()
        padded = np.append(common, size)
        least = np.minimum.reduceat(padded, bounds)[::2]
        least[starts] = np.minimum(least[starts], since[char[starts]])
        pairs = np.stack([before[at], np.minimum(least + 1, size)], axis=1)
        ends = np.append(starts[1:], len(at))
        since[:] = np.minimum(since, common.min())
        for a, b in zip(starts, ends):
            c = int(char[a])
            queues[c].push(pairs[a:b])
            tail = common[at[b - 1] + 1 :]
            since[c] = tail.min() if len(tail) else size
    else:
        since[:] = np.minimum(since, common.min())


def sorted_suffixes(symbols: np.ndarray, size: int, limit: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``size`` symbols, and each one's common prefix with the one before.

    ``symbols`` are small integers; 0 ends each piece and the whole.
    """
    n, top = len(symbols), int(symbols.max()) + 1 if len(symbols) else 0
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = _words(symbols)
    wide = symbols.astype(np.int64)
    # The type of a suffix is decided at the next place where the symbol changes; the last suffix is large.
    change = np.flatnonzero(wide[1:] != wide[:-1])
    upto = np.append(change, n - 1)
    nearest = np.repeat(upto, np.diff(upto, prepend=-1))
    small = np.zeros(n, bool)
    inside = nearest < n - 1
    small[inside] = wide[nearest[inside]] < wide[nearest[inside] + 1]
    del wide, change, upto, nearest, inside
    sample = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sample, sample_common = [ranked.astype(np.int32) for ranked in _rank_sample(words, sample, size)]
    heads = symbols[sample]
    per_queue = max(1 << 16, limit // (top + 1))

    # Ascending: large suffixes from the sample and from each other.
    queues, since = [Queue(per_queue) for _ in range(top)], np.full(top, 0, np.int64)
    queues[int(symbols[-1])].push(np.array([[n - 1, 0]]))
    large: list[np.ndarray] = []
    last = -1  # the suffix scanned before
    for c in range(top):
        own, found = [], queues[c].pull()
        first = True
        while found is not None:
            if first:
                found[0, 1] = _common(words, last, int(found[0, 0]), size) if last >= 0 else 0
                first = False
            own.append(found)
            last = int(found[-1, 0])
            _deal(queues, since, symbols, found, lambda char, at: ~small[at], size)
            found = queues[c].pull()
        large.append(np.concatenate(own) if own else np.zeros((0, 2), np.int32))
        a, b = np.searchsorted(heads, [c, c + 1])
        if b > a:
            pairs = np.stack([sample[a:b], sample_common[a:b]], axis=1)
            pairs[0, 1] = _common(words, last, int(pairs[0, 0]), size) if last >= 0 else 0
            last = int(pairs[-1, 0])
            _deal(queues, since, symbols, pairs, lambda char, at: ~small[at], size)

    # Descending: small suffixes from the large ones and from each other.  A pair's value is the
    # common prefix with the suffix scanned just before, the next larger one.
    queues, since = [Queue(per_queue) for _ in range(top)], np.full(top, 0, np.int64)
    del sample, sample_common, heads
    out: list[np.ndarray] = []
    last = -1
    for c in range(top - 1, -1, -1):
        own, found, first = [], queues[c].pull(), True
        while found is not None:
            if first:
                found[0, 1] = _common(words, last, int(found[0, 0]), size) if last >= 0 else 0
                first = False
            own.append(found)
            last = int(found[-1, 0])
            _deal(queues, since, symbols, found, lambda char, at: small[at], size)
            found = queues[c].pull()
        up = large.pop()
        if len(up):
            down = up[::-1].copy()
            down[1:, 1] = up[:0:-1, 1]
            down[0, 1] = _common(words, last, int(down[0, 0]), size) if last >= 0 else 0
            own.append(down)
            last = int(down[-1, 0])
            _deal(queues, since, symbols, down, lambda char, at: small[at], size)
        out.extend(own)
    # Columns one after the other: the pairs need not exist twice.
    order = np.concatenate([p[:, 0] for p in reversed([p[::-1] for p in out])])
    common = np.concatenate([p[:, 1] for p in reversed([p[::-1] for p in out])])
    return order, np.append(np.zeros(1, common.dtype), common[:-1])


def _spans(starts: np.ndarray) -> list[dict]:
    """Sorted window starts as ranges of consecutive ones."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)])]


def repeats_in(cuts: list[bytes], size: int) -> list[np.ndarray]:
    """Window starts, per cut, whose ``size`` bytes start at more than one place in the cuts."""
    lengths = np.array([len(c) for c in cuts])
    joined = np.frombuffer(b"\x00".join(cuts) + b"\x00", np.uint8).astype(np.uint16) + np.uint16(1)
    begins = np.append(0, np.cumsum(lengths + 1)[:-1])
    joined[begins + lengths] = 0
    order, common = sorted_suffixes(joined, size)
    # Room left of a suffix in its cut, by position.
    room = (np.repeat(begins + lengths, lengths + 1) - np.arange(len(joined))).astype(np.int32)
    window = room[order] >= size
    del joined, room
    group = np.cumsum(common < size, dtype=np.int32)
    del common
    many = np.bincount(group[window], minlength=int(group[-1]) + 1) > 1
    order = order[window & many[group]]
    del group, many, window
    piece = np.searchsorted(begins, order, side="right") - 1
    place = order - begins[piece]
    by = np.lexsort((place, piece))
    piece, place = piece[by], place[by]
    edges = np.searchsorted(piece, np.arange(len(cuts) + 1))
    return [place[edges[i] : edges[i + 1]] for i in range(len(cuts))]


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def text_key(text: Column) -> list[Column]:
    """Hash and length of the bytes of a text: equal texts have equal results."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return [F.xxhash64(raw).alias("h"), F.length(raw).alias("n")]


def repeated_spans(df: DataFrame, text: str = "text", size: int = 200) -> DataFrame:
    """What to remove, one row per distinct text that loses anything: h, n, spans, kept.

    ``spans`` are the byte ranges [from, to) covered by a string of ``size``
    bytes that also starts elsewhere, in this text or another; ``kept`` holds
    the remaining bytes.  A text that occurs twice and has ``size`` bytes is
    removed whole.  Null and empty texts, and those shorter than ``size``,
    never appear.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    source = df.select(*text_key(F.col(text)), raw.alias("t")).where(F.col("n") >= size)
    run_schema = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("twice", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            parts = []
            for h, n, t in zip(*[c.to_pylist() for c in batch.columns]):
                if (h, n) not in seen:
                    seen.add((h, n))
                    m, a, b, twice = runs_of(t, size)
                    parts.append((np.full(len(m), h), np.full(len(m), n), m, a, b, twice))
            if parts:
                yield _batch([np.concatenate(c) for c in zip(*parts)], run_schema)

    runs = written_once(source.mapInArrow(in_pieces(find, 500), "h long, n int, m long, a int, b int, twice long"), CODEC)
    place = F.xxhash64("h", "n", "a")
    again = runs.groupBy("m").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.max("twice").alias("twice")).where("p <> q or twice > 0").select("m")
    wanted = runs.select("h", "n", "m", "a", "b").join(again, "m").groupBy("h", "n").agg(F.collect_set(F.struct("a", "b", "m")).alias("runs"))
    texts = source.groupBy("h", "n").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("c"))
    held = written_once(texts.join(wanted, ["h", "n"], "left").where("c > 1 or runs is not null"), CODEC)
    discard(runs)
    cut_schema = pa.schema([("m", pa.int64()), ("s", pa.binary()), ("h", pa.int64()), ("n", pa.int32()), ("a", pa.int32()), ("cut", pa.binary())])

    def cut(with_bytes: bool):
        schema = cut_schema if with_bytes else pa.schema([f for f in cut_schema if f.name != "cut"])

        def run(batches):
            for batch in batches:
                rows = []
                for h, n, t, found in zip(*[batch.column(c).to_pylist() for c in ("h", "n", "t", "runs")]):
                    for r in found:
                        piece = t[r["a"] : r["b"] + size]
                        rows.append((r["m"], hashlib.md5(piece).digest(), h, n, r["a"], piece)[: len(schema)])
                        if len(rows) >= 50_000:
                            yield _batch(list(zip(*rows)), schema)
                            rows = []
                if rows:
                    yield _batch(list(zip(*rows)), schema)

        return run

    found = held.where("runs is not null").select("h", "n", "t", "runs")
    layout = "m long, s binary, h long, n int, a int"
    cuts = found.mapInArrow(in_pieces(cut(True), 200), layout + ", cut binary")
    level = written_once(cuts.groupBy("m", "s").agg(F.first("cut").alias("cut"), F.count(F.lit(1)).alias("k")).withColumns({"a": F.lit(0), "b": F.lit(0)}), CODEC)

    piece_schema = pa.schema([("m", pa.int64()), ("s", pa.binary()), ("parent", pa.binary()), ("at", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("k", pa.int64()), ("cut", pa.binary())])

    def deal(with_bytes: bool):
        schema = piece_schema if with_bytes else pa.schema([f for f in piece_schema if f.name != "cut"])

        def run(batches):
            for batch in batches:
                rows = []
                for m, s, c, k, a, b in zip(*[batch.column(x).to_pylist() for x in ("m", "s", "cut", "k", "a", "b")]):
                    for key, p, q, x, y in narrower(c, m, a, b, size):
                        piece = c[p : q + size]
                        name = hashlib.md5(piece + b"%d %d" % (x - p, y - p)).digest()
                        rows.append((key, name, s, p, x - p, y - p, k, piece)[: len(schema)])
                if rows:
                    yield _batch(list(zip(*rows)), schema)

        return run

    # Narrower and narrower keys, until none has more than a share of a shard; light are those of all levels that do.
    light, links, total = None, [], 0
    narrow = "m long, s binary, parent binary, at int, a int, b int, k long"
    while True:
        weights = written_once(level.groupBy("m").agg(F.sum(F.length("cut")).alias("bytes"), F.min(F.col("b") - F.col("a")).alias("known")))
        too_much = (F.col("bytes") > HEAVY_BYTES) & (F.col("known") < size)
        row = weights.agg(F.sum(F.when(~too_much, F.col("bytes"))), F.count_if(too_much)).first()
        total += row[0] or 0
        # Each heavy key stands for over HEAVY_BYTES of cuts, so the keys are few whatever the input; the cuts stay where they are.
        heavy = F.broadcast(weights.where(too_much).select("m"))
        fits = level.join(heavy, "m", "left_anti") if row[1] else level
        fits = fits.select("m", "s", "cut", "k")
        light = fits if light is None else light.unionByName(fits)
        if not row[1]:
            break
        # The table of a level is dealt by key and cut, so a heavy key's cuts lie in many of its files.
        wide = level.join(heavy, "m", "left_semi")
        links.append(written_once(wide.mapInArrow(in_pieces(deal(False), 200), narrow).select("parent", "at", "s")))
        pieces = wide.mapInArrow(in_pieces(deal(True), 200), narrow + ", cut binary")
        level = written_once(pieces.groupBy("m", "s").agg(*[F.first(c).alias(c) for c in ("cut", "a", "b")], F.sum("k").alias("k")), CODEC)
    shards = max(1, -(-total // SHARD_BYTES))
    ranges = "s binary, found array<struct<a:int,b:int>>"

    def sort_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s").reset_index(drop=True)
        starts = repeats_in(pdf["cut"].tolist(), size)
        every = [np.arange(len(c) - size + 1) if k > 1 else s for c, k, s in zip(pdf["cut"], pdf["k"], starts)]
        found = pd.DataFrame({"s": pdf["s"], "found": [_spans(s) for s in every]})
        release_memory()
        return found

    shard = F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard")
    sorted_ = light.select(shard, "s", "cut", "k").groupBy("shard").applyInPandas(sort_shard, ranges)
    hits = sorted_.where(F.size("found") > 0)
    moved = F.transform("found", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b")))
    for link in reversed(links):
        # What holds in a piece holds in the cuts that it comes from; a piece of very many cuts is split.
        hits = written_once(hits)
        sizes = link.groupBy("s").agg(F.count(F.lit(1)).alias("parents"))
        up = rows_of_groups(link, written_once(sizes.join(hits, "s")), ["s"], "parents")
        hits = hits.unionByName(up.groupBy("parent").agg(F.flatten(F.collect_list(moved)).alias("found")).select(F.col("parent").alias("s"), "found"))

    spread = found.mapInArrow(in_pieces(cut(False), 500), layout).select("s", "h", "n", F.col("a").alias("at"))
    by_text = spread.join(hits, "s").groupBy("h", "n").agg(F.flatten(F.collect_list(moved)).alias("found"))
    result = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), ("kept", pa.binary())])

    def remove(batches):
        for batch in batches:
            rows = []
            for h, n, t, c, ranges_ in zip(*[batch.column(x).to_pylist() for x in ("h", "n", "t", "c", "found")]):
                if c > 1:
                    rows.append((h, n, [{"from": 0, "to": n}], b""))
                    continue
                spans: list[dict] = []
                for r in sorted(ranges_, key=lambda r: r["a"]):
                    if spans and r["a"] <= spans[-1]["to"]:
                        spans[-1]["to"] = max(spans[-1]["to"], r["b"] + size)
                    else:
                        spans.append({"from": r["a"], "to": r["b"] + size})
                ends = [0, *[s["to"] for s in spans]]
                rows.append((h, n, spans, b"".join(t[a:b] for a, b in zip(ends, [*[s["from"] for s in spans], n]))))
            if rows:
                yield _batch(list(zip(*rows)), result)

    # A text that occurs twice goes whole: its bytes need not travel.
    whole = held.select("h", "n", F.when(F.col("c") == 1, F.col("t")).alias("t"), "c").join(by_text, ["h", "n"], "left").where("c > 1 or found is not null")
    return whole.mapInArrow(in_pieces(remove, 200), "h long, n int, spans array<struct<from:int,to:int>>, kept binary")


def remove_repeats(df: DataFrame, text: str = "text", size: int = 200) -> DataFrame:
    """The rows of ``df`` with ``text`` reduced to what is not repeated, and the removed ``spans`` of the input.

    Spans count bytes.  What remains of a character that is cut through is
    left out of the text.  Rows whose text loses nothing keep it as it is
    (null stays null) with no spans; repeated rows lose all of a long text.
    """
    found = repeated_spans(df, text, size)
    h, n = text_key(F.col(text))
    rows = packed(df, h=h, n=n)

    @F.arrow_udf("string")
    def whole_characters(raw: pa.Array) -> pa.Array:
        return by_slices(lambda part: pa.array([None if r is None else r.decode("utf-8", "ignore") for r in part], pa.string()))(raw)

    joined = rows.join(found, ["h", "n"], "left")
    # A text made whole again only where something was removed.
    left = F.when(F.col("kept").isNull(), F.col("row").getField(text)).otherwise(whole_characters("kept"))
    same = [c for c in df.columns if c.lower() not in (text.lower(), "spans")]
    return joined.select(*unpacked(joined, same), left.alias(text), F.coalesce("spans", F.array()).alias("spans"))
