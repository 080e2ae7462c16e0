"""Scores of a Katz backoff model whose counts come from the whole corpus.

The model has three levels that are evaluated recursively for every token: the
pair of a word and the word before it, the word alone, and the class of all
unknown words.  Counts up to five are discounted by Good and Turing's formula;
what a level sets aside goes to the words it has not seen after the same
history, in proportion to the level below, so that for every history the
probabilities of all known words and the unknown class add up to one.

Texts are packed into blocks of tokens that refer to the block's own list of
words.  Two exchanges serve each block.  In the first, tables partitioned by
word answer with the word's global number and training count.  In the second,
tables partitioned by history get the block's distinct pairs with their
training counts and answer with the corpus counts of these pairs and with what
the backoff weight of each history needs.  Only distinct words and pairs of a
block travel, as sorted and compressed arrays; histories that hold more than a
thousandth of all tokens (fewer than a thousand exist) are dealt by pair, and
their sums are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import ascii_lower, in_pieces, words_of
from tablewright.session import written_once

BLOCK_TOKENS = 2_000_000
BUCKET_TOKENS = 4_000_000
DISCOUNTED = 5
UNKNOWN, START = -1, -2
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_zstd = pa.Codec("zstd")


def pack(values: np.ndarray) -> bytes:
    """Compressed array of integers or floats; the bytes of equal weight stand together."""
    head = f"{values.dtype.str},{len(values)};".encode()
    planes = np.ascontiguousarray(np.frombuffer(values.tobytes(), np.uint8).reshape(len(values), values.itemsize).T)
    return head + _zstd.compress(planes.tobytes(), asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    kind, n = raw[: raw.index(b";")].decode().split(",")
    n, item = int(n), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = _zstd.decompress(raw[raw.index(b";") + 1 :], decompressed_size=n * item, asbytes=True)
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(item, n).T).tobytes(), kind)


def small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int32) if not len(values) or -(1 << 31) <= values.min() and values.max() < 1 << 31 else values.astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def discounts(of: dict[int, int]) -> np.ndarray:
    """Factor for counts 0..DISCOUNTED + 1 from the number of types per count; the last is 1.

    Good and Turing's, scaled so that counts above DISCOUNTED stay as they
    are; where the counts are too thin for a factor between 0 and 1, half a
    count is set aside instead.
    """
    n = [of.get(r, 0) for r in range(DISCOUNTED + 2)]
    out = np.ones(DISCOUNTED + 2)
    over = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - over) / (1 - over) if n[r] and over != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Words:
    """The level of single words: probability of a word by its count, and of the unknown class."""

    def __init__(self, of: dict[int, int]):
        self.tokens = sum(r * n for r, n in of.items())
        self.types = sum(of.values())
        self.factor = discounts(of)
        kept = sum(n * r * self.factor[min(r, DISCOUNTED + 1)] for r, n in of.items())
        # With nothing to learn from, every token is of the unknown class.
        self.unknown = max(1 - kept / self.tokens, 1e-12) if self.tokens else 1.0

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        known = count * self.factor[np.minimum(count, DISCOUNTED + 1)] / self.tokens
        # The discounts of a corpus without counts up to five set nothing aside: make room for the unknown class.
        return np.where(count > 0, known, self.unknown) / self.scale

    @property
    def scale(self) -> float:
        kept = 1 - self.unknown if self.unknown > 1e-12 else 1.0
        return kept + self.unknown


def _rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in types.items()], names=list(types))


_ANSWER = {"block": pa.int64(), "bucket": pa.int32(), "payload": pa.list_(pa.binary())}
_ANSWER_SQL = "block long, bucket int, payload array<binary>"


def _blocks(df: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        known, ids, lengths, learn, tokens, held = {"": 0}, [], [], [], [], 0
        id_type = None

        def block():
            flat = np.fromiter((x for t in tokens for x in t), np.int32, held)
            trained = np.repeat(np.array(learn, bool), lengths)
            counts = np.bincount(flat[trained], minlength=len(known))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known), np.uint64, len(known)).view(np.int64)
            types = {"block": pa.int64(), "ids": pa.list_(id_type), "lengths": pa.binary(), "learn": pa.binary(), "tokens": pa.binary(), "words": pa.binary(), "counts": pa.binary(), "n": pa.int64()}
            values = [part << 24 | seq, ids, pack(np.array(lengths, np.int32)), pack(np.array(learn, np.uint8)), pack(flat), pack(hashes), pack(small(counts)), held]
            return _rows({n: [v] for n, v in zip(types, values)}, types)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t, u in zip(*[c.to_pylist() for c in batch.columns]):
                found = [known.setdefault(w, len(known)) for w in words_of(ascii_lower(t or ""))]
                found.append(0)
                ids.append(i)
                lengths.append(len(found))
                learn.append(bool(u))
                tokens.append(found)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield block()
                    known, ids, lengths, learn, tokens, held, seq = {"": 0}, [], [], [], [], 0, seq + 1
        if held:
            yield block()

    source = df.select(F.col(key), F.col(text).cast("string"), train)
    return written_once(source.mapInArrow(in_pieces(read, 500), f"block long, ids array<{kind}>, lengths binary, learn binary, tokens binary, words binary, counts binary, n long"))


def _word_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (mixed(hashes) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    return order, bucket[order]


def _edges(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    at = np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1])) if len(sorted_buckets) else np.zeros(0, int)
    return [(int(sorted_buckets[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(sorted_buckets)))]


def _word_answers(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket: global number (-1 if never in training) and training count of its words, in the order of _word_order."""

    def ask(batches):
        for batch in batches:
            for block, words, counts in zip(*[c.to_pylist() for c in batch.columns]):
                hashes, counts = unpack(words), unpack(counts)
                order, bucket = _word_order(hashes, buckets)
                out = [(block, b, [pack(hashes[order[a:z]]), pack(counts[order[a:z]])]) for b, a, z in _edges(bucket)]
                yield _rows(dict(zip(_ANSWER, zip(*out))), _ANSWER)

    def merge(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        asked = [[unpack(p) for p in row] for row in table["payload"].to_pylist()]
        words, at = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([c for _, c in asked]), minlength=len(words)).astype(np.int64)
        number = np.where(total > 0, np.arange(len(words)) * buckets + bucket, UNKNOWN)
        ends = np.cumsum([len(h) for h, _ in asked])
        parts = np.split(at, ends[:-1])
        rows = [(block, bucket, [pack(small(number[p])), pack(small(total[p]))]) for block, p in zip(table["block"].to_pylist(), parts)]
        values, types = np.unique(total[total > 0], return_counts=True)
        rows.append((UNKNOWN, bucket, [pack(values), pack(types)]))
        return pa.Table.from_batches([_rows(dict(zip(_ANSWER, zip(*rows))), _ANSWER)])

    asked = blocks.select("block", "words", "counts").mapInArrow(in_pieces(ask, 1), _ANSWER_SQL)
    return written_once(asked.groupBy("bucket").applyInArrow(merge, _ANSWER_SQL))


def _summed(answers: DataFrame, block: int) -> dict[int, int]:
    """Number of types per count, added up over all buckets."""

    def spread(batches):
        for batch in batches:
            for (payload,) in zip(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(p).astype(np.int64)) for p in payload], names=["r", "n"])

    rows = answers.where(F.col("block") == block).select("payload").mapInArrow(in_pieces(spread, 100), "r long, n long")
    # Distinct counts: fewer than the square root of twice the number of tokens.
    return {r.r: r.n for r in rows.groupBy("r").agg(F.sum("n").alias("n")).collect()}


class _Pairs:
    """The distinct pairs of one block, in the order in which they are asked for."""

    def __init__(self, row: dict, answers: list[tuple[int, list[bytes]]], word_buckets: int, pair_buckets: int, hot: int):
        order, _ = _word_order(unpack(row["words"]), word_buckets)
        answers = sorted(answers, key=lambda a: a[0])
        number, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number[order] = np.concatenate([unpack(p[0]) for _, p in answers])
        count[order] = np.concatenate([unpack(p[1]) for _, p in answers])
        self.lengths, self.learn, tokens = unpack(row["lengths"]), unpack(row["learn"]).astype(bool), unpack(row["tokens"]).astype(np.int64)
        n = len(number)
        # Block-local codes: n is the start of a text, n + 1 any unknown word.
        code = np.where(number < 0, n + 1, np.arange(n))
        self.count = np.append(count, [0, 0])
        number = np.append(number, [START, UNKNOWN])
        self.word = code[tokens]
        begins = np.append(0, np.cumsum(self.lengths)[:-1])
        history = np.append(n, self.word[:-1])
        history[begins] = n
        self.begins, self.history = begins, history
        self.trained = np.repeat(self.learn, self.lengths)
        key, at = np.unique(history << 32 | self.word, return_inverse=True)
        h, w = key >> 32, key & 0xFFFFFFFF
        self.start, self.unknown = n, n + 1
        seen = np.bincount(at, weights=self.trained, minlength=len(key)).astype(np.int64)
        frequent = (h == n) | (self.count[h] > hot)
        bucket = (mixed(np.where(frequent, number[h] * 1_000_003 + number[w], number[h])) % np.uint64(pair_buckets)).astype(np.int64)
        asked = np.flatnonzero(h != n + 1)
        order = asked[np.lexsort((number[w[asked]], number[h[asked]], bucket[asked]))]
        self.h, self.w, self.at, self.order = h, w, at, order
        self.number, self.seen, self.bucket, self.frequent = number, seen, bucket[order], frequent

    def requests(self) -> Iterator[tuple[int, list[bytes]]]:
        for b, a, z in _edges(self.bucket):
            at = self.order[a:z]
            h = self.number[self.h[at]]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            fan = np.diff(np.append(first, len(h)))
            yield b, [pack(small(h[first])), pack(small(fan)), pack(small(self.number[self.w[at]])), pack(small(self.seen[at])), pack(small(self.count[self.w[at]])), pack(self.frequent[at][first].astype(np.uint8))]


_BLOCK = ["block", "ids", "lengths", "learn", "tokens", "words"]


def _with_answers(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run(row, answers)`` for every block with everything addressed to it."""
    left = blocks.select(*_BLOCK).groupBy("block")
    right = answers.where("block >= 0").groupBy("block")

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return run(a.to_pylist()[0], a.schema.field("ids").type.value_type, b.to_pylist())

    return left.cogroup(right).applyInArrow(both, schema)


def katz_scores(df: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, learned, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z); tokens are the words and one end.  The model
    learns from all rows with ``learn_from`` true.  ``base_score`` is the
    add-one score of single tokens, ``score`` the model's log10 probability of
    the whole text.  Null and empty texts consist of the end alone; repeated
    rows repeat their scores (and count each time in training); null keys are
    kept.  With nothing to learn from, all tokens are unknown and both scores
    are 0.  Words are told apart by 64-bit hashes.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    blocks = _blocks(df, key, text, learn_from)
    size = blocks.agg(F.sum("n")).first()[0]
    if not size:
        return df.sparkSession.createDataFrame([], schema)
    buckets = max(1, -(-size // BUCKET_TOKENS))
    words = _word_answers(blocks, buckets)
    single = Words(_summed(words, UNKNOWN))
    hot = single.tokens // 1000

    def ask(row, id_type, answers):
        pairs = _Pairs(row, [(a["bucket"], a["payload"]) for a in answers], buckets, buckets, hot)
        rows = [(row["block"], b, p) for b, p in pairs.requests()]
        return pa.Table.from_batches([_rows(dict(zip(_ANSWER, zip(*rows))), _ANSWER)])

    def merge(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        asked = [[unpack(p) for p in row] for row in table["payload"].to_pylist()]
        h = np.concatenate([np.repeat(a[0], a[1]) for a in asked]).astype(np.int64)
        w = np.concatenate([a[2] for a in asked]).astype(np.int64)
        order = np.lexsort((w, h))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1]))
        at = np.empty(len(h), np.int64)
        at[order] = np.cumsum(new) - 1
        total = np.bincount(at, weights=np.concatenate([a[3] for a in asked])).astype(np.int64)
        first = order[new]
        count = np.concatenate([a[4] for a in asked]).astype(np.int64)[first]
        histories, of = np.unique(h[first], return_inverse=True)
        n = len(histories)
        # Per history: pairs with counts 1 to 5, and the lower probability of all pairs seen.
        fans = np.stack([np.bincount(of, weights=total == r, minlength=n) for r in range(1, DISCOUNTED + 1)]).astype(np.int64)
        lower = np.bincount(of, weights=np.where(total > 0, single.probability(count), 0.0), minlength=n)
        often = np.zeros(n, bool)
        often[np.searchsorted(histories, np.concatenate([a[0][a[5] > 0] for a in asked]))] = True
        rows, begin = [], 0
        for block, a in zip(table["block"].to_pylist(), asked):
            own = np.searchsorted(histories, a[0])
            rows.append((block, buckets + bucket, [pack(small(total[at[begin : begin + len(a[2])]])), pack(small(fans[:, own].ravel())), pack(lower[own])]))
            begin += len(a[2])
        values, types = np.unique(total[total > 0], return_counts=True)
        rows.append((UNKNOWN, bucket, [pack(values), pack(types)]))
        if often.any():
            rows.append((START, bucket, [pack(histories[often]), pack(fans[:, often].ravel()), pack(lower[often])]))
        return pa.Table.from_batches([_rows(dict(zip(_ANSWER, zip(*rows))), _ANSWER)])

    asked = _with_answers(blocks, words, ask, _ANSWER_SQL)
    replies = written_once(asked.groupBy("bucket").applyInArrow(merge, _ANSWER_SQL))
    factor = discounts(_summed(replies, UNKNOWN))
    fields = [f"n{r}" for r in range(1, DISCOUNTED + 1)]

    def spread(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                h, fans, lower = map(unpack, payload)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.astype(np.int64), *fans.astype(np.int64).reshape(DISCOUNTED, -1), lower)], names=["h", *fields, "lower"])

    parts = replies.where(F.col("block") == START).select("payload").mapInArrow(in_pieces(spread, 100), "h long, " + ", ".join(f"{f} long" for f in fields) + ", lower double")
    # Fewer than a thousand words hold a thousandth of the tokens each, and one is the start.
    frequent = {r.h: (np.array([r[f] for f in fields]), r.lower) for r in parts.groupBy("h").agg(*[F.sum(f).alias(f) for f in fields], F.sum("lower").alias("lower")).collect()}
    starts = df.where(learn_from).count()

    def finish(row, id_type, answers):
        pairs = _Pairs(row, [(a["bucket"], a["payload"]) for a in answers if a["bucket"] < buckets], buckets, buckets, hot)
        got = {a["bucket"] - buckets: [unpack(p) for p in a["payload"]] for a in answers if a["bucket"] >= buckets}
        logs = np.zeros(len(pairs.h))
        single_logs = np.log10(single.probability(pairs.count))
        for b, a, z in _edges(pairs.bucket):
            total, fans, lower = got[b]
            at = pairs.order[a:z]
            h = pairs.number[pairs.h[at]]
            of = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
            fans = fans.reshape(DISCOUNTED, -1).astype(np.int64).copy()
            lower = lower.copy()
            for i in np.unique(of[pairs.frequent[at]]).tolist():
                fans[:, i], lower[i] = frequent[int(h[np.searchsorted(of, i)])]
            base = np.where(pairs.h[at] == pairs.start, starts, pairs.count[pairs.h[at]])
            r = np.arange(1, DISCOUNTED + 1)
            # What discounting takes from this history's pairs, over what its unseen words have below.
            spare = ((r * (1 - factor[1 : DISCOUNTED + 1]))[:, None] * fans).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.maximum(spare[of] / base, 0) / np.maximum(1 - lower[of], 1e-15)
                # A history whose pairs are all counted often sets nothing aside: a tiny weight keeps logs finite.
                backed = np.log10(np.maximum(weight, 1e-12)) + single_logs[pairs.w[at]]
                direct = np.log10(total * factor[np.minimum(total, DISCOUNTED + 1)] / base)
            logs[at] = np.where(base == 0, single_logs[pairs.w[at]], np.where(total > 0, direct, backed))
        after_unknown = pairs.h == pairs.unknown
        logs[after_unknown] = single_logs[pairs.w[after_unknown]]
        by_token = logs[pairs.at]
        count = pairs.count[pairs.word]
        plain = np.log10((count + 1) / (single.tokens + single.types + 1))
        n = len(pairs.lengths)
        columns = [
            pa.array(row["ids"], id_type),
            pa.array(pairs.learn),
            pa.array(pairs.lengths.astype(np.int64)),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), pairs.begins)),
            pa.array(np.full(n, single.tokens, np.int64)),
            pa.array(np.add.reduceat(plain, pairs.begins)),
            pa.array(np.add.reduceat(by_token, pairs.begins)),
        ]
        return pa.Table.from_arrays(columns, names=[key, "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with_answers(blocks, words.unionByName(replies), finish, schema)
