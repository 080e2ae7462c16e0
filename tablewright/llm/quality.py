"""Quality scores from random-indexing word vectors and a small network.

Every document has a sparse random index vector, a function of its text.  The
vector of a word is the sum of the index vectors of the documents it occurs
in, over the whole corpus; words share a fixed number of hash buckets, so the
vector table has a fixed size and one aggregation makes it.  A document is the
mean of its words' vectors, weighted by rarity, next to the mean of the
vectors of its word forms (case, closing signs, repetition).  A network with
one hidden layer turns that into a probability, calibrated by one temperature.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, by_slices, in_pieces

BUCKETS = 1 << 14
DIM = 32
NONZERO = 2
LONG_WORD = 6


def form_of(word: str) -> str:
    case = "l" if word.islower() else "u" if word.isupper() else "t" if word[:1].isupper() else "n"
    last = word[-1]
    tail = "" if last.isalnum() else last * 2 if word[-2:-1] == last else last
    return f"\x00{case}{tail}"


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


# Long words that are new in the text, seen before, and words equal to the one before.
_REPEATS = [bucket_of("\x00new"), bucket_of("\x00seen"), bucket_of("\x00same")]
# Of a character: 1 lower case, 2 upper case, 4 title case, 8 letter or digit; 16 stands for all beyond the table.
_KINDS = np.array([c.islower() + 2 * c.isupper() + 4 * (c.istitle() and not c.isupper()) + 8 * c.isalnum() for c in map(chr, range(1 << 16))] + [16], np.uint8)
# Bucket of a form by case, ASCII character at the end, and whether that is doubled.
_FORMS = np.array([[[bucket_of(form_of(word + chr(c) * times)) for times in (1, 2)] for c in range(128)] for word in ("1", "a", "A", "Aa")])


def _forms(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the bucket of its form, and whether it is long: ``form_of`` for all words at once."""
    chars = np.frombuffer(b" ".join(words).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.append(np.flatnonzero(chars == 32), len(chars))
    starts = np.append(0, ends[:-1] + 1)
    kinds = _KINDS[np.minimum(chars, 1 << 16)]
    every, last = np.bitwise_or.reduceat(kinds, starts) & 23, chars[ends - 1]
    case = np.where(every == 1, 1, np.where(every == 2, 2, np.where(kinds[starts] & 2, 3, 0)))
    # All letters and digits at the end count as the digit 1, which has no case.
    end = np.where(kinds[ends - 1] & 8, ord("1"), last)
    lengths = ends - starts
    forms = _FORMS[case, np.minimum(end, 127), ((chars[ends - 2] == last) & (lengths > 1)).view(np.uint8)]
    for i in np.flatnonzero((every > 15) | (end > 127)).tolist():
        forms[i] = bucket_of(form_of(words[i].decode("utf-8", "surrogatepass")))
    return forms, (lengths >= LONG_WORD).astype(np.int64)


def tokens_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and counts of the lower-case words of a text, and of their forms; buckets may repeat."""
    # Bytes are split, and lower-cased, at and in ASCII only: the words of ``common.WORD``.
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    counts = Counter(words)
    buckets = np.fromiter(map(zlib.crc32, map(bytes.lower, counts)), np.int64, len(counts)) % BUCKETS
    forms, long = _forms(list(counts)) if words else (buckets, buckets)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    repeats = [long.sum(), (long * (n - 1)).sum(), sum(map(eq, words, words[1:]))]
    return buckets, n, np.append(forms, _REPEATS), np.append(n, repeats)


def word_vectors(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all buckets, and the weight (log of the inverse document share) of each.

    The result holds ``BUCKETS`` rows of ``DIM`` numbers whatever the input.
    """
    names = [f"d{j}" for j in range(DIM)]
    schema = pa.schema([("bucket", pa.int32()), ("docs", pa.int64()), *[(n, pa.int64()) for n in names]])

    def gather(batches):
        total, docs, seen = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen += 1
                words, n_words, forms, n_forms = tokens_of(t)
                draw = np.random.Generator(np.random.PCG64(zlib.crc32((t or "").encode("utf-8", "surrogatepass"))))
                dims, signs = draw.integers(0, DIM, NONZERO), draw.integers(0, 2, NONZERO) * 2 - 1
                at, n = np.append(words, forms), np.append(n_words, n_forms)
                docs[at[n > 0]] += 1  # once for each bucket, however often it is there
                for d, s in zip(dims, signs):
                    np.add.at(total[:, d], at, s * n.astype(np.int64))
        held = np.flatnonzero(docs)
        if seen:
            rows = [np.append(held, -1).astype(np.int32), np.append(docs[held], seen)]
            rows += [np.append(total[held, j], 0) for j in range(DIM)]
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], schema=schema)

    parts = df.select(F.col(text).cast("string")).mapInArrow(in_pieces(gather, 1000), "bucket int, docs long, " + ", ".join(f"{n} long" for n in names))
    summed = parts.groupBy("bucket").agg(F.sum("docs").alias("docs"), *[F.sum(n).alias(n) for n in names]).toPandas()
    vectors, share = np.zeros((BUCKETS, DIM), np.float32), np.ones(BUCKETS)
    everything = float(summed.loc[summed.bucket < 0, "docs"].sum()) or 1.0
    rows = summed[summed.bucket >= 0]
    at = rows.bucket.to_numpy(int)
    values = rows[names].to_numpy(np.float64)
    vectors[at] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    share[at] = rows.docs.to_numpy(float) / everything
    return vectors, np.log1p(1 / np.minimum(share, 1)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean word vector and mean form vector of a text; zeros where it has no words."""
    out = np.zeros(2 * DIM, np.float32)
    words, n_words, forms, n_forms = tokens_of(text)
    for side, (at, n) in enumerate(((words, n_words), (forms, n_forms))):
        if side == 0:
            n = n * weights[at]
        if n.sum() > 0:
            out[side * DIM : (side + 1) * DIM] = (n / n.sum()) @ vectors[at]
    return out


class Network:
    """Standardised input, one hidden layer of tanh units, one temperature."""

    def __init__(self, hidden: int = 32, epochs: int = 400, seed: int = 5):
        self.hidden, self.epochs, self.seed = hidden, epochs, seed
        self.prior, self.weights, self.temperature = 0.5, None, 1.0

    def _logits(self, x, w):
        inner = np.tanh(((x - self.mean) / self.scale) @ w[0] + w[1])
        return inner, inner @ w[2] + w[3]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        if len(set(y.tolist())) < 2:
            return self
        draw = np.random.default_rng(self.seed)
        order = draw.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        w = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), draw.normal(0, self.hidden**-0.5, self.hidden), np.zeros(())]
        first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        xs, ys = (x[used] - self.mean) / self.scale, y[used]
        for step in range(1, self.epochs + 1):
            inner = np.tanh(xs @ w[0] + w[1])
            error = (1 / (1 + np.exp(-(inner @ w[2] + w[3]))) - ys) / len(ys)
            back = np.outer(error, w[2]) * (1 - inner**2)
            for i, g in enumerate([xs.T @ back + 1e-4 * w[0], back.sum(0), inner.T @ error + 1e-4 * w[2], error.sum()]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        if len(held):
            z, t = self._logits(x[held], w)[1], y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
            losses = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(losses))])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(x, self.weights)[1] / self.temperature, -700, 700)))


def score_quality(df: DataFrame, labels: DataFrame, learn_from: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = 8000, name: str = "score") -> DataFrame:
    """Add the probability that a document's label is 1.

    Word vectors come from all texts.  The network learns from
    ``sample_rows`` of the keys for which ``learn_from`` (a condition on the
    key) holds and a label exists, those with the smallest hashes; from all of
    them when there are fewer, and from twice as many rows at most where keys
    repeat.  Null and empty texts are scored like
    any other, from a zero vector.  A key that is labelled several times has
    its smallest label; null keys and labels teach nothing.  Without both
    classes every score is the smoothed share of label 1.
    """
    vectors, weights = word_vectors(df, text)
    spark = df.sparkSession
    model = spark.sparkContext.broadcast((vectors, weights))

    @F.arrow_udf("array<float>")
    def features(texts: pa.Array) -> pa.Array:
        return by_slices(lambda part: pa.array([pooled(t, *model.value) for t in part], pa.list_(pa.float32())))(texts)

    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.min(label) > 0).cast("int").alias("_y")).where(learn_from)
    # The smallest hashes: sample_rows keys whatever the number of labels, so this side may be broadcast.
    chosen = known.select(F.col(key).alias("k"), F.col("_y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    texts = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    taught = texts.join(F.broadcast(chosen), "k").select(features("t").alias("x"), "y", F.xxhash64("t").alias("h"))
    # A key may repeat without bound; the order makes reruns agree.
    rows = taught.orderBy("h", "y").limit(2 * sample_rows).toPandas()
    network = Network()
    if len(rows):
        network.fit(np.stack(rows.x.to_list()).astype(np.float64), rows["y"].to_numpy(float))
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        def some(part: list) -> pa.Array:
            x = np.array([pooled(t, *model.value) for t in part]).reshape(-1, 2 * DIM).astype(np.float64)
            return pa.array(shared.value.probability(x), pa.float64())

        return by_slices(some)(texts)

    return append(df, **{name: scored(F.col(text).cast("string"))})
