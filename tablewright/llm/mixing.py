"""Mixing sources to target weights by balanced (cube) sampling.

Each source has a target; a document of it is expected to be taken
``target / source size`` times.  The whole part is certain, the rest is an
inclusion probability.  The cube method turns probabilities into decisions:
three undecided documents at a time move along the null space of the two
constraints (number of documents, number of words) until one of them reaches
0 or 1, so both totals stay what was expected.  Chunks of bounded size fly in
parallel and leave at most two documents each; these fly again in fewer
chunks, until one chunk per source is left.  There, the last few documents are
landed on the combination whose totals come nearest.
"""

from __future__ import annotations

import random
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import n_words, packed, unpacked
from tablewright.session import written_once
from tablewright.sources.rows import number_rows

CHUNK = 2000
LANDING = 12
LARGEST = 16
MOST = 3
NEAR = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target for a table with one row per source.

    Sources in code point order, null last, have the repeating ``weights`` and
    share the sum of all sizes.  A target stops at ``most`` times its source's
    size; what is over goes to the others by weight until none is above.
    """
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "_n")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written_once(ranked.select("source", "source_size", weight.alias("w")))
    cap = most * F.col("source_size")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("w")).first()
    level, n_capped = (total[0] / total[1] if total[1] else 0.0), -1
    while total[0]:
        above = F.col("w") * F.lit(level) >= cap
        left = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("caps"), F.sum(F.when(~above, F.col("w"))).alias("w"), F.count_if(above).alias("n")
        ).first()
        if left.n == n_capped or not left.w:
            break
        level, n_capped = (total[0] - left.caps) / left.w, left.n
    return ranked.select("source", "source_size", F.least(F.col("w") * F.lit(float(level)), cap.cast("double")).alias("target"))


def _step(p: np.ndarray, u: np.ndarray, draw: random.Random) -> np.ndarray:
    """Move along ``u`` or against it until something is decided; the choice keeps expected values."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
        down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
    p = p + (up if draw.random() * (up + down) < down else -down) * u
    return np.where(p < NEAR, 0.0, np.where(p > 1 - NEAR, 1.0, p))


def _fly_largest(p: np.ndarray, size: np.ndarray, draw: random.Random) -> np.ndarray:
    """Decide the largest documents; all smaller undecided ones share the balance.

    The direction is the point of the null space next to moving one document
    alone.  Otherwise a very large document, which three-document moves hardly
    change, would be left for landing.
    """
    order = np.argsort(-size, kind="stable")
    order = order[(p[order] > 0) & (p[order] < 1)]
    for n, first in enumerate(order[:LARGEST]):
        while 0 < p[first] < 1:
            rest = order[n + 1 :][(p[order[n + 1 :]] > 0) & (p[order[n + 1 :]] < 1)]
            totals = np.stack([np.ones(len(rest)), size[rest]])
            one = np.array([1.0, size[first]])
            if len(rest) < 3:
                return p
            u = -totals.T @ (np.linalg.pinv(totals @ totals.T, hermitian=True) @ one)
            if np.abs(totals @ u + one).max() > 1e-6 * (1 + one.max()):
                break  # all others have one size: nothing balances this document
            both = np.append(first, rest)
            p[both] = _step(p[both], np.append(1.0, u), draw)
    return p


def _fly(p: list[float], size: list[float], draw: random.Random, stop: int) -> list[int]:
    """Move probabilities three at a time until at most ``stop`` are undecided; returns these."""
    waiting = [i for i, x in enumerate(p) if 0 < x < 1]
    pool: list[int] = []
    while len(pool) + len(waiting) > max(2, stop):
        while len(pool) < 3 and waiting:
            pool.append(waiting.pop())
        a, b, c = pool
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, x in zip(pool, u):
            if x:
                ahead, back = ((1 - p[i]) / x, p[i] / x) if x > 0 else (-p[i] / x, (p[i] - 1) / x)
                up, down = min(up, ahead), min(down, back)
        step = up if draw.random() * (up + down) < down else -down
        for i, x in zip((a, b, c), u):
            p[i] += step * x
            if p[i] < NEAR or p[i] > 1 - NEAR:
                p[i] = float(round(p[i]))
                pool.remove(i)
    return pool + waiting


def _land(p: list[float], size: list[float], active: list[int]) -> None:
    """Decide the last documents: the combination nearest to the expected words, then documents."""
    if not active:
        return
    q, s = np.array([p[i] for i in active]), np.array([size[i] for i in active])
    choices = (np.arange(1 << len(active))[:, None] >> np.arange(len(active))) & 1
    words, docs = np.abs(choices @ s - q @ s), np.abs(choices.sum(1) - q.sum())
    best = choices[np.lexsort((docs, np.round(words, 6)))[0]]
    for i, x in zip(active, best.tolist()):
        p[i] = float(x)


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_h", "doc_id"], kind="stable", na_position="first").reset_index(drop=True)
    last = pdf["_chunks"].iloc[0] == 1
    source = pdf["source"].iloc[0]
    key = f"{'' if source is None else 's' + str(source)}|{pdf['_chunk'].iloc[0]}|{pdf['_level'].iloc[0]}"
    draw = random.Random(zlib.crc32(key.encode()))
    words = pdf["size"].to_numpy(float)
    start = pdf["p"].to_numpy(float).copy()
    p = (_fly_largest(start, words, draw) if len(start) > 4 * LANDING else start).tolist()
    size = words.tolist()
    active = _fly(p, size, draw, LANDING if last else 2)
    if last:
        _land(p, size, active)
    return pdf.assign(p=p)


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, times, taken.

    One row per input row.  ``size`` counts words; documents without words
    (null or empty texts) are taken 0 times.  Null is a source of its own,
    null keys are ordinary.  Rows equal in key, source and size are
    interchangeable: they are counted first and share the decision, so a key
    that repeats without bound is one row here.  The same input gives the same
    mix.  Words taken differ from the target by less than what the smallest
    documents left for landing allow; an empty table gives an empty mix.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    same = written_once(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    sizes = same.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = written_once(source_targets(sizes, weights, most))
    # No hint: Spark broadcasts the table of sources if its size on disk is small, and splits skewed keys otherwise.
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    joined = same.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    expected = F.when(F.col("size") > 0, ratio * F.col("m")).otherwise(0.0)
    undecided = joined.withColumn("e", expected).withColumn("whole", F.floor(F.col("e") + NEAR))
    undecided = undecided.withColumn("p", F.greatest(F.col("e") - F.col("whole"), F.lit(0.0))).drop("e")
    undecided = undecided.withColumn("_h", F.xxhash64("doc_id", "size"))
    decided, level = [], 0
    while True:
        settled = (F.col("p") <= NEAR) | (F.col("p") >= 1 - NEAR)
        left = undecided.where(~settled)
        counts = written_once(left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks")))
        most_chunks = counts.agg(F.max("_chunks")).first()[0]
        decided.append(undecided.where(settled))
        if most_chunks is None:
            break
        flying = left.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        flying = flying.withColumn("_chunk", F.pmod(F.xxhash64("_h", F.lit(level)), F.col("_chunks")).cast("int")).withColumn("_level", F.lit(level))
        flown = written_once(flying.groupBy("source", "_chunk").applyInPandas(_decide, flying.schema))
        undecided = flown.drop("_chunks", "_chunk", "_level")
        level += 1
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    total = F.col("whole") + F.round("p").cast("long")
    copies = result.withColumn("_c", total).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    times = F.floor(F.col("_c") / F.col("m")) + (F.col("_i") < F.col("_c") % F.col("m")).cast("long")
    return copies.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def take_mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them: none, once or several times.

    Rows that agree in key, source and size share a decision; which of them
    gets an odd repeat follows from a hash of the text, so that rows equal in
    all of these get it together or not at all.
    """
    taken = mix(df, weights, key, text, source, most)
    by = ["doc_id", "source", "size"]
    decided = written_once(taken.groupBy(*by).agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("m")).where("total > 0"))
    decided = decided.select(*[F.col(c).alias(f"of_{c}") for c in by], "total", "m")
    rows = packed(df, doc_id=F.col(key), source=F.col(source).cast("string"), size=n_words(F.col(text)))
    joined = rows.join(decided, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]))
    times = F.floor(F.col("total") / F.col("m")) + (F.pmod(F.xxhash64(F.col("row").getField(text)), F.col("m")) < F.col("total") % F.col("m")).cast("long")
    copies = joined.where(times > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return copies.select(*unpacked(copies, df.columns))
