"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks, and every block of queries
meets every block of candidates once per sweep.  A sweep scores its block pair
with one matrix product and counts scores into bins; summed over all blocks
the counts tell which bin holds a query's k-th best score, and the next sweep
looks into that bin with finer ones.  When bins are one unit wide the k-th
score is known exactly, and a last sweep emits what is above it plus, among
ties, the smallest ids.

A block reports only bins at or above its own k-th best score, and at most as
many tied rows as are still missing: what it leaves out can not be in the
answer.  So a query gets a few rows per block, also where a third of all
vectors are equal.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import in_pieces
from tablewright.session import written_once

BLOCK_QUERIES = 1024
BLOCK_CANDIDATES = 4096
BINS = 1024
# Components are below this in size once scaled.
LARGEST = 1 << 30


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null, not finite or out of range."""
    # With three-valued logic a null component makes the test null, which is not true.
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(math.inf)) & x.isNotNull())
    exact = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    # Larger numbers would leave 64 bits; the bounds are written so that they hold for a saturated value too.
    small = F.forall(exact, lambda x: (x > -LARGEST) & (x < LARGEST))
    return F.when(finite, F.when(small, exact))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _pack(vectors: DataFrame, width: int, buckets: int) -> DataFrame:
    """Blocks of candidates, dealt over ``buckets``."""
    schema = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())])

    def packed(batches):
        n = 0
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1).to_pylist(), width)
            part = int(ids[0]) % buckets if n == 0 else (part + 1) % buckets
            n += 1
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], schema=schema)

    return vectors.select("vec_id", "v").mapInArrow(in_pieces(packed, BLOCK_CANDIDATES), "part int, ids binary, rows binary")


def _query_blocks(queries: DataFrame, width: int) -> DataFrame:
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        state = pdf[["q", "lo", "step", "need", "hi"]].to_numpy(np.int64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "state": [state.tobytes()], "queries": [_matrix(pdf["v"].to_list(), width).tobytes()]})

    return queries.groupBy("block").applyInPandas(packed, "block int, state binary, queries binary")


def _sweep(candidates: DataFrame, queries: DataFrame, parts: int, blocks: int, width: int, exact: bool, look, schema: str, fields: list) -> DataFrame:
    """Let ``look(state, ids, scores)`` see every block pair; scores of the query itself are masked."""

    def run(batches):
        for batch in batches:
            for ids, rows, state, qs in zip(*[batch.column(c).to_pylist() for c in ("ids", "rows", "state", "queries")]):
                ids, state = np.frombuffer(ids, np.int64), np.frombuffer(state, np.int64).reshape(-1, 5)
                a, b = np.frombuffer(qs, np.int64).reshape(-1, width), np.frombuffer(rows, np.int64).reshape(-1, width)
                scores = (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if exact else a @ b.T
                found = look(state, ids, scores, state[:, :1] != ids[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=fields)

    left = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    joined = left.hint("merge").join(right, ["part", "block"]).select("ids", "rows", "state", "queries")
    return joined.mapInArrow(in_pieces(run, 1), schema)


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` best rows by integer inner product for every query row: query_id, rank, vec_id, score.

    Components become floor(scale * x).  Vectors that are null, or hold null,
    NaN or infinite components, and rows without a key take no part.  Scores
    are 64-bit integers: vectors with a scaled component of ``LARGEST`` or more
    in size take no part either, and if the remaining ones are so long and
    large that a score could pass 62 bits, that is an error which says so.
    Equal rows count once; a query never finds rows with its own key; shorter
    vectors are filled up with zeros; ties go to the smaller key.  With fewer
    than ``k`` candidates all are returned, without candidates or queries none.
    """
    usable = df.select(F.col(key).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("is_query"))
    vectors = written_once(usable.where("vec_id is not null and v is not null").dropDuplicates(["vec_id", "v"]))
    size = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_query").alias("nq"),
        F.max(F.size("v")).alias("width"),
        F.max(F.array_max(F.transform("v", F.abs))).alias("top"),
    ).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not size.nq or not size.width:
        return df.sparkSession.createDataFrame([], result)
    width, bound = size.width, size.width * size.top**2
    if bound >= 1 << 62:
        raise ValueError(f"scores of {width} components of up to {size.top} do not fit 64 bits; scale the vectors down")
    exact = bound < 1 << 53
    blocks, parts = -(-size.nq // BLOCK_QUERIES), max(1, min(-(-size.n // BLOCK_CANDIDATES), 4096))
    candidates = written_once(_pack(vectors, width, parts))
    queries = vectors.where("is_query").select(F.col("vec_id").alias("q"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    step = -(-(2 * bound + 1) // BINS)
    state = written_once(queries.withColumns({"lo": F.lit(-bound), "step": F.lit(step), "need": F.lit(k).cast("long"), "hi": F.lit(bound + 1)}))

    def count(state, ids, scores, other):
        bins = (scores - state[:, 1:2]) // state[:, 2:3]
        bins = np.where(other & (bins >= 0) & (scores < state[:, 4:5]), bins, -1)
        out = []
        for i in range(len(state)):
            need = int(state[i, 3])
            own = bins[i]
            if len(own) > need:
                own = own[own >= np.partition(own, len(own) - need)[len(own) - need]]
            b, n = np.unique(own[own >= 0], return_counts=True)
            out.append(np.stack([np.full(len(b), state[i, 0]), b, n]))
        return np.concatenate(out, axis=1)

    while True:
        counts = _sweep(candidates, _query_blocks(state, width), parts, blocks, width, exact, count, "q long, bin long, n long", ["q", "bin", "n"])
        summed = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("q").orderBy(F.desc("bin"))
        # At most BINS rows per query.
        ranked = summed.withColumn("upto", F.sum("n").over(down.rowsBetween(W.unboundedPreceding, 0))).withColumn("least", F.min("bin").over(W.partitionBy("q")))
        reach = ranked.join(state.select("q", "need"), "q").where("upto >= need or bin = least").groupBy("q").agg(
            F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("at")
        )
        finer = F.greatest(F.lit(1), F.ceil(F.col("step") / BINS)).cast("long")
        low = F.col("lo") + F.col("at.bin") * F.col("step")
        narrowed = {"lo": low, "hi": low + F.col("step"), "step": finer, "need": F.col("need") - F.col("at.above")}
        state = written_once(state.join(reach, "q").select("q", "v", "block", *[c.cast("long").alias(n) for n, c in narrowed.items()]))
        if step == 1:
            break
        step = max(1, -(-step // BINS))

    def emit(state, ids, scores, other):
        out = []
        for i in range(len(state)):
            at = np.flatnonzero(other[i] & (scores[i] > state[i, 1]))
            tied = np.flatnonzero(other[i] & (scores[i] == state[i, 1]))
            need = int(state[i, 3])
            if len(tied) > need:
                tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
            at = np.concatenate([at, tied])
            out.append(np.stack([np.full(len(at), state[i, 0]), ids[at], scores[i, at]]))
        return np.concatenate(out, axis=1)

    best = _sweep(candidates, _query_blocks(state, width), parts, blocks, width, exact, emit, "query_id long, vec_id long, score long", ["query_id", "vec_id", "score"])
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
