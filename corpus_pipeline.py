"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written and read again.  All but the last return the
columns of ``documents``.  A stage's result has to be written before a later
stage of the same run is called, which deletes the intermediate tables of the
run so far (and no others).
"""

from __future__ import annotations

from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, language, mixing, near_duplicates, suffixes
from tablewright.llm.common import fresh_names
from tablewright.session import Scratch, written_once

# Intermediate tables of the stages of a run; stages called on their own share one scope.
_STEPS: ContextVar[Scratch] = ContextVar("steps", default=Scratch())
# Even a random guess between two families of two languages has this score.
LEAST_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null or have no letter go."""
    prediction, score = fresh_names(docs, "lang_pred", "lang_score")
    found = language.identify(docs, name=prediction, score=score)
    return found.where((F.col(prediction) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 %)."""
    with _STEPS.get():
        return near_duplicates.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes that occur elsewhere too."""
    # ``docs`` is a written table: what earlier stages of this run kept on the way to it is used up.
    _STEPS.get().discard(spark, docs)
    with _STEPS.get():
        left = suffixes.remove_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    with _STEPS.get():
        return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text; ``same`` tells whether they decode to the text."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]

# The first stage is a trained model: SQL can not express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = Scratch()
    own = _STEPS.set(steps)
    try:
        for n, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if n < len(STAGES) - 1:
                with steps:
                    docs = written_once(docs)
                # All that led to the written table; tables of others stay.
                steps.discard(spark, docs)
    finally:
        _STEPS.reset(own)
    return docs
