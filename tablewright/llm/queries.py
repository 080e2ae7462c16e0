"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import alignment, bpe, fingerprints, language, language_model, licenses, mixing, near_duplicates, quality, ranked_search, suffixes, token_counts, topk
from tablewright.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(column) -> Column:
    return F.sha2(column.cast("binary"), 256)


@registered
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


@registered
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The longest-match token count of every whole text."""
    counted = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_tokens")


@registered
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 3, 1)
    scored = quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registered
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 4, 2)
    found = language.identify(table(spark, folder, "documents"), ~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@registered
def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op5_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@registered
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@registered
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, folder, "documents"))


@registered
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    # The digest of an unchanged text needs the text; all else joins by its key.
    rows = docs.select("doc_id", *suffixes.text_key(F.col("text")), F.unhex(digest(text)).alias("own"))
    found = suffixes.repeated_spans(docs).select("h", "n", "spans", F.unhex(F.sha2("kept", 256)).alias("left"))
    spans = F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>"))
    return rows.join(found, ["h", "n"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_bytes"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"]).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.lower(F.hex(F.coalesce("left", "own"))).alias("kept_sha256"),
    )


@registered
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@registered
def op3_katz(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_model.katz_scores(table(spark, folder, "documents"), ~held_out(F.col("doc_id"), 7, 2))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@registered
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.link_counts(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


@registered
def op11_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents")).select("doc_id", "licenses.*")
    starts = F.transform("base", lambda f: f["first_word"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.label_list(F.col("base")).alias("base_labels"),
        licenses.label_list(F.concat("base", "found")).alias("labels"),
        "score",
    )


@registered
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM i) GROUP BY doc_id, n, term),
g AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, c GROUP BY term, docs),
s AS (SELECT i.item_id, f.doc_id,
             CAST(sum(g.weight * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * f.n * c.docs) // c.terms)))) AS BIGINT) AS score
      FROM f JOIN g ON f.term = g.term JOIN i ON i.term = f.term, c GROUP BY i.item_id, f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
