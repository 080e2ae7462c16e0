"""Stages on tables whose other columns are named like anything used inside."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import mixing, near_duplicates, suffixes
from tablewright.llm.topk import top_k
from tablewright.sources.rows import number_rows

INSIDE = [
    "row", "h", "n", "nb", "k", "t", "spans", "kept", "_h", "_n", "_nb", "_spans", "_kept", "_named", "_component", "named", "component", "twice", "again", "label",
    "size", "total", "m", "copy", "times", "taken", "of_doc_id", "_size", "_source", "_key", "_total", "_m", "_of", "_copy", "lang_pred", "_lang_score", "Component_ID", "n_shingles",
]
LONG = "the same long passage of words " * 12
TEXTS = [LONG + "one", LONG + "two", "a b c d e f g h", "a b c d e f g h", None, "", "short text here now again and again", "é" * 150 + LONG]


def table(spark, names):
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), *[f"{n} {i}" for n in names]) for i, t in enumerate(TEXTS)]
    columns = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{n}` string" for n in names]]
    return spark.createDataFrame(rows, ", ".join(columns))


@pytest.mark.parametrize("stage", ["near_duplicates", "suffixes", "mixing"])
def test_values_come_back_unchanged(spark, stage):
    run = {"near_duplicates": near_duplicates.drop_near_duplicates, "suffixes": suffixes.remove_repeats, "mixing": mixing.take_mix}[stage]
    names = [n for n in INSIDE if not (stage == "suffixes" and n == "spans")]
    plain = Counter((r.doc_id, r.text) for r in run(table(spark, [])).collect())
    out = run(table(spark, names))
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == plain
    assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)


def test_stages_with_clashing_names(spark):
    df = table(spark, INSIDE)
    docs, names = df, df.columns
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0 and docs.where(F.col("_h") != F.concat(F.lit("_h "), F.col("doc_id").cast("string"))).count() == 0


def test_tables_of_others_survive_a_run(spark):
    numbered = number_rows(spark.range(10), ["id"])
    first = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    second = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert numbered.count() == 10
    assert first.count() == second.count() > 0


def test_vectors_out_of_range(spark):
    rows = [(0, [1e30, 0.0]), (50, [1.0, 2.0]), (1, [-1e300, 1.0]), (2, [0.5, 0.5]), (3, [1e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(50, 1, 3, 256 * 256_000_000), (50, 2, 2, 256 * 128 + 512 * 128)]
    wide = spark.createDataFrame([(i, [4e6] * 80) for i in (0, 1)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        top_k(wide, F.lit(True))
