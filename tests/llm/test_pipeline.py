from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from test_near_duplicates import brute as near_brute
from test_suffixes import brute as suffix_brute
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm.common import words_of

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(-5, None, "en", "src1", 0), (-4, "", None, None, 0), (-3, "12 34 !!", "en", "src1", 8)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language ID"](spark, docs, FOLDER)
    assert one.columns == columns
    known = rows_of(one)
    assert {r["doc_id"] for r in rows_of(docs)} - {r["doc_id"] for r in known} == {-5, -4, -3}
    one = spark.createDataFrame(one.collect(), one.schema)
    two = stages["MinHash near-dedup"](spark, one, FOLDER)
    expected = near_brute([(r["doc_id"], r["text"]) for r in known], 5, 80)
    kept = rows_of(two)
    assert two.columns == columns and sorted(r["doc_id"] for r in kept) == sorted(i for i, (n, c) in expected.items() if i == c)
    two = spark.createDataFrame(two.collect(), two.schema)
    three = stages["suffix-array dedup"](spark, two, FOLDER)
    cut = {r["doc_id"]: r["text"] for r in rows_of(three)}
    for r, (removed, _, left) in zip(kept, suffix_brute([r["text"] for r in kept])):
        assert cut[r["doc_id"]] == (left.decode("utf-8", "ignore") if removed else r["text"])
    assert three.columns == columns and three.where(F.col("n_chars") != F.length("text")).count() == 0
    three = spark.createDataFrame(three.collect(), three.schema)
    four = stages["mixing sources"](spark, three, FOLDER)
    assert four.columns == columns
    taken = Counter(r["doc_id"] for r in rows_of(four))
    assert max(taken.values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in rows_of(four)}
    assert all(cut[i] == t for i, t in texts.items())
    total = sum(len(words_of(t)) for t in cut.values())
    assert abs(sum(n * len(words_of(cut[i])) for i, n in taken.items()) - total) < 0.05 * total
    last = rows_of(stages["BPE encoding"](spark, four, FOLDER))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter(r["doc_id"] for r in last) == taken
    assert all(r["same"] and r["ids"] == coder.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in last)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
