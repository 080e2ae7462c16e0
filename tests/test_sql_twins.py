"""Rows on which a query and its SQL twin once parted."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

CASES = {
    # Twice the price, negated, has five decimals that end in 5.
    "C07_numeric_difference": ("orders", [(736407, 354430.575125), (5692141, 437221.13657499995), (70, 1.0), (1, None), (3, 0.0)], "o_orderkey long, o_totalprice double"),
    # The sharp s is two letters in upper case.
    "N07_contract_key_sets": ("documents", [(1, "daß dass\nweiß schwarz"), (2, "größe GRÖSSE x y"), (3, "ŉ a")], "doc_id long, text string"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_query_and_sql_agree(spark, tmp_path, name):
    table, rows, schema = CASES[name]
    spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / f"{table}.parquet")
    df = entry_module.queries()[name](spark, str(tmp_path))
    assert df.count() > 0
    assert compare(df, connect(str(tmp_path)), entry_module.oracle_sql()[name]) == []


def test_archives_of_documents_without_text(spark, tmp_path):
    rows = [(2, None), (4, "a nation\nb\nration"), (3, "station")]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    df = entry_module.queries()["S17_grep_archives"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("4.zip", "doc-4.txt", 1), ("4.zip", "doc-4.txt", 3)]
