"""Catalogue checks on packed rows: what is shuffled, and equal results for both forms."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tablewright.operators import catalogue as cat
from tablewright.plans import catalogue_queries as cq

ON_WORDS = ("H01_schema_missing", "H02_schema_unexpected", "H03_schema_check", "P02_unmapped_columns", "H04_structure_compatible", "E01_columns_match_ordered_list",
            "N01_contract_columns", "N02_contract_types", "N03_contract_nullability", "N06_contract_date_format")


@pytest.mark.parametrize("name", ON_WORDS)
def test_words_are_not_shuffled_one_by_one(spark, name):
    plan = entry_module.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any("column_name" in k for k in keys)


@pytest.mark.parametrize("name", [n for n in ON_WORDS if n != "H04_structure_compatible"])
def test_rows_stay_where_their_dataset_put_them(spark, name):
    plan = entry_module.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # One exchange for each side of the join, of lines; none of lists of words.
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan parquet") == 2


CHECKS = {
    "missing": lambda c, s: cat.schema_missing(c, s), "unexpected": lambda c, s: cat.schema_unexpected(c, s), "both": lambda c, s: cat.unmapped_columns(c, s),
    "check": lambda c, s: cat.schema_check(c, s), "columns": lambda c, s: cat.contract_columns(c, s), "types": lambda c, s: cat.contract_types(c, s),
    "nulls": lambda c, s: cat.contract_nullability(c, s), "dates": lambda c, s: cat.contract_date_format(c, s),
}


@pytest.mark.parametrize("check", sorted(CHECKS))
def test_packed_and_long_agree(spark, check):
    long_c = spark.createDataFrame(
        [("a", "x", 1, "NUMBER", True), ("a", "y", 2, "DATE", False), ("b", "x", 1, "CLOB", False), ("c", "z", 1, "BLOB", True), (None, "x", 1, "DATE", True)],
        "dataset string, column_name string, ordinal int, type string, nullable boolean")
    long_s = spark.createDataFrame(
        [("a", "x", True, "string", None), ("a", "w", None, "date", "HH"), ("a", "y", True, "date", "HH24"), ("b", "x", False, None, None), ("d", "q", True, "date", None), (None, "x", True, "date", None)],
        "dataset string, column_name string, required boolean, data_type string, date_format string")

    def one_row(df):
        fields = [c for c in df.columns if c != "dataset"]
        return cat.packed(df, *fields)

    long_rows = sorted(map(str, CHECKS[check](long_c, long_s).collect()))
    assert long_rows and long_rows == sorted(map(str, CHECKS[check](one_row(long_c), one_row(long_s)).collect()))


def test_lines_of_one_dataset_meet(spark):
    class Tables:
        documents = spark.createDataFrame([(1, "b a  b\n \nq"), (1, "a c b"), (2, None), (2, "")], "doc_id long, text string")

    rows = cq.catalogue(Tables).select("dataset", F.inline(F.arrays_zip("column_name", "ordinal"))).collect()
    assert sorted(map(tuple, rows)) == [(100001, "a", 1), (100001, "b", 1), (100001, "c", 2), (100003, "q", 1)]


def test_least_places_of_many_lines(spark):
    class Tables:
        documents = spark.createDataFrame([(1, "c b a"), (1, " a"), (1, "b  c d d")], "doc_id long, text string")

    rows = cq.catalogue(Tables).select("dataset", F.inline(F.arrays_zip("column_name", "ordinal", "nullable"))).collect()
    assert sorted(map(tuple, rows)) == [(100001, "a", 2, True), (100001, "b", 1, True), (100001, "c", 1, True), (100001, "d", 4, True)]
