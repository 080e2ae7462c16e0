"""First fields of headers and trailers are found without sorting the details."""

from tablewright.operators import record_types as rt


def test_details_are_not_sorted_for_first_fields(spark, tmp_path):
    rows = [(1, "header", 0, "A"), (1, "detail", 1, "Q"), (1, "trailer", 9, "Z"), (2, "header", 0, "A"), (2, "trailer", 9, "A"), (3, "detail", 1, "Q")]
    spark.createDataFrame(rows, "batch long, _record_type string, _row long, flag string").write.parquet(f"{tmp_path}/records")
    found = rt.header_trailer_match(spark.read.parquet(f"{tmp_path}/records"), "flag", "flag", batch=["batch"])
    assert [(r.batch, r.value) for r in found.collect()] == [(1, "A vs Z")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("Aggregate"):]
