"""Transforms, masking, discovery, history and streams on small data."""

import pytest
from pyspark.sql import functions as F

from tablewright.functions import masking
from tablewright.functions import transforms as tf
from tablewright.operators import discover as dis
from tablewright.operators import expectations as ex
from tablewright.operators import gates, history
from tablewright.operators.expectations import Expectation
from tablewright.operators.mapping import mask_columns, mask_delimited, mask_fixed_width
from tablewright.operators.profile import numeric_profile, quality_metrics
from tablewright.operators.rules import FieldRule, GroupRule, validate
from tablewright.operators.trailing import with_trailing
from tablewright.sources.layouts import LayoutField
from tablewright.streaming import watch


def apply(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "value, build, want",
    [
        ("12.345", lambda c: tf.numeric_format(c, 8, True, 2), "+0001234"),
        ("-2.5", lambda c: tf.numeric_format(c, 4, True), "-002"),
        ("3.5", lambda c: tf.numeric_format(c, 3), "004"),
        ("123456", lambda c: tf.numeric_format(c, 3), "123456"),
        ("abc", lambda c: tf.numeric_format(c, 3, default_value="ZZZ"), "ZZZ"),
        (None, lambda c: tf.noop(c), ""),
        ("  ", lambda c: tf.default(c, "FB"), "FB"),
        ("0.125", lambda c: tf.scale(c, 1, 2), "0.12"),
        ("7", lambda c: tf.scale(c, 0.5), "3.5"),
        ("abc", lambda c: tf.pad(c, 5, "0", "left"), "00abc"),
        ("abcdef", lambda c: tf.pad(c, 3, "0", "left"), "abcdef"),
        ("abcdef", lambda c: tf.truncate(c, 2, from_end=True), "ef"),
        ("abc", lambda c: tf.fit(c, 2), "ab"),
        ("abc", lambda c: tf.fit(c, 5), "abc  "),
        ("2024-02-30", lambda c: tf.date_preset(c, "CCYYMMDD", "00000000"), "00000000"),
        ("02292024", lambda c: tf.date_preset(c, "MMDDCCYY"), "20240229"),
        (" A ", lambda c: tf.conditional(tf.cond_in(c, ["A", "B"]), tf.constant("in"), tf.constant("out")), "in"),
        (None, lambda c: tf.conditional(tf.cond_eq(c, ""), tf.constant("empty"), tf.constant("full")), "empty"),
    ],
)
def test_transforms(spark, value, build, want):
    assert apply(spark, value, build) == want


def test_masking_is_repeatable_and_keeps_shape(spark):
    names = spark.createDataFrame([("Ann-01 é",), ("BOB",), ("Ann-01 é",)], "v string")
    spec = {"v": {"strategy": "preserve_format"}}
    rows = [r.v for r in mask_columns(names, spec, 5).collect()]
    assert rows[0] == rows[2]
    assert sorted(rows) == sorted(r.v for r in mask_columns(names.repartition(3), spec, 5).collect())
    assert rows[0][0].isupper() and rows[0][1:3].islower() and rows[0][3] == "-" and rows[0][4:6].isdigit() and rows[0][7].islower()
    assert rows != [r.v for r in mask_columns(names, spec, 6).collect()]


def test_mask_lines(spark):
    lines = spark.createDataFrame([("0001SMITH  99tail",), ("",)], "value string")
    layout = [LayoutField("id", 1, 4), LayoutField("name", 5, 7), LayoutField("n", 12, 2)]
    masked = [r.value for r in mask_fixed_width(lines, layout, {"name": {"strategy": "redact"}, "n": {"strategy": "random_range", "min": 1, "max": 9}}).collect()]
    assert masked[0][:11] == "0001       " and masked[0][13:] == "tail" and len(masked[0]) == 17 and masked[1] == ""
    parts = spark.createDataFrame([("1|SMITH|x|extra",), ("2",), ("",)], "value string")
    out = [r.value for r in mask_delimited(parts, ["id", "name", "note"], {"name": {"strategy": "redact"}, "note": {"strategy": "fake_name", "names": ["NORTH", "SOUTH"]}}).collect()]
    assert out[0].startswith("1||") and out[0].endswith("|extra") and out[0].split("|")[2] in ("NORTH", "SOUTH") and out[1:] == ["2"]


def lines_of(spark, **texts):
    rows = [(name, i, line) for name, body in texts.items() for i, line in enumerate(body.split("\n"), 1)]
    return spark.createDataFrame(rows, "file string, line int, content string")


def test_detect_formats(spark):
    lines = lines_of(
        spark, pipe="a|b\nc|d", mixed="a|b\nc|d|e\nf|g", three="a|b\nc|d|e\nf|g|h|i", csv="a,b\nc,d", tsv="a\tb\nc\td", fixed="aaaa\nbbbb\ncccc", blank="\n", ragged="a\nbb\nccc\ndddd",
    )
    got = {r.file: (r.format, r.confidence) for r in dis.detect_format(lines).collect()}
    assert got == {
        "pipe": ("pipe_delimited", 0.95), "mixed": ("pipe_delimited", 0.75), "three": ("unknown", 0.5), "csv": ("csv", 0.9), "tsv": ("tsv", 0.9),
        "fixed": ("fixed_width", 0.85), "ragged": ("unknown", 0.2),
    }


def test_boundaries_and_drift(spark):
    lines = lines_of(spark, f="0001  AB  20240101\n0002  CD  20240102\n0003  E   20240103", blank="   \n   ")
    spans = {(r.file, r.start, r.end) for r in dis.infer_boundaries(lines).collect()}
    assert spans == {("f", 0, 4), ("f", 6, 8), ("f", 10, 18), ("blank", 0, 3)}
    drift = dis.fixed_width_drift(lines, [dis.DeclaredField("id", 1, 4), dis.DeclaredField("code", 5, 2), dis.DeclaredField("day", 19, 8)])
    # Starts 1, 7 and 11 are equally common; the leftmost in reach wins.
    assert {(r.name, r.actual_start, r.severity) for r in drift.collect()} == {("code", 1, "warning"), ("day", 7, "error")}


def test_delimited_drift(spark):
    lines = lines_of(spark, good="id,name\n1,x", missing="id,other\n1,x", numbers="1,2,3")
    rows = {(r.file, r.name, r.reason) for r in dis.delimited_drift(lines, ["id", "name"], ",").collect()}
    assert rows == {("missing", "name", "column_missing"), ("missing", "other", "unexpected_column"), ("numbers", "_column_count", "column_count_mismatch")}
    skipped = dis.drift_report(lines_of(spark, f="a\nb"), {"format": "fixed", "fields": [{"name": "x", "position": 1, "length": 2}]})
    assert [(r.severity, r.reason) for r in skipped.collect()] == [("skipped", "too_short")]


def test_discriminator(spark):
    lines = lines_of(spark, f="HDR1\nDTL2\nDTL3\nDTL4\nHDR5\nDTL6")
    best = dis.best_discriminator(dis.detect_discriminator(lines)).first()
    assert (best.position, best.length, best.confidence) == (1, 3, 1.0)


def test_trailing_window_across_blocks(spark):
    """Frames that cross a block border equal the plain window."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 13).alias("v"))
    small = with_trailing(df, ["k"], ["t"], (-9, 0), {"s": F.sum("v"), "n": F.count("v")}, block_rows=37)
    whole = with_trailing(df, ["k"], ["t"], (-9, 0), {"s": F.sum("v"), "n": F.count("v")})
    expected = {}
    rows = sorted((r.k, r.t, r.v) for r in df.collect())
    for i, (k, t, v) in enumerate(rows):
        window = [x for kk, _, x in rows[max(0, i - 9): i + 1] if kk == k]
        expected[(k, t)] = (sum(window), len(window))
    assert {(r.k, r.t): (r.s, r.n) for r in small.collect()} == expected == {(r.k, r.t): (r.s, r.n) for r in whole.collect()}


def test_history(spark):
    rows = [(i, "s", f"2024-01-{i:02d} 00:00:00", "PASS" if i < 12 else "FAIL", 90.0 if i < 12 else 50.0, 10 if i < 12 else 0, 10, 0 if i < 12 else 60, 100) for i in range(1, 13)]
    runs = spark.createDataFrame(rows, "run_id int, suite_name string, t string, status string, quality_score double, pass_count int, total_count int, invalid_rows int, total_rows int")
    runs = runs.withColumn("run_timestamp", F.col("t").cast("timestamp"))
    alerts = {(r.run_id, r.metric) for r in history.deviation_alerts(runs).collect()}
    assert alerts == {(12, "pass_rate"), (12, "quality_score"), (12, "error_rate")}
    assert history.current_baselines(runs).first().sample_size == 10
    trend = {r.date: r.pass_rate for r in history.daily_trend(runs, "2024-01-13 00:00:00", 7).collect()}
    assert trend["2024-01-12"] == 0.0 and len(trend) == 7
    with pytest.raises(ValueError):
        history.daily_trend(runs, "2024-01-13 00:00:00", 8)


def test_gates_and_loader_logs(spark):
    steps = spark.createDataFrame([("p", 1, "a", True, True), ("p", 2, "b", True, False), ("p", 3, "c", False, True)], "pipeline string, gate_order int, gate string, blocking boolean, passed boolean")
    got = {r.gate: (r.gate_status, r.pipeline_status) for r in gates.gate_status(steps).collect()}
    assert got == {"a": ("passed", "failed"), "b": ("failed", "failed"), "c": ("not_run", "failed")}
    logs = spark.createDataFrame([("x", 1, "  120 Rows successfully loaded."), ("x", 2, "  3 Rows not loaded due to data errors."), ("y", 1, "1 Row successfully loaded.")], "file string, _row long, value string")
    rows = {r.file: (r.rows_loaded, r.rows_rejected, r.status) for r in gates.loader_metrics(logs).collect()}
    assert rows == {"x": (120, 3, "failed"), "y": (1, 0, "passed")}


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, None, 50.0), (2, "z", None)], "id int, s string, n double")
    suite = [Expectation("unique", "id"), Expectation("in_set", "s", values=("a",)), Expectation("between", "n", min=0, max=10, mostly=0.5), Expectation("not_null", "s")]
    got = {(r.expectation_type, r.success, r.unexpected_count) for r in ex.run_suite(df, suite, "t").collect()}
    assert got == {("unique", False, 2), ("in_set", False, 1), ("between", True, 1), ("not_null", False, 1)}


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (4, "y")], "n int, s string")
    m = quality_metrics(df).first()
    assert (m.total_rows, m.unique_rows, m.null_cells, m.completeness_pct, m.uniqueness_pct, m.quality_score) == (4, 3, 2, 75.0, 75.0, 75.0)
    p = numeric_profile(df, ["n"]).first()
    assert (p.min, p.max, p.mean, p.median) == (1.0, 4.0, 2.0, 1.5)


def test_watch_is_once_only(spark, tmp_path):
    schema = "id int, k string"
    target = watch.WatchTarget(str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    rules = [FieldRule("f", "k", "not_null"), GroupRule("u", "unique", ("k",))]
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], schema)
    first.write.mode("append").parquet(str(tmp_path / "in"))
    watch.watch_and_validate(spark, target, rules, "id").awaitTermination()
    spark.createDataFrame([(4, "a"), (5, "")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        watch.watch_and_validate(spark, target, rules, "id").awaitTermination()
    violations, metrics = watch.read_results(spark, target)
    assert sorted((r.rule_id, r.row_number) for r in violations.collect()) == [("f", 3), ("f", 5), ("u", 1), ("u", 2)]
    assert metrics.agg(F.sum("total_rows")).first()[0] == 5
    assert {r.row_number for r in validate(first, rules, "id").collect()} == {1, 2, 3}


@pytest.mark.parametrize("files", [1, 2, None])
def test_watch_across_files_and_batches(spark, tmp_path, files):
    schema = "id int, k string, n string, c string"
    rows = [(1, "a", "1", None), (2, "b", "1", "2"), (3, "a", "2", "x"), (4, None, "9", None), (5, "c", "1", None), (6, "b", "2", "2"), (7, "a", "2", "4"), (8, "d", "1", "1"), (9, "c", "3", None)]
    target = watch.WatchTarget(str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=files)
    keys = ("k",)
    rules = [
        FieldRule("f", "k", "not_null"), GroupRule("u", "unique", keys), GroupRule("s", "sequential", keys, target="n"), GroupRule("g", "group_count", keys, target="c"),
        GroupRule("k", "consistent", keys, target="n"), GroupRule("t", "group_sum", keys, target="n", max=3), GroupRule("p", "unique_composite", ("k", "n")), GroupRule("gone", "unique", ("nowhere",)),
    ]
    for part in (rows[:5], rows[5:8], rows[8:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            watch.watch_and_validate(spark, target, rules, "id", unit="all").awaitTermination()
    got = [tuple(r) for r in watch.landed_violations(spark, target, rules).where("rule_id <> 'gone'").select("rule_id", "row_number", "value", "message").collect()]
    want = [tuple(r) for r in validate(spark.createDataFrame(rows, schema), rules, "id").where("rule_id <> 'gone'").select("rule_id", "row_number", "value", "message").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 15
    states = watch.merge_states(spark, target, rules, str(tmp_path / "merged"))
    assert sorted(r._n for r in states[0].collect()) == [1, 2, 2, 3]


def test_stream_refuses_cross_row_rules(spark):
    with pytest.raises(ValueError):
        watch.stream_violations(spark.readStream.format("rate").load(), [GroupRule("u", "unique", ("value",))], "value")
