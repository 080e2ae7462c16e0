"""Run history: append, latest runs, trends, summaries, baselines, alerts.

History rows have ``run_id, suite_name, run_timestamp, status, quality_score``
and, for baselines, ``pass_count, total_count, invalid_rows, total_rows``.
"Now" is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.trailing import with_trailing
from tablewright.operators.violations import explode_found

# Trend spans, trend sensitivity, baseline size, alert limits.
TREND_DAYS = (7, 14, 30, 90)
TREND_POINTS = 2.0
BASELINE_RUNS = 10
ALERT_LIMITS = {"pass_rate": 10.0, "quality_score": 5.0, "error_rate": 20.0}


def append_runs(runs: DataFrame, path: str) -> None:
    """Add finished runs (or their tests) to a history table."""
    runs.write.mode("append").parquet(path)


def recent_runs(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.orderBy(F.desc("run_timestamp"), F.desc("run_id")).limit(limit)


def _passed() -> Column:
    return F.coalesce(F.col("status") == "PASS", F.lit(False))


def daily_trend(history: DataFrame, as_of: str, days: int, suite: str | None = None, digits: int = 2) -> DataFrame:
    """Runs, passes, failures (anything but PASS) and mean score per day."""
    if days not in TREND_DAYS:
        raise ValueError(f"days must be one of {TREND_DAYS}, got {days}")
    rows = history.filter(F.col("run_timestamp") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    if suite is not None:
        rows = rows.filter(F.col("suite_name") == suite)
    daily = rows.groupBy(F.date_format("run_timestamp", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(_passed()).alias("pass_runs"), F.count_if(~_passed()).alias("fail_runs"),
        F.round(F.avg("quality_score"), digits).alias("avg_quality_score"),
    )
    return daily.withColumn("pass_rate", F.round(F.col("pass_runs") * 100.0 / F.col("total_runs"), 2).cast("double"))


def suite_summary(history: DataFrame, as_of: str) -> DataFrame:
    """Last status, 30-day pass rate and score, week-on-week direction."""
    now = F.lit(as_of).cast("timestamp")

    def since(days: int) -> Column:
        return F.col("run_timestamp") >= now - F.expr(f"INTERVAL {days} DAYS")

    def rate(scope: Column) -> Column:
        return F.avg(F.when(scope, _passed().cast("int"))) * 100

    per_suite = history.groupBy("suite_name").agg(
        F.max_by(_passed(), F.struct("run_timestamp", "run_id")).alias("last_ok"),
        F.max("run_timestamp").alias("last_run"),
        rate(since(30)).alias("rate30"),
        F.avg(F.when(since(30), F.col("quality_score"))).alias("score30"),
        rate(since(7)).alias("last7"),
        rate(since(14) & ~since(7)).alias("prior7"),
    )
    move = F.col("last7") - F.col("prior7")
    return per_suite.select(
        "suite_name",
        F.when(F.col("last_ok"), "PASS").otherwise("FAIL").alias("last_run_status"),
        F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run_at"),
        F.coalesce(F.round("rate30", 1), F.lit(0.0)).alias("pass_rate_30d"),
        F.round("score30", 1).alias("avg_quality_score"),
        F.when(move > TREND_POINTS, "up").when(move < -TREND_POINTS, "down").otherwise("flat").alias("trend_direction"),
    )


def run_rates(history: DataFrame) -> DataFrame:
    """Pass rate of tests and error rate of rows, 0 for empty runs."""

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) * 100.0 / F.col(whole)).otherwise(F.lit(0.0)).cast("double")

    return history.withColumn("pass_rate", share("pass_count", "total_count")).withColumn("error_rate", share("invalid_rows", "total_rows"))


def _means() -> dict[str, Column]:
    return {
        "base_pass_rate": F.avg("pass_rate"),
        "base_quality_score": F.avg("quality_score"),
        "base_error_rate": F.avg("error_rate"),
        "sample_size": F.count(F.lit(1)),
    }


def rolling_baseline(history: DataFrame) -> DataFrame:
    """Means of each suite's last ten runs, as of each run."""
    return with_trailing(run_rates(history), ["suite_name"], ["run_timestamp", "run_id"], (-(BASELINE_RUNS - 1), 0), _means())


def current_baselines(history: DataFrame) -> DataFrame:
    """The baseline after the latest run of each suite."""
    at_each_run = rolling_baseline(history)
    names = ["base_pass_rate", "base_quality_score", "base_error_rate", "sample_size"]
    latest = F.max_by(F.struct(*names), F.struct("run_timestamp", "run_id"))
    return at_each_run.groupBy("suite_name").agg(latest.alias("b")).select("suite_name", "b.*")


def deviation_alerts(history: DataFrame, limits: dict | None = None, digits: int = 2) -> DataFrame:
    """Runs that fall below, or err above, the ten runs before them."""
    limits = {**ALERT_LIMITS, **(limits or {})}
    rated = with_trailing(run_rates(history), ["suite_name"], ["run_timestamp", "run_id"], (-BASELINE_RUNS, -1), _means())
    # The rate of a finished run counts rows, the baseline counts tests.
    current = {
        "pass_rate": F.when(F.col("total_rows") > 0, (1 - F.col("invalid_rows") / F.col("total_rows")) * 100)
        .otherwise(F.when(_passed(), F.lit(100.0)).otherwise(F.lit(0.0))),
        "quality_score": F.col("quality_score").cast("double"),
        "error_rate": F.col("error_rate"),
    }
    entries = []
    for metric, value in current.items():
        base = F.col(f"base_{metric}")
        delta = value - base
        broken = delta > limits[metric] if metric == "error_rate" else delta < -limits[metric]
        entries.append(
            F.when(
                broken,
                F.struct(
                    F.lit(metric).alias("metric"), F.round(base, digits).alias("baseline_value"), F.round(value, digits).alias("current_value"),
                    F.round(delta, digits).alias("delta"), F.lit(float(limits[metric])).alias("threshold"),
                ),
            )
        )
    return explode_found(rated.filter("sample_size > 0"), ["suite_name", "run_id"], F.array(*entries))
