from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluicework.operators import profile as P
from sluicework.plans import reports as R
from sluicework.sources.store import SCHEMAS

START = datetime(2024, 1, 1)


def runs(spark, rows):
    """Rows are (dataset, day, status, score)."""
    return spark.createDataFrame(
        [(f"{d}{i:03d}", START + timedelta(days=i), d, s, float(q), 1, 3.14159, "x" * 70, 100 + i) for d, i, s, q in rows],
        SCHEMAS["run_history"])


def metrics(spark, rows):
    """Rows are (dataset, day, metric, value)."""
    return spark.createDataFrame(
        [(f"{d}{i:03d}", START + timedelta(days=i), d, m, float(v), 0) for d, i, m, v in rows], SCHEMAS["metric_history"])


def test_history_newest_first_with_limit_and_filter(spark):
    log = runs(spark, [("a", i, "PASSED", 90) for i in range(60)] + [("b", 100, "BLOCKED", 0)])
    rows = R.run_history(log).collect()
    assert len(rows) == 50 and rows[0]["dataset_name"] == "b" and rows[1]["run_id"] == "a059"
    report = R.history_report(log, "a", 2).collect()
    assert [r["Max Z-Score"] for r in report] == [3.14, 3.14] and report[0]["Duration (ms)"] == 159


def test_run_stats(spark):
    log = runs(spark, [("a", 0, "PASSED", 90), ("a", 1, "WARNING", 75), ("a", 2, "BLOCKED", 0), ("a", 3, "PASSED", 100)])
    row = R.run_stats(log).first()
    assert (row["total_runs"], row["passed"], row["warnings"], row["blocked"], row["avg_quality"], row["avg_duration_ms"],
            row["pass_rate"]) == (4, 2, 1, 1, 66.3, 102.0, 50.0)


def test_trust_score(spark):
    # 19 runs of 1000 rows and one of 10: only the low one is more than two deviations below the mean
    h = metrics(spark, [("a", i, "row_count", 1000) for i in range(19)] + [("a", 19, "row_count", 10), ("a", 20, "mean_x", 1)])
    log = runs(spark, [("a", 0, "PASSED", 100), ("a", 1, "WARNING", 80)])
    names = spark.createDataFrame([("a",), ("new",)], "dataset_name string")
    got = {r["dataset_name"]: r for r in R.trust_score(names, h, log).collect()}
    history = (21 - 1) / 21 * 100
    assert got["a"]["history_score"] == pytest.approx(history)
    assert got["a"]["trust_score"] == round(history * 0.4 + 60 * 0.35 + 80 * 0.25, 1)
    assert got["new"]["trust_score"] == round(100 * 0.4 + 50 * 0.35 + 100 * 0.25, 1)


def test_high_counts_do_not_lower_trust(spark):
    h = metrics(spark, [("a", i, "row_count", 10) for i in range(19)] + [("a", 19, "row_count", 10000)])
    assert R.history_component(h).first()["history_score"] == 100.0


def test_quality_trend_is_oldest_first(spark):
    log = runs(spark, [("a", i, "PASSED", i) for i in range(15)])
    row = R.quality_trend(log).first()
    assert row["scores"] == [float(i) for i in range(5, 15)] and row["runs"] == 10


def test_freshness_counts_whole_days(spark):
    log = runs(spark, [("a", 0, "PASSED", 1)])
    row = R.freshness(log, START + timedelta(days=2, minutes=5)).first()
    assert row["minutes_since"] == 2 * 1440 + 5 and not row["within_sla"]
    assert R.freshness(log, START + timedelta(minutes=30)).first()["within_sla"]


def test_pipeline_status(spark):
    df = spark.createDataFrame([("PASSED",), ("WARNING",), ("BLOCKED",)], "s string")
    assert [r[0] for r in df.select(R.pipeline_status(F.col("s"))).collect()] == ["OPERATIONAL", "WARNING", "CRITICAL"]


def test_null_rate_matrix(spark):
    h = metrics(spark, [("a", i, "null_rate_email", i / 100) for i in range(12)] + [("a", 11, "row_count", 5), ("a", 11, "null_rate_x", 0.12345)])
    rows = {r["column_name"]: r for r in R.null_rate_matrix(h).collect()}
    assert set(rows) == {"email", "x"}
    assert rows["email"]["run_10"] == 11.0 and rows["email"]["run_1"] == 2.0
    assert rows["x"]["run_10"] == 12.35 and rows["x"]["run_9"] is None


def test_pulse(spark):
    datasets = spark.createDataFrame([("a", "HIGH", "own"), ("b", None, None), ("c", "LOW", "o")], "dataset string, criticality string, owner string")
    log = runs(spark, [("a", 0, "BLOCKED", 10), ("c", 0, "PASSED", 99)])
    rows = {r["dataset"]: r for r in R.pulse(datasets, log).collect()}
    assert rows["a"]["reason"] == "x" * 60 + "..." and rows["a"]["trend"] == [10.0]
    assert (rows["b"]["status"], rows["b"]["criticality"], rows["b"]["owner"], rows["b"]["trend"]) == ("NOT RUN", "UNKNOWN", "Unknown", None)
    assert rows["c"]["reason"] == ""


def test_score_report(dirty, test_contract):
    report = R.score_report(P.profile(P.summarise(dirty, test_contract), test_contract))
    rows = {(r["kind"], r["name"]): (r["score"], r["violations"]) for r in report.collect()}
    assert rows[("column", "crate")] == (60.0, 2) and rows[("check", "Tare Below Gross")] == (20.0, 1)


def test_flow_report(spark):
    consumers = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("n", 0, "z")], "dataset string, position int, consumer string")
    log = runs(spark, [("a", 0, "PASSED", 1), ("a", 1, "BLOCKED", 1)])
    got = {(r["dataset"], r["state"]): r["consumers"] for r in R.flow_report(consumers, log).collect()}
    assert got == {("a", "protected"): 2, ("n", "unknown"): 1}


def test_summary_counts(spark):
    df = spark.createDataFrame([(s,) for s in ("PASSED", "WARNING", "BLOCKED", "ODD", "SKIPPED", "UNCHANGED")], "status string")
    assert R.summary_counts(df).first().asDict() == {"total": 6, "passed": 1, "warning": 1, "blocked": 2, "skipped": 1, "unchanged": 1}
