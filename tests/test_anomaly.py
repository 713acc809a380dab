import math
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluicework.operators import anomaly as A
from sluicework.sources.store import SCHEMAS

HISTORY = SCHEMAS["metric_history"]
START = datetime(2024, 1, 1)  # a Monday


def history(spark, rows):
    """Rows are (dataset, metric, time, run, value)."""
    return spark.createDataFrame(
        [(run, at, d, m, float(v), at.weekday()) for d, m, at, run, v in rows], HISTORY)


def brute(points):
    """Baseline of each point of one series from the points before it, in plain Python."""
    out = {}
    ordered = sorted(points, key=lambda p: (p[0], p[1]))
    for i, (at, run, value) in enumerate(ordered):
        past = ordered[:i]
        season = [v for t, _, v in past if t.weekday() == at.weekday()]
        recent = [v for _, _, v in past[-30:]]
        kind, base = ("seasonal", season) if len(season) >= 3 else ("global", recent) if len(recent) >= 3 else ("initializing", None)
        if base is None:
            out[run] = (kind, 0.0)
            continue
        constant = min(base) == max(base)
        mean = base[0] if constant else statistics.fmean(base)
        std = 0.0 if constant else statistics.stdev(base)
        z = (0.0 if value == mean else math.copysign(10.0, value - mean)) if std == 0 else (value - mean) / std
        out[run] = (kind, z)
    return out


@pytest.mark.parametrize("slot_seconds, block_rows", [(86400, 8192), (3600, 30), (7 * 86400, 31), (600, 64)])
def test_replay_matches_brute_force(spark, slot_seconds, block_rows):
    rows = []
    for i in range(900):  # one hot series with many points per day and equal timestamps
        rows.append(("hot", "row_count", START + timedelta(minutes=47 * (i // 2)), f"h{i:04d}", 1e6 + (i * 7919) % 101))
    for i in range(40):
        rows.append(("daily", "mean_x", START + timedelta(days=i), f"d{i:02d}", (i * 37) % 11))
    for i in range(40):
        rows.append(("flat", "null_rate_x", START + timedelta(days=i), f"f{i:02d}", 0.1 if i < 35 else 0.2))
    got = {r["run_id"]: (r["baseline_type"], r["z_score"])
           for r in A.replay(history(spark, rows), slot_seconds=slot_seconds, block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    for d in ("hot", "daily", "flat"):
        for run, (kind, z) in brute([(at, run, v) for ds, _, at, run, v in rows if ds == d]).items():
            assert got[run][0] == kind
            assert got[run][1] == pytest.approx(z, abs=1e-6), run


def test_replay_covers_all_baseline_types(spark):
    rows = [("d", "row_count", START + timedelta(days=i), f"r{i:02d}", 300 + i % 5) for i in range(30)]
    kinds = [r["baseline_type"] for r in A.replay(history(spark, rows)).orderBy("timestamp").collect()]
    assert kinds == ["initializing"] * 3 + ["global"] * 18 + ["seasonal"] * 9


def test_null_drift_against_constant_history(spark):
    rows = [("t", "null_rate_email", START + timedelta(days=i), f"r{i}", 0.0) for i in range(10)]
    new = history(spark, [("t", "null_rate_email", START + timedelta(days=20), "n", 0.2)])
    row = A.report(A.evaluate(new, history(spark, rows))).first()
    assert row["z_score"] == 10.0 and row["is_anomaly"] and row["baseline_type"] == "global"
    assert row["reason"] == "CRITICAL ANOMALY: Z-Score 10.00 > 3.0"
    assert row["context"] == "Expected 0.00 ±0.00, got 0.2" and row["severity"] == "CRITICAL"


def test_volume_drop_and_unchanged_constant(spark):
    rows = [("t", "row_count", START + timedelta(days=i), f"r{i}", 100) for i in range(10)]
    new = history(spark, [("t", "row_count", START + timedelta(days=20), "low", 5), ("t", "row_count", START + timedelta(days=20), "same", 100)])
    z = {r["run_id"]: r["z_score"] for r in A.evaluate(new, history(spark, rows)).collect()}
    assert z == {"low": -10.0, "same": 0.0}


def test_constant_history_of_inexact_values_is_no_anomaly(spark):
    rows = [("t", "m", START + timedelta(days=i), f"r{i}", 0.1) for i in range(30)]
    new = history(spark, [("t", "m", START + timedelta(days=31), "n", 0.1)])
    assert A.evaluate(new, history(spark, rows)).first()["z_score"] == 0.0


def test_cold_start(spark):
    rows = [("t", "m", START + timedelta(days=i), f"r{i}", i) for i in range(2)]
    new = history(spark, [("t", "m", START + timedelta(days=9), "n", 99), ("new", "m", START, "x", 1)])
    got = A.report(A.evaluate(new, history(spark, rows))).collect()
    assert {(r["baseline_type"], r["z_score"], r["is_anomaly"]) for r in got} == {("initializing", 0.0, False)}
    assert got[0]["reason"] == "Baseline Initializing (insufficient history)"


def test_seasonal_beats_global(spark):
    rows = [("t", "m", START + timedelta(days=i), f"r{i}", 100 if i % 7 == 0 else 10 + i % 3) for i in range(28)]
    new = history(spark, [("t", "m", START + timedelta(days=28), "n", 100)])
    row = A.evaluate(new, history(spark, rows)).first()
    assert (row["baseline_type"], row["baseline_mean"], row["z_score"]) == ("seasonal", 100.0, 0.0)


def test_global_uses_last_thirty(spark):
    rows = [("t", "m", START + timedelta(hours=i), f"r{i:03d}", 1000 if i < 70 else i) for i in range(100)]
    row = A.global_baselines(history(spark, rows)).first()
    assert row["global_n"] == 30 and row["global_mean"] == pytest.approx(84.5)


def test_threshold_is_strict_and_a_parameter(spark):
    rows = [("t", "m", START + timedelta(hours=i), f"r{i}", v) for i, v in enumerate([1, 2, 3])]
    new = history(spark, [("t", "m", START + timedelta(days=1), "n", 5)])  # z = 3 exactly
    assert not A.evaluate(new, history(spark, rows)).first()["is_anomaly"]
    assert A.evaluate(new, history(spark, rows), anomaly_z=2.5).first()["is_anomaly"]


def test_run_status_rounds_before_the_largest(spark):
    scored = spark.createDataFrame(
        [("d", "r", 3.004, True), ("d", "r", -3.001, True), ("d", "r", 2.9, False), ("d", "q", 0.5, False)],
        "dataset_name string, run_id string, z_score double, is_anomaly boolean")
    got = {r["run_id"]: (r["anomaly_status"], r["anomaly_count"], r["max_z"]) for r in A.run_status(scored).collect()}
    assert got == {"r": ("ANOMALY_DETECTED", 2, 3.0), "q": ("PASS", 0, 0.0)}


def test_bands(spark):
    rows = [("t", "row_count", START + timedelta(days=i), f"r{i:03d}", i) for i in range(120)]
    h = history(spark, rows)
    values = list(range(120))
    c = A.control_band(h).first()
    assert c["mean"] == pytest.approx(59.5) and c["upper"] == pytest.approx(59.5 + 3 * statistics.stdev(values))
    d = A.drift_band(h, "row_count")
    assert d.count() == 100 and d.agg(F.max("value")).first()[0] == 99.0
    assert d.first()["lower"] == pytest.approx(49.5 - 2 * statistics.stdev(values[:100]))


def test_a_busy_slot_is_cut(spark):
    """All points of a series in one day, most of them in one minute: slots are many, statistics the same."""
    from sluicework.operators import series
    points = spark.range(4000).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("run_id"),
        F.timestamp_seconds(F.lit(978307200) + F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.col("id") % 60)).alias("timestamp"),
        F.lit("d").alias("dataset_name"), F.lit("m").alias("metric_name"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("metric_value"),
        F.lit(0).alias("day_of_week"))
    slots = series.slotted(points, ["dataset_name", "metric_name"], "timestamp", 86400, slot_rows=500).groupBy("_slot").count().collect()
    assert len(slots) > 30 and max(r["count"] for r in slots) < 400
    columns = ["run_id", "baseline_mean", "baseline_std", "sample_count"]
    whole, cut = (sorted(map(tuple, A.replay(points, slot_rows=n).select(*columns).collect())) for n in (10**6, 500))
    assert len(cut) == 4000 and [(r[0], r[3]) for r in whole] == [(r[0], r[3]) for r in cut]
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(whole, cut) for k in (1, 2))


def test_sketches_of_days_give_the_month(spark):
    from sluicework.operators import sketches
    df = spark.range(20000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3001).alias("a"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("b"),
                                   (F.col("id") % 11 / 4).alias("c"))
    daily = sketches.distinct_sketches(df, ["a", "b", "c"], "day")
    assert daily.count() == 21
    got = {r["column_name"]: (r["filled"], r["unique_estimate"]) for r in sketches.merged(daily).collect()}
    assert got["b"] == (10000, 1) and got["c"] == (20000, 11) and abs(got["a"][1] - 3001) <= sketches.ERROR_BOUND * 3001
