"""Baselines from metric history and z-scores of new metrics.

History rows are ``run_id, timestamp, dataset_name, metric_name, metric_value, day_of_week``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluicework import fixed_values as fv
from sluicework.functions.stats import by_baseline, pick_baseline, steady_mean, steady_std, z_score
from sluicework.operators import series
from sluicework.operators.joins import lookup_join

SERIES = ["dataset_name", "metric_name"]
ORDER = ["timestamp", "run_id"]


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def as_history(metrics: DataFrame, dataset: Column, timestamp: Column, run_id: Column) -> DataFrame:
    """Metric rows in the layout of the history table."""
    return metrics.select(
        run_id.alias("run_id"), timestamp.alias("timestamp"), dataset.alias("dataset_name"),
        "metric_name", F.col("metric_value").cast("double").alias("metric_value"),
    ).withColumn("day_of_week", weekday(F.col("timestamp")))


def _stats(prefix: str) -> list[Column]:
    v, low, high = "metric_value", "MIN(metric_value)", "MAX(metric_value)"
    return [
        F.count(v).alias(f"{prefix}_n"),
        F.expr(steady_mean(f"AVG({v})", low, high)).alias(f"{prefix}_mean"),
        F.expr(steady_std(f"STDDEV_SAMP({v})", low, high)).alias(f"{prefix}_std"),
    ]


def seasonal_baselines(history: DataFrame) -> DataFrame:
    """Mean, sample deviation and count per series and weekday, over all history."""
    return history.groupBy(*SERIES, "day_of_week").agg(*_stats("seasonal"))


def global_baselines(history: DataFrame, runs: int = fv.RECENT_RUNS) -> DataFrame:
    """The same over the newest ``runs`` points of each series, whatever the weekday."""
    return series.latest(history, SERIES, ORDER, runs).groupBy(*SERIES).agg(*_stats("global"))


def _scored(joined: DataFrame, anomaly_z: float) -> DataFrame:
    given = [c for c in joined.columns if not c.startswith(("seasonal_", "global_"))]
    based = joined.selectExpr("*", f"{pick_baseline('seasonal_n', 'global_n')} AS baseline_type").selectExpr(
        *given, "baseline_type",
        f"{by_baseline('seasonal_mean', 'global_mean')} AS baseline_mean",
        f"{by_baseline('seasonal_std', 'global_std')} AS baseline_std",
        f"{by_baseline('seasonal_n', 'global_n', 'COALESCE(global_n, 0L)')} AS sample_count",
    )
    z = z_score("metric_value", "baseline_mean", "baseline_std", "baseline_type")
    return based.selectExpr("*", f"{z} AS z_score").selectExpr("*", f"abs(z_score) > {anomaly_z}D AS is_anomaly")


def evaluate(metrics: DataFrame, history: DataFrame, anomaly_z: float = fv.ANOMALY_Z) -> DataFrame:
    """Score new metrics against stored history, all datasets and metrics in one job.

    ``metrics`` has the columns of a history row; the baseline is the one of its weekday.
    """
    with_season = lookup_join(metrics, seasonal_baselines(history), [*SERIES, "day_of_week"])
    with_global = lookup_join(with_season, global_baselines(history), SERIES)
    return _scored(with_global, anomaly_z)


def replay(history: DataFrame, anomaly_z: float = fv.ANOMALY_Z,
           slot_seconds: int = series.SLOT_SECONDS, block_rows: int = series.BLOCK_ROWS,
           slot_rows: int = series.SLOT_ROWS) -> DataFrame:
    """Score every point of history against the points before it, as each run would have been."""
    seasonal = series.placed(history.where("metric_value IS NOT NULL"), SERIES, "day_of_week", ORDER, "metric_value", slot_seconds, slot_rows)
    return _scored(series.trailing(seasonal, SERIES, "metric_value", fv.RECENT_RUNS, block_rows), anomaly_z)


def report(scored: DataFrame, anomaly_z: float = fv.ANOMALY_Z) -> DataFrame:
    """Figures rounded to two digits, with the reason and the expected range in words."""
    mean, std, z = F.col("baseline_mean"), F.col("baseline_std"), F.col("z_score")
    reason = (
        F.when(F.col("baseline_type") == "initializing", fv.MSG["z_initializing"])
        .when(F.col("is_anomaly"), F.format_string(fv.MSG["z_anomaly"], z, F.lit(anomaly_z)))
        .otherwise(F.format_string(fv.MSG["z_normal"], z))
    )
    context = F.format_string(fv.MSG["z_context"], mean, std * 3, F.col("metric_value").cast("string"))
    return scored.withColumns({
        "reason": reason,
        "severity": F.when(F.col("is_anomaly"), "CRITICAL"),
        "context": F.when(F.col("is_anomaly"), context),
        "baseline_mean": F.round(mean, 2),
        "baseline_std": F.round(std, 2),
        "z_score": F.round(z, 2),
    })


def run_status(scored: DataFrame) -> DataFrame:
    """Outcome per run: status, number of anomalies and the largest rounded distance."""
    size = F.when(F.col("is_anomaly"), F.abs(F.round("z_score", 2)))
    return scored.groupBy("dataset_name", "run_id").agg(
        F.when(F.bool_or("is_anomaly"), "ANOMALY_DETECTED").otherwise("PASS").alias("anomaly_status"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.coalesce(F.max(size), F.lit(0.0)).alias("max_z"),
    )


def learned_thresholds(scored: DataFrame) -> DataFrame:
    """The baseline each scored metric rested on, in the layout of the baseline table."""
    return scored.where("baseline_type <> 'initializing'").select(
        "dataset_name", "metric_name", "baseline_mean", "baseline_std", "baseline_type",
        F.col("timestamp").alias("last_updated"), F.col("sample_count").cast("int").alias("sample_count"),
    )


def band(history: DataFrame, metric: str, sigmas: float) -> DataFrame:
    """A metric's points with the mean of its series and a band of ``sigmas`` deviations."""
    points = history.where(F.col("metric_name") == metric)
    centre = points.groupBy("dataset_name").agg(*_stats("all"))
    return lookup_join(points, centre, ["dataset_name"]).selectExpr(
        "dataset_name", "timestamp", "run_id", "metric_value AS value", "all_mean AS mean",
        f"all_mean - {sigmas}D * all_std AS lower", f"all_mean + {sigmas}D * all_std AS upper",
    )


def control_band(history: DataFrame, metric: str = "row_count") -> DataFrame:
    """Volume chart: every point with its series' mean and a three-sigma band."""
    return band(history, metric, 3.0)


def drift_band(history: DataFrame, metric: str, points: int = fv.DRIFT_POINTS) -> DataFrame:
    """Drift chart: the oldest points of a metric with their mean and a two-sigma band."""
    oldest = history.where(F.col("metric_name") == metric).withColumn(
        "_age", -F.unix_micros(F.col("timestamp").cast("timestamp")))
    return band(series.latest(oldest, SERIES, ["_age", "run_id"], points), metric, 2.0)
