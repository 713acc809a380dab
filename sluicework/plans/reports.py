"""Reports over run history, metric history and verdicts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluicework import fixed_values as fv
from sluicework.contracts import Contract
from sluicework.functions.rules import moment
from sluicework.operators import lineage as L
from sluicework.operators.joins import lookup_join
from sluicework.operators.series import latest
from sluicework.session import small_frame

NEWEST = ["timestamp", "run_id"]


def _of(df: DataFrame, dataset: str | None) -> DataFrame:
    return df if dataset is None else df.where(F.col("dataset_name") == dataset)


def run_history(runs: DataFrame, dataset: str | None = None, limit: int = fv.HISTORY_LIMIT) -> DataFrame:
    """The newest runs first; a top-k, not a full sort."""
    return _of(runs, dataset).orderBy(F.desc("timestamp"), F.desc("run_id")).limit(limit)


def history_report(runs: DataFrame, dataset: str | None = None, limit: int = fv.HISTORY_LIMIT) -> DataFrame:
    """Run history with rounded figures under report names."""
    return run_history(runs, dataset, limit).select(
        F.col("timestamp").alias("Timestamp"), F.col("dataset_name").alias("Dataset"),
        F.col("status").alias("Status"), F.round("quality_score", 1).alias("Quality %"),
        F.col("anomaly_count").alias("Anomalies"), F.round("z_score_max", 2).alias("Max Z-Score"),
        F.col("duration_ms").alias("Duration (ms)"), F.col("reason").alias("Reason"),
    )


def metric_history(history: DataFrame, dataset: str | None = None, limit: int = fv.HISTORY_LIMIT) -> DataFrame:
    """The newest raw metrics."""
    order = [F.desc("timestamp"), F.asc("dataset_name"), F.asc("metric_name"), F.desc("run_id")]
    return _of(history, dataset).orderBy(*order).limit(limit).select("timestamp", "dataset_name", "metric_name", "metric_value")


def run_stats(runs: DataFrame) -> DataFrame:
    """Counts by status, averages and pass rate per dataset."""
    passed = F.count_if(F.col("status") == "PASSED")
    return runs.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("total_runs"),
        passed.alias("passed"),
        F.count_if(F.col("status") == "WARNING").alias("warnings"),
        F.count_if(F.col("status") == "BLOCKED").alias("blocked"),
        F.round(F.avg("quality_score"), 1).alias("avg_quality"),
        F.round(F.avg("duration_ms"), 0).alias("avg_duration_ms"),
        F.round(passed / F.count(F.lit(1)) * 100, 0).alias("pass_rate"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each dataset."""
    rest = [c for c in runs.columns if c != "dataset_name"]
    return runs.groupBy("dataset_name").agg(
        F.max_by(F.struct(*rest), F.struct(*NEWEST)).alias("r")).select("dataset_name", "r.*")


def history_component(history: DataFrame) -> DataFrame:
    """Share of runs per dataset whose row count is not far below its mean; a run without one counts as clean."""
    v = F.col("metric_value")
    counts = history.where(F.col("metric_name") == "row_count")
    floor = counts.groupBy("dataset_name").agg((F.avg(v) - 2 * F.stddev_samp(v)).alias("floor"))
    low = lookup_join(counts, floor, ["dataset_name"]).where(v < F.col("floor"))
    low_runs = low.groupBy("dataset_name").agg(F.count_distinct("run_id").alias("low_runs"))
    all_runs = history.groupBy("dataset_name").agg(F.count_distinct("run_id").alias("total_runs"))
    clean = F.col("total_runs") - F.coalesce("low_runs", F.lit(0))
    return all_runs.join(low_runs, "dataset_name", "left").select(
        "dataset_name", "total_runs", F.coalesce("low_runs", F.lit(0)).alias("low_runs"),
        F.greatest(F.lit(0.0), clean / F.col("total_runs") * 100).alias("history_score"),
    )


def trust_score(datasets: DataFrame, history: DataFrame, runs: DataFrame) -> DataFrame:
    """Weighted history, verdict and quality figures of each dataset, from 0 to 100."""
    points = F.coalesce(
        *[F.when(F.col("status") == s, p) for s, p in fv.VERDICT_POINTS.items()], F.lit(fv.VERDICT_POINTS_OTHER))
    w = fv.TRUST_WEIGHTS
    joined = (
        datasets.join(history_component(history), "dataset_name", "left")
        .join(latest_run(runs).select("dataset_name", "status", "quality_score"), "dataset_name", "left")
        .withColumns({
            "history_score": F.coalesce("history_score", F.lit(100.0)),
            "verdict_score": points,
            "quality_score": F.coalesce("quality_score", F.lit(100.0)),
        })
    )
    score = (F.col("history_score") * w["history"] + F.col("verdict_score") * w["verdict"]
             + F.col("quality_score") * w["quality"])
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))
    return joined.select("dataset_name", "history_score", "verdict_score", "quality_score",
                         F.round(clamped, 1).alias("trust_score"))


def quality_trend(runs: DataFrame, n: int = fv.TREND_RUNS) -> DataFrame:
    """Scores of the last ``n`` runs of each dataset, oldest first."""
    recent = latest(runs, ["dataset_name"], NEWEST, n)
    ordered = F.sort_array(F.collect_list(F.struct(*NEWEST, "quality_score")))
    return recent.groupBy("dataset_name").agg(
        F.transform(ordered, lambda r: r["quality_score"]).alias("scores"), F.count(F.lit(1)).alias("runs"))


def pipeline_status(status: Column) -> Column:
    return F.when(status == "PASSED", "OPERATIONAL").when(status == "WARNING", "WARNING").otherwise("CRITICAL")


def freshness(runs: DataFrame, as_of: datetime | Column, sla_minutes: int = fv.FRESHNESS_SLA_MINUTES) -> DataFrame:
    """Minutes since the last run of each dataset, against the agreed limit."""
    minutes = F.timestamp_diff("MINUTE", F.col("last_run").cast("timestamp"), moment(as_of))
    return runs.groupBy("dataset_name").agg(F.max("timestamp").alias("last_run")).withColumns(
        {"minutes_since": minutes, "within_sla": minutes <= sla_minutes})


def null_rate_matrix(history: DataFrame, runs: int = fv.TREND_RUNS) -> DataFrame:
    """Null percentage per column over the last runs of each dataset, newest last.

    ``run_1 … run_n`` are fixed pivot values, so no extra job looks them up.
    """
    rates = history.where(F.col("metric_name").startswith("null_rate_"))
    ranked = latest(rates, ["dataset_name", "metric_name"], NEWEST, runs)
    cells = ranked.select(
        "dataset_name", F.expr("substring(metric_name, 11)").alias("column_name"),
        F.concat(F.lit("run_"), (F.lit(runs + 1) - F.col("_rank")).cast("string")).alias("slot"),
        F.round(F.col("metric_value") * 100, 2).alias("rate"),
    )
    names = [f"run_{i}" for i in range(1, runs + 1)]
    return cells.groupBy("dataset_name", "column_name").pivot("slot", names).agg(F.first("rate"))


def flow_report(consumers: DataFrame, runs: DataFrame) -> DataFrame:
    """Consumers reached, protected or of unknown state, per dataset."""
    status = latest_run(runs).select(F.col("dataset_name").alias("dataset"), "status")
    return L.flow_state(consumers, status).groupBy("dataset", "state").agg(F.count(F.lit(1)).alias("consumers"))


def score_report(profiles: DataFrame) -> DataFrame:
    """Column scores and failed checks of each batch in one long table."""
    column = "named_struct('kind', 'column', 'name', c.column_name, 'score', round(c.quality_score, 2), 'violations', c.violation_count)"
    check = ("named_struct('kind', 'check', 'name', k.name, 'score', "
             "round(try_divide(k.violation_count * 100, k.total_rows), 1), 'violations', k.violation_count)")
    return profiles.selectExpr("batch", f"""inline(concat(
        transform(columns, c -> {column}), transform(filter(checks, k -> NOT k.passed), k -> {check})))""")


CATALOGUE = (
    "dataset string, contract_path string, column_count int, columns array<string>, has_quality_rules boolean, "
    "has_anomaly_thresholds boolean, lifecycle string, owner string, domain string, version string, error string"
)


def catalogue(spark: SparkSession, contracts: list[Contract], consumers: DataFrame) -> DataFrame:
    """One row per contract with the criticality its consumers give it."""
    rows = [
        (k.dataset, k.path, len(k.columns), [c.name for c in k.columns], bool(k.checks), bool(k.thresholds),
         "error" if k.error else k.info.get("lifecycle", "active"), k.info.get("owner", "Unknown"),
         k.info.get("domain", "Unknown"), str(k.info.get("version", "0.0.0")), k.error)
        for k in contracts
    ]
    listed = small_frame(spark, rows, CATALOGUE)
    known = L.impact(listed, consumers)
    return known.withColumn(
        "criticality", F.when(F.col("lifecycle") == "error", "UNKNOWN").otherwise(F.col("criticality")))


def pulse(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Status, shortened reason, criticality, owner and score trend of each dataset."""
    last = latest_run(runs).select(F.col("dataset_name").alias("dataset"), "status", "reason")
    trend = quality_trend(runs).select(F.col("dataset_name").alias("dataset"), F.col("scores").alias("trend"))
    n = fv.PULSE_REASON_CHARS
    short = F.when(F.length("reason") > n, F.concat(F.substring("reason", 1, n), F.lit("..."))).otherwise(F.col("reason"))
    quiet = F.coalesce("status", F.lit("NOT RUN")).isin("PASSED", "NOT RUN")
    return datasets.join(last, "dataset", "left").join(trend, "dataset", "left").select(
        "dataset",
        F.coalesce("status", F.lit("NOT RUN")).alias("status"),
        F.when(quiet, "").otherwise(short).alias("reason"),
        F.coalesce("criticality", F.lit("UNKNOWN")).alias("criticality"),
        F.coalesce("owner", F.lit("Unknown")).alias("owner"),
        "trend",
    )


def summary_counts(results: DataFrame) -> DataFrame:
    """Totals of one evaluation of all datasets."""
    s = F.col("status")
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "PASSED").alias("passed"),
        F.count_if(s == "WARNING").alias("warning"),
        F.count_if(~s.isin("PASSED", "WARNING", "SKIPPED", "UNCHANGED")).alias("blocked"),
        F.count_if(s == "SKIPPED").alias("skipped"),
        F.count_if(s == "UNCHANGED").alias("unchanged"),
    )
