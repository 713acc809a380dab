"""Metric, baseline, anomaly and band queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluicework.contracts import Contract
from sluicework.operators import anomaly, profile as P, sketches
from sluicework.session import durable, fresh_folder
from sluicework.sources.store import Store, latest_baselines
from sluicework.workloads.common import REPLAY_SQL, SHIPPING_SQL, query, shipping_history, table


@query("batch_metrics", """
WITH d AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, COUNT(*) AS n, AVG(event_id) AS m1, AVG(user_id) AS m2,
         COUNT(NULLIF(event_type, 'error')) AS c3, COUNT(v) AS c4, AVG(v) AS m4, COUNT(props) AS c5
  FROM (SELECT *, CASE WHEN value >= 1 THEN value END AS v FROM events) GROUP BY 1)
SELECT batch, metric_name, ROUND(metric_value, 6) AS metric_value FROM (
  SELECT batch, 'row_count' AS metric_name, CAST(n AS DOUBLE) AS metric_value FROM d
  UNION ALL SELECT batch, 'null_rate_event_id', 0.0 FROM d UNION ALL SELECT batch, 'mean_event_id', m1 FROM d
  UNION ALL SELECT batch, 'null_rate_ts', 0.0 FROM d
  UNION ALL SELECT batch, 'null_rate_user_id', 0.0 FROM d UNION ALL SELECT batch, 'mean_user_id', m2 FROM d
  UNION ALL SELECT batch, 'null_rate_event_type', (n - c3) / CAST(n AS DOUBLE) FROM d
  UNION ALL SELECT batch, 'null_rate_value', (n - c4) / CAST(n AS DOUBLE) FROM d UNION ALL SELECT batch, 'mean_value', m4 FROM d
  UNION ALL SELECT batch, 'null_rate_props', (n - c5) / CAST(n AS DOUBLE) FROM d)
WHERE metric_value IS NOT NULL""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumns({
        "event_type": F.nullif("event_type", F.lit("error")), "value": F.when(F.col("value") >= 1, F.col("value"))})
    summary = P.summarise(df, Contract("events"), F.to_date("ts"), distinct="none")
    return P.metric_rows(summary).select("batch", "metric_name", F.round("metric_value", 6).alias("metric_value"))


def _rounded(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_{c}": F.round(f"{prefix}_{c}", 4) for c in ("mean", "std")})


def _stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping history as a table: a replay reads it several times."""
    return durable(shipping_history(spark, sf_dir), fresh_folder(spark))


def _off_ties(name: str) -> Column:
    """A figure to four digits; means of round values often end in a five, where engines differ in the last bit."""
    return F.round(F.col(name) + 1e-9, 4).alias(name)


_STATS = """COUNT(*) AS {p}_n, ROUND(CASE WHEN MIN(metric_value) = MAX(metric_value) THEN MIN(metric_value) ELSE AVG(metric_value) END, 4) AS {p}_mean,
  ROUND(CASE WHEN MIN(metric_value) = MAX(metric_value) THEN 0.0 ELSE STDDEV_SAMP(metric_value) END, 4) AS {p}_std"""


@query("seasonal_baseline", f"""WITH {SHIPPING_SQL}
SELECT dataset_name, metric_name, day_of_week, {_STATS.format(p='seasonal')} FROM history GROUP BY 1, 2, 3""")
def seasonal_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(anomaly.seasonal_baselines(shipping_history(spark, sf_dir)), "seasonal")


@query("global_baseline", f"""WITH {SHIPPING_SQL},
recent AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name, metric_name ORDER BY ts DESC, run_id DESC) AS r FROM history)
SELECT dataset_name, metric_name, {_STATS.format(p='global')} FROM recent WHERE r <= 30 GROUP BY 1, 2""")
def global_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(anomaly.global_baselines(shipping_history(spark, sf_dir)), "global")


@query("anomaly_scores", f"""WITH {REPLAY_SQL}
SELECT run_id, dataset_name, metric_name, baseline_type,
  ROUND(metric_value + 1e-9, 4) AS metric_value, ROUND(baseline_mean + 1e-9, 4) AS baseline_mean, ROUND(baseline_std + 1e-9, 4) AS baseline_std, ROUND(z, 4) AS z_score, abs(z) > 3.0 AS is_anomaly
FROM scored""")
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.replay(_stored_history(spark, sf_dir)).select(
        "run_id", "dataset_name", "metric_name", "baseline_type",
        *[_off_ties(c) for c in ("metric_value", "baseline_mean", "baseline_std")], F.round("z_score", 4).alias("z_score"), "is_anomaly")


@query("anomaly_report", f"""WITH {REPLAY_SQL}
SELECT run_id, metric_name, 'CRITICAL' AS severity, ROUND(z, 2) AS z_score,
  'CRITICAL ANOMALY: Z-Score ' || printf('%.2f', z) || ' > 3.0' AS reason,
  ROUND(baseline_mean, 2) AS baseline_mean, ROUND(baseline_std, 2) AS baseline_std,
  'Expected ' || printf('%.2f', ROUND(baseline_mean, 2)) || ' ±' || printf('%.2f', ROUND(3 * baseline_std, 2)) || ', got '
    || printf('%.4f', ROUND(metric_value, 4)) AS context
FROM scored WHERE abs(z) > 3.0""")
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomaly.report(anomaly.replay(_stored_history(spark, sf_dir))).where("is_anomaly")
    value = F.format_string("%.4f", F.round("metric_value", 4))  # the engines write out a double in different ways
    return found.select("run_id", "metric_name", "severity", "z_score", "reason", "baseline_mean", "baseline_std",
                        F.concat(F.regexp_extract("context", r"^(.*, got )", 1), value).alias("context"))


@query("run_anomaly_status", f"""WITH {REPLAY_SQL}
SELECT dataset_name, run_id, CASE WHEN bool_or(abs(z) > 3.0) THEN 'ANOMALY_DETECTED' ELSE 'PASS' END AS anomaly_status,
  COUNT(*) FILTER (WHERE abs(z) > 3.0) AS anomaly_count,
  COALESCE(MAX(abs(ROUND(z, 2))) FILTER (WHERE abs(z) > 3.0), 0.0) AS max_z
FROM scored GROUP BY 1, 2""")
def run_anomaly_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.run_status(anomaly.replay(_stored_history(spark, sf_dir)))


@query("evaluate_against_history", f"""WITH {SHIPPING_SQL},
past AS (SELECT * FROM history WHERE ts < TIMESTAMP '2001-01-01'), fresh AS (SELECT * FROM history WHERE ts >= TIMESTAMP '2001-01-01'),
s AS (SELECT dataset_name, metric_name, day_of_week, COUNT(*) AS n, AVG(metric_value) AS m, STDDEV_SAMP(metric_value) AS sd,
  MIN(metric_value) AS lo, MAX(metric_value) AS hi FROM past GROUP BY 1, 2, 3),
g AS (SELECT dataset_name, metric_name, COUNT(*) AS n, AVG(metric_value) AS m, STDDEV_SAMP(metric_value) AS sd,
  MIN(metric_value) AS lo, MAX(metric_value) AS hi FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name, metric_name ORDER BY ts DESC, run_id DESC) AS r FROM past) WHERE r <= 30 GROUP BY 1, 2),
b AS (SELECT f.*, CASE WHEN s.n >= 3 THEN 'seasonal' WHEN g.n >= 3 THEN 'global' ELSE 'initializing' END AS baseline_type,
  CASE WHEN s.n >= 3 THEN CASE WHEN s.lo = s.hi THEN s.lo ELSE s.m END WHEN g.n >= 3 THEN CASE WHEN g.lo = g.hi THEN g.lo ELSE g.m END ELSE 0.0 END AS mean,
  CASE WHEN s.n >= 3 THEN CASE WHEN s.lo = s.hi THEN 0.0 ELSE s.sd END WHEN g.n >= 3 THEN CASE WHEN g.lo = g.hi THEN 0.0 ELSE g.sd END ELSE 0.0 END AS std
  FROM fresh f LEFT JOIN s USING (dataset_name, metric_name, day_of_week) LEFT JOIN g USING (dataset_name, metric_name)),
z AS (SELECT *, CASE WHEN baseline_type = 'initializing' THEN 0.0 WHEN std = 0 THEN CASE WHEN metric_value = mean THEN 0.0 WHEN metric_value > mean THEN 10.0 ELSE -10.0 END
  ELSE (metric_value - mean) / std END AS z FROM b)
SELECT run_id, metric_name, baseline_type, ROUND(mean + 1e-9, 4) AS baseline_mean, ROUND(std + 1e-9, 4) AS baseline_std, ROUND(z, 4) AS z_score,
  abs(z) > 3.0 AS is_anomaly FROM z""")
def evaluate_against_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _stored_history(spark, sf_dir)
    cut = F.lit("2001-01-01").cast("timestamp")
    scored = anomaly.evaluate(history.where(F.col("timestamp") >= cut), history.where(F.col("timestamp") < cut))
    return scored.select("run_id", "metric_name", "baseline_type",
                         *[_off_ties(c) for c in ("baseline_mean", "baseline_std")], F.round("z_score", 4).alias("z_score"), "is_anomaly")


def _band_rows(df: DataFrame) -> DataFrame:
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return df.select("dataset_name", "run_id", outside.alias("outside"),
                     *[_off_ties(c) for c in ("value", "mean", "lower", "upper")])


@query("control_band", f"""WITH {SHIPPING_SQL},
c AS (SELECT dataset_name, AVG(metric_value) AS m, STDDEV_SAMP(metric_value) AS sd FROM history WHERE metric_name = 'row_count' GROUP BY 1)
SELECT dataset_name, run_id, metric_value < m - 3 * sd OR metric_value > m + 3 * sd AS outside, ROUND(metric_value + 1e-9, 4) AS value, ROUND(m + 1e-9, 4) AS mean, ROUND(m - 3 * sd + 1e-9, 4) AS lower, ROUND(m + 3 * sd + 1e-9, 4) AS upper
FROM history JOIN c USING (dataset_name) WHERE metric_name = 'row_count'""")
def control_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band_rows(anomaly.control_band(shipping_history(spark, sf_dir)))


@query("drift_band", f"""WITH {SHIPPING_SQL},
old AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name ORDER BY ts, run_id) AS r FROM history
  WHERE metric_name = 'mean_l_extendedprice') WHERE r <= 100),
c AS (SELECT dataset_name, AVG(metric_value) AS m, STDDEV_SAMP(metric_value) AS sd FROM old GROUP BY 1)
SELECT dataset_name, run_id, metric_value < m - 2 * sd OR metric_value > m + 2 * sd AS outside, ROUND(metric_value + 1e-9, 4) AS value, ROUND(m + 1e-9, 4) AS mean, ROUND(m - 2 * sd + 1e-9, 4) AS lower, ROUND(m + 2 * sd + 1e-9, 4) AS upper
FROM old JOIN c USING (dataset_name)""")
def drift_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band_rows(anomaly.drift_band(shipping_history(spark, sf_dir), "mean_l_extendedprice"))


@query("latest_baselines", f"""WITH {REPLAY_SQL},
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name, metric_name ORDER BY ts DESC) AS r FROM scored WHERE baseline_type <> 'initializing')
SELECT dataset_name, metric_name, ROUND(baseline_mean, 4) AS baseline_mean, ROUND(baseline_std, 4) AS baseline_std, baseline_type,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS last_updated, CASE WHEN baseline_type = 'seasonal' THEN s_n ELSE g_n END AS sample_count
FROM last WHERE r = 1""")
def latest_baselines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt = anomaly.learned_thresholds(anomaly.replay(_stored_history(spark, sf_dir)))
    return latest_baselines(learnt).select(
        "dataset_name", "metric_name", F.round("baseline_mean", 4).alias("baseline_mean"),
        F.round("baseline_std", 4).alias("baseline_std"), "baseline_type",
        F.to_date("last_updated").cast("string").alias("last_updated"), F.col("sample_count").cast("bigint").alias("sample_count"))


@query("replay_busy_day", """
WITH p AS (
  SELECT o_orderkey, TIMESTAMP '2001-01-01' + to_seconds(CAST(o_custkey % 86400 AS BIGINT)) AS ts, o_totalprice / 1000 AS v FROM orders),
w AS (
  SELECT o_orderkey, COUNT(*) OVER a AS n, AVG(v) OVER a AS sm, STDDEV_SAMP(v) OVER a AS ss, COUNT(*) OVER b AS gn, AVG(v) OVER b AS gm
  FROM p WINDOW a AS (ORDER BY ts, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    b AS (ORDER BY ts, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, n AS sample_count, CASE WHEN n >= 3 THEN ROUND(sm, 2) ELSE 0.0 END AS baseline_mean, CASE WHEN n >= 3 THEN ROUND(ss, 2) ELSE 0.0 END AS baseline_std FROM w""")
def replay_busy_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of one series in one day: the day is cut at quantiles, and no task holds it whole."""
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    points = table(spark, sf_dir, "orders").select(
        key.alias("run_id"), F.timestamp_seconds(F.lit(978307200) + F.col("o_custkey") % 86400).alias("timestamp"), F.lit("orders").alias("dataset_name"),
        F.lit("price").alias("metric_name"), (F.col("o_totalprice") / 1000).alias("metric_value"), F.lit(0).alias("day_of_week"))
    scored = anomaly.replay(durable(points, fresh_folder(spark)), slot_rows=2048)
    return scored.select(F.col("run_id").cast("long").alias("o_orderkey"), "sample_count",
                         *[F.round(c, 2).alias(c) for c in ("baseline_mean", "baseline_std")])


@query("distinct_sketches", """
WITH d AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, l_orderkey, l_partkey FROM lineitem),
u AS (SELECT month, 'l_orderkey' AS column_name, COUNT(l_orderkey) AS filled, COUNT(DISTINCT l_orderkey) AS exact FROM d GROUP BY 1
  UNION ALL SELECT month, 'l_partkey', COUNT(l_partkey), COUNT(DISTINCT l_partkey) FROM d GROUP BY 1)
SELECT month, column_name, filled, exact, TRUE AS within_bound FROM u""")
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of a month from the stored sketches of its days, beside the exact counts."""
    rows = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    store, columns = Store(spark, fresh_folder(spark)), ["l_orderkey", "l_partkey"]
    store.append("distinct_sketches", sketches.distinct_sketches(rows, columns, "day").withColumn("dataset_name", F.lit("lineitem")))
    month = F.to_date(F.trunc(F.to_date("batch"), "month")).alias("month")
    found = sketches.merged(store.read("distinct_sketches", "lineitem").select(month, "column_name", "filled", "sketch"), "month")
    exact = P.distinct_counts(rows.withColumn("month", F.trunc("day", "month")), columns, "month").select(
        F.to_date("batch").alias("month"), "column_name", F.col("unique_count").alias("exact"))
    close = F.abs(F.col("unique_estimate") - F.col("exact")) <= sketches.ERROR_BOUND * F.col("exact")
    return found.join(exact, ["month", "column_name"]).select("month", "column_name", "filled", "exact", close.alias("within_bound"))
