"""Report, registry and catalogue queries over derived run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework.operators import schema as S
from sluicework.plans import reports as R
from sluicework.sources import landing
from sluicework.sources.store import latest_registry
from sluicework.workloads.common import (
    AS_OF, AS_OF_SQL, CONSUMERS_SQL, CONTRACTS, RUNS_SQL, SHIPPING_SQL, order_runs, part_consumers, query,
    shipping_history, table,
)


def _date(name: str = "timestamp"):
    return F.to_date(name).cast("string")


@query("run_history", f"""WITH {RUNS_SQL}
SELECT run_id, CAST(day AS VARCHAR) AS day, dataset_name, status, ROUND(quality_score, 1) AS quality, anomaly_count AS anomalies,
  ROUND(z_score_max, 2) AS max_z, duration_ms, reason FROM runs ORDER BY ts DESC, run_id DESC LIMIT 50""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_history(order_runs(spark, sf_dir)).select(
        "run_id", _date().alias("day"), "dataset_name", "status", F.round("quality_score", 1).alias("quality"),
        F.col("anomaly_count").alias("anomalies"), F.round("z_score_max", 2).alias("max_z"), "duration_ms", "reason")


@query("history_report", f"""WITH {RUNS_SQL}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "Day", dataset_name AS "Dataset", status AS "Status", ROUND(quality_score, 1) AS "Quality %",
  anomaly_count AS "Anomalies", ROUND(z_score_max, 2) AS "Max Z-Score", duration_ms AS "Duration (ms)", reason AS "Reason"
FROM runs WHERE dataset_name = 'orders_3' ORDER BY ts DESC LIMIT 50""")
def history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = R.history_report(order_runs(spark, sf_dir), "orders_3")
    return report.withColumn("Day", _date("Timestamp")).drop("Timestamp")


@query("run_stats", f"""WITH {RUNS_SQL}
SELECT dataset_name, COUNT(*) AS total_runs, COUNT(*) FILTER (WHERE status = 'PASSED') AS passed, COUNT(*) FILTER (WHERE status = 'WARNING') AS warnings,
  COUNT(*) FILTER (WHERE status = 'BLOCKED') AS blocked, ROUND(AVG(quality_score), 1) AS avg_quality, ROUND(AVG(duration_ms), 0) AS avg_duration_ms,
  ROUND(COUNT(*) FILTER (WHERE status = 'PASSED') / CAST(COUNT(*) AS DOUBLE) * 100, 0) AS pass_rate FROM runs GROUP BY 1""")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_stats(order_runs(spark, sf_dir))


@query("metric_history_newest", f"""WITH {SHIPPING_SQL}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, dataset_name, metric_name, ROUND(metric_value, 4) AS metric_value FROM history
ORDER BY ts DESC, dataset_name, metric_name LIMIT 50""")
def metric_history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metric_history(shipping_history(spark, sf_dir)).select(
        _date().alias("day"), "dataset_name", "metric_name", F.round("metric_value", 4).alias("metric_value"))


_TRUST_SQL = f"""WITH {SHIPPING_SQL}, {RUNS_SQL},
names AS (SELECT DISTINCT 'lineitem_' || l_returnflag AS dataset_name FROM lineitem UNION SELECT DISTINCT 'orders_' || substr(o_orderpriority, 1, 1) FROM orders),
low AS (SELECT dataset_name, AVG(metric_value) - 2 * STDDEV_SAMP(metric_value) AS floor FROM history WHERE metric_name = 'row_count' GROUP BY 1),
lr AS (SELECT h.dataset_name, COUNT(DISTINCT run_id) AS low_runs FROM history h JOIN low USING (dataset_name)
  WHERE metric_name = 'row_count' AND metric_value < floor GROUP BY 1),
hs AS (SELECT dataset_name, COUNT(DISTINCT run_id) AS total FROM history GROUP BY 1),
last AS (SELECT dataset_name, FIRST(status ORDER BY ts DESC, run_id DESC) AS status, FIRST(quality_score ORDER BY ts DESC, run_id DESC) AS q FROM runs GROUP BY 1),
c AS (SELECT dataset_name, CASE WHEN total IS NULL THEN 100.0 ELSE GREATEST(0.0, (total - COALESCE(low_runs, 0)) / CAST(total AS DOUBLE) * 100) END AS h,
  CASE status WHEN 'PASSED' THEN 100e0 WHEN 'WARNING' THEN 60e0 WHEN 'BLOCKED' THEN 10e0 ELSE 50e0 END AS v, COALESCE(q, 100.0) AS q
  FROM names LEFT JOIN hs USING (dataset_name) LEFT JOIN lr USING (dataset_name) LEFT JOIN last USING (dataset_name))
SELECT dataset_name, ROUND(h, 6) AS history_score, v AS verdict_score, ROUND(q, 6) AS quality_score,
  ROUND(LEAST(100.0, GREATEST(0.0, h * 0.40 + v * 0.35 + q * 0.25)), 1) AS trust_score FROM c"""


@query("trust_score", _TRUST_SQL)
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, runs = shipping_history(spark, sf_dir), order_runs(spark, sf_dir)
    names = history.select("dataset_name").union(runs.select("dataset_name")).distinct()
    return R.trust_score(names, history, runs).withColumns(
        {c: F.round(c, 6) for c in ("history_score", "quality_score")})


@query("quality_trend", f"""WITH {RUNS_SQL},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name ORDER BY ts DESC, run_id DESC) AS k FROM runs)
SELECT dataset_name, string_agg(printf('%.3f', quality_score), ',' ORDER BY k DESC) AS scores, COUNT(*) AS runs FROM r WHERE k <= 10 GROUP BY 1""")
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = R.quality_trend(order_runs(spark, sf_dir))
    text = F.transform("scores", lambda s: F.format_string("%.3f", s))
    return trend.select("dataset_name", F.array_join(text, ",").alias("scores"), "runs")


@query("pipeline_freshness", f"""WITH {RUNS_SQL},
l AS (SELECT dataset_name, MAX(ts) AS t, FIRST(status ORDER BY ts DESC, run_id DESC) AS status FROM runs GROUP BY 1)
SELECT dataset_name, CAST(CAST(t AS DATE) AS VARCHAR) AS last_run, CAST(trunc(epoch({AS_OF_SQL} - t) / 60) AS BIGINT) AS minutes_since,
  trunc(epoch({AS_OF_SQL} - t) / 60) <= 30 AS within_sla,
  CASE status WHEN 'PASSED' THEN 'OPERATIONAL' WHEN 'WARNING' THEN 'WARNING' ELSE 'CRITICAL' END AS pipeline FROM l""")
def pipeline_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = order_runs(spark, sf_dir)
    status = R.latest_run(runs).select("dataset_name", R.pipeline_status(F.col("status")).alias("pipeline"))
    return R.freshness(runs, AS_OF).join(status, "dataset_name").select(
        "dataset_name", _date("last_run").alias("last_run"), "minutes_since", "within_sla", "pipeline")


@query("null_rate_matrix", f"""WITH {SHIPPING_SQL},
r AS (SELECT *, 11 - ROW_NUMBER() OVER (PARTITION BY dataset_name, metric_name ORDER BY ts DESC, run_id DESC) AS k FROM history WHERE metric_name LIKE 'null_rate_%')
SELECT dataset_name, substr(metric_name, 11) AS column_name, """ + ", ".join(
    f"MAX(ROUND(metric_value * 100, 2)) FILTER (WHERE k = {i}) AS run_{i}" for i in range(1, 11)
) + " FROM r WHERE k >= 1 GROUP BY 1, 2")
def null_rate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.null_rate_matrix(shipping_history(spark, sf_dir))


def _registry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string")
    return o.select(
        F.concat(F.lit("customer_"), key).alias("dataset_name"), F.concat(F.lit("contracts/"), key).alias("contract_path"),
        F.lit("active").alias("lifecycle"), F.substring("o_orderpriority", 3, 20).alias("criticality"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400)).alias("last_scanned"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("last_status"),
        F.when(F.col("o_totalprice") > 100000, F.floor("o_totalprice").cast("double")).alias("last_file_mtime"))


_REGISTRY_SQL = """
ev AS (
  SELECT 'customer_' || o_custkey AS dataset_name, 'contracts/' || o_custkey AS contract_path, substr(o_orderpriority, 3, 20) AS criticality,
    o_orderdate + to_seconds(o_orderkey % 86400) AS seen, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS st,
    CASE WHEN o_totalprice > 100000 THEN floor(o_totalprice) END AS mt FROM orders),
registry AS (
  SELECT dataset_name, MAX(contract_path) AS contract_path, FIRST(criticality ORDER BY seen DESC, criticality DESC) AS criticality,
    strftime(MAX(seen), '%Y-%m-%d %H:%M:%S') AS last_scanned, FIRST(st ORDER BY seen DESC, st DESC) FILTER (WHERE st IS NOT NULL) AS last_status,
    FIRST(mt ORDER BY seen DESC, mt DESC) FILTER (WHERE mt IS NOT NULL) AS last_file_mtime, COUNT(*) AS scan_count
  FROM ev GROUP BY 1)
"""


@query("dataset_registry", f"""WITH {_REGISTRY_SQL}
SELECT dataset_name, contract_path, criticality, last_scanned, COALESCE(last_status, '') AS last_status, COALESCE(last_file_mtime, -1.0) AS last_file_mtime, scan_count FROM registry""")
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = latest_registry(_registry_events(spark, sf_dir))
    return r.select(
        "dataset_name", "contract_path", "criticality", F.date_format("last_scanned", "yyyy-MM-dd HH:mm:ss").alias("last_scanned"),
        F.coalesce("last_status", F.lit("")).alias("last_status"), F.coalesce("last_file_mtime", F.lit(-1.0)).alias("last_file_mtime"),
        "scan_count")


@query("unchanged_skip", f"""WITH {_REGISTRY_SQL},
files AS (SELECT 'customer_' || o_custkey AS dataset, MAX(floor(o_totalprice)) AS mtime, MAX(o_orderdate) AS modified FROM orders GROUP BY 1)
SELECT f.dataset, f.mtime, COALESCE(abs(f.mtime - r.last_file_mtime) < 0.01, false) AS unchanged,
  epoch({AS_OF_SQL} - f.modified) / 3600 >= 24 AS stale, ROUND(epoch({AS_OF_SQL} - f.modified) / 3600, 4) AS age_hours
FROM files f LEFT JOIN registry r ON f.dataset = r.dataset_name""")
def unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").groupBy(
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("dataset")
    ).agg(F.max(F.floor("o_totalprice").cast("double")).alias("mtime"), F.max("o_orderdate").alias("modified"))
    marked = landing.unchanged(landing.timeliness(files, AS_OF), latest_registry(_registry_events(spark, sf_dir)))
    return marked.select("dataset", "mtime", "unchanged", "stale", F.round("age_hours", 4).alias("age_hours"))


@query("dataset_pulse", f"""WITH {RUNS_SQL},
d AS (SELECT DISTINCT 'orders_' || substr(o_orderpriority, 1, 1) AS dataset, MIN(o_orderpriority) OVER (PARTITION BY substr(o_orderpriority, 1, 1)) AS owner FROM orders
  UNION ALL SELECT DISTINCT 'segment_' || c_mktsegment, c_mktsegment FROM customer),
l AS (SELECT dataset_name AS dataset, FIRST(status ORDER BY ts DESC, run_id DESC) AS status, FIRST(reason ORDER BY ts DESC, run_id DESC) AS reason FROM runs GROUP BY 1),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_name ORDER BY ts DESC, run_id DESC) AS k FROM runs),
t AS (SELECT dataset_name AS dataset, string_agg(printf('%.3f', quality_score), ',' ORDER BY k DESC) AS trend FROM k WHERE k <= 10 GROUP BY 1)
SELECT dataset, COALESCE(status, 'NOT RUN') AS status, CASE WHEN COALESCE(status, 'NOT RUN') IN ('PASSED', 'NOT RUN') THEN ''
  WHEN length(reason) > 60 THEN substr(reason, 1, 60) || '...' ELSE reason END AS reason, 'LOW' AS criticality, owner, COALESCE(trend, '') AS trend
FROM d LEFT JOIN l USING (dataset) LEFT JOIN t USING (dataset)""")
def dataset_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(
        F.concat(F.lit("orders_"), F.substring("o_orderpriority", 1, 1)).alias("dataset")).agg(F.min("o_orderpriority").alias("owner"))
    segments = table(spark, sf_dir, "customer").groupBy(
        F.concat(F.lit("segment_"), F.col("c_mktsegment")).alias("dataset")).agg(F.min("c_mktsegment").alias("owner"))
    datasets = orders.unionByName(segments).withColumn("criticality", F.lit("LOW"))
    text = F.transform("trend", lambda s: F.format_string("%.3f", s))
    return R.pulse(datasets, order_runs(spark, sf_dir)).withColumn(
        "trend", F.coalesce(F.array_join(text, ","), F.lit("")))


_CATALOGUE_ROWS = ", ".join(
    f"('{k.dataset}', {len(k.columns)}, {str(bool(k.checks)).lower()}, '{k.info.get('lifecycle', 'active')}', "
    f"'{k.info.get('owner', 'Unknown')}', '{k.info.get('domain', 'Unknown')}', '{k.info.get('version', '0.0.0')}')"
    for k in CONTRACTS.values())


@query("catalogue", f"""
WITH listed AS (SELECT * FROM (VALUES {_CATALOGUE_ROWS}) AS v(dataset, column_count, has_quality_rules, lifecycle, owner, domain, version)),
cons AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 'orders' WHEN 'A' THEN 'lineitem' ELSE 'events' END AS dataset,
    CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 'CRITICAL' WHEN l_quantity > 30 AND l_returnflag = 'A' THEN 'MEDIUM' ELSE 'LOW' END AS c FROM lineitem),
crit AS (SELECT dataset, FIRST(c ORDER BY CASE c WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC) AS criticality, COUNT(*) AS consumer_count FROM cons GROUP BY 1)
SELECT dataset, column_count, has_quality_rules, lifecycle, owner, domain, version, COALESCE(criticality, 'LOW') AS criticality,
  COALESCE(consumer_count, 0) AS consumer_count FROM listed LEFT JOIN crit USING (dataset)""")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    consumers = table(spark, sf_dir, "lineitem").select(
        F.when(flag == "R", "orders").when(flag == "A", "lineitem").otherwise("events").alias("dataset"),
        F.col("l_linenumber").cast("int").alias("position"),
        F.when((flag == "R") & (quantity > 49), "CRITICAL").when((quantity > 30) & (flag == "A"), "MEDIUM")
        .otherwise("LOW").alias("criticality"))
    return R.catalogue(spark, list(CONTRACTS.values()), consumers).select(
        "dataset", "column_count", "has_quality_rules", "lifecycle", "owner", "domain", "version", "criticality", "consumer_count")


_SNAP_SQL = """
snap AS (SELECT c_mktsegment AS dataset, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS version, 'nation_' || c_nationkey AS column_name,
  MIN(o_orderstatus) AS data_type FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("dataset"), month.alias("version"),
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("column_name"),
    ).agg(F.min("o_orderstatus").alias("data_type"))


@query("schema_change_log", f"""WITH {_SNAP_SQL},
steps AS (SELECT dataset, version, LAG(version) OVER (PARTITION BY dataset ORDER BY version) AS prev FROM (SELECT DISTINCT dataset, version FROM snap)),
n AS (SELECT s.dataset, s.version, column_name, data_type AS nt FROM snap s JOIN steps USING (dataset, version) WHERE prev IS NOT NULL),
o AS (SELECT s.dataset, st.version, column_name, data_type AS ot FROM snap s JOIN steps st ON s.dataset = st.dataset AND s.version = st.prev),
j AS (SELECT COALESCE(o.dataset, n.dataset) AS dataset, COALESCE(o.version, n.version) AS version, COALESCE(o.column_name, n.column_name) AS column_name,
  COALESCE(ot, '') AS old_type, COALESCE(nt, '') AS new_type, CASE WHEN ot IS NULL THEN 'added' WHEN nt IS NULL THEN 'removed' WHEN ot <> nt THEN 'retyped' END AS change
  FROM o FULL OUTER JOIN n ON o.dataset = n.dataset AND o.version = n.version AND o.column_name = n.column_name)
SELECT * FROM j WHERE change IS NOT NULL""")
def schema_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.change_log(_snapshots(spark, sf_dir)).withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("old_type", "new_type")})


@query("contract_evolution_guard", f"""WITH {_SNAP_SQL},
steps AS (SELECT dataset, version, LEAD(version) OVER (PARTITION BY dataset ORDER BY version) AS next FROM (SELECT DISTINCT dataset, version FROM snap)),
old AS (SELECT s.dataset, st.next AS version, s.column_name FROM snap s JOIN steps st ON s.dataset = st.dataset AND s.version = st.version WHERE st.next IS NOT NULL)
SELECT o.dataset, o.version, COUNT(*) FILTER (WHERE n.dataset IS NULL) AS removed_columns, COUNT(*) FILTER (WHERE n.dataset IS NULL) = 0 AS accepted
FROM old o LEFT JOIN snap n ON o.dataset = n.dataset AND o.version = n.version AND o.column_name = n.column_name GROUP BY 1, 2""")
def contract_evolution_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version against the one before it."""
    return S.evolution(_snapshots(spark, sf_dir))


@query("flow_report", f"""WITH {CONSUMERS_SQL},
r AS (SELECT 'part_' || l_partkey AS dataset, FIRST(CASE WHEN l_quantity > 25 THEN 'PASSED' WHEN l_quantity > 10 THEN 'BLOCKED' ELSE 'SKIPPED' END ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS status
  FROM lineitem GROUP BY 1)
SELECT c.dataset, CASE status WHEN 'PASSED' THEN 'reached' WHEN 'BLOCKED' THEN 'protected' ELSE 'unknown' END AS state, COUNT(*) AS consumers
FROM consumers c LEFT JOIN r USING (dataset) GROUP BY 1, 2""")
def flow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.struct("l_orderkey", "l_linenumber", "l_quantity")
    runs = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("dataset_name"),
        F.col("l_shipdate").alias("timestamp"), run.alias("run_id"),
        F.when(F.col("l_quantity") > 25, "PASSED").when(F.col("l_quantity") > 10, "BLOCKED")
        .otherwise("SKIPPED").alias("status"))
    return R.flow_report(part_consumers(spark, sf_dir), runs)
