"""Lineage, verdict, routing and gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework.functions.rules import moment
from sluicework.functions.verdict import with_verdict
from sluicework.operators import alerts as A, lineage as L, profile as P
from sluicework.plans.judge import judge
from sluicework.sources import sinks
from sluicework.sources.store import SCHEMAS
from sluicework.workloads.common import (
    AS_OF, AS_OF_SQL, CONSUMERS_SQL, ORDER_CHECKS_SQL, ORDERS, part_consumers, part_owners, parts, query, table,
)
from sluicework.session import fresh_folder, small_frame

_IMPACT_SQL = CONSUMERS_SQL + """,
owned AS (SELECT 'part_' || p_partkey AS dataset, p_brand AS owner FROM part WHERE p_size > 5),
impact AS (
  SELECT 'part_' || p_partkey AS dataset, COALESCE(criticality, 'LOW') AS criticality,
    COALESCE(consumer_count, 0) AS consumer_count, COALESCE(owner, 'Unknown') AS owner
  FROM part LEFT JOIN critical c ON c.dataset = 'part_' || p_partkey LEFT JOIN owned o ON o.dataset = 'part_' || p_partkey)
"""


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.impact(parts(spark, sf_dir), part_consumers(spark, sf_dir), part_owners(spark, sf_dir))


@query("impact", f"WITH {_IMPACT_SQL} SELECT * FROM impact")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir)


@query("root_cause", """
WITH health AS (
  SELECT 'nation_' || (user_id % 25) AS upstream, ts, CASE WHEN event_type = 'error' AND value > 40 THEN 'DOWN' ELSE 'UP' END AS status, props AS details FROM events),
latest AS (SELECT upstream, status, details FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY upstream ORDER BY ts DESC, status DESC, details DESC) AS r FROM health) WHERE r = 1),
edges AS (SELECT DISTINCT 'part_' || l_partkey AS dataset, 'nation_' || s_nationkey AS upstream
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
names AS (SELECT 'part_' || p_partkey AS dataset FROM part UNION SELECT p_brand FROM part),
checked AS (SELECT e.dataset, e.upstream, l.status, l.details FROM edges e LEFT JOIN latest l ON e.upstream = l.upstream),
per AS (SELECT dataset, COUNT(*) FILTER (WHERE status = 'DOWN') AS down_count,
  string_agg(upstream || ' (' || COALESCE(details, '') || ')', ', ' ORDER BY upstream || ' (' || COALESCE(details, '') || ')')
    FILTER (WHERE status = 'DOWN') AS txt FROM checked GROUP BY dataset)
SELECT names.dataset, COALESCE(down_count, 0) AS down_count,
  CASE WHEN per.dataset IS NULL THEN 'Local Infrastructure Issue' WHEN down_count > 0 THEN 'Upstream Outage: ' || txt
       ELSE 'Local Infrastructure Issue (Upstream services are UP)' END AS root_cause
FROM names LEFT JOIN per ON per.dataset = names.dataset""")
def root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, health = _upstreams(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset")).distinct()
    return L.root_cause(parts(spark, sf_dir).unionByName(brands), edges, health)


@query("outage_rows", """
WITH health AS (
  SELECT 'nation_' || (user_id % 25) AS upstream, ts, CASE WHEN event_type = 'error' AND value > 40 THEN 'DOWN' ELSE 'UP' END AS status, props AS details FROM events),
latest AS (SELECT upstream, status, details FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY upstream ORDER BY ts DESC, status DESC, details DESC) AS r FROM health) WHERE r = 1),
edges AS (SELECT DISTINCT 'part_' || l_partkey AS dataset, 'nation_' || s_nationkey AS upstream
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT e.dataset, e.upstream, COALESCE(l.status = 'DOWN', FALSE) AS down, l.details FROM edges e LEFT JOIN latest l ON e.upstream = l.upstream""")
def outage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upstream of every dataset, and whether it is down."""
    return L.outages(*_upstreams(spark, sf_dir)).select("dataset", "upstream", "down", "details")


def _upstreams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts and the nations of their suppliers, and a health log of the nations."""
    health = table(spark, sf_dir, "events").select(
        F.concat(F.lit("nation_"), (F.col("user_id") % 25).cast("string")).alias("upstream"),
        F.col("ts").alias("timestamp"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 40), "DOWN").otherwise("UP").alias("status"),
        F.col("props").alias("details"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    edges = (
        table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("dataset"),
                F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("upstream")))
    return edges, health


@query("flow_state", f"""WITH {CONSUMERS_SQL},
last AS (SELECT 'part_' || l_partkey AS dataset, FIRST(l_returnflag || l_linestatus ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS f
  FROM lineitem GROUP BY 1),
st AS (SELECT dataset, CASE f WHEN 'NF' THEN NULL WHEN 'NO' THEN 'WARNING' ELSE CASE WHEN f LIKE 'R%' THEN 'BLOCKED' ELSE 'PASSED' END END AS status FROM last)
SELECT c.dataset, CASE WHEN status IN ('PASSED', 'WARNING') THEN 'reached' WHEN status = 'BLOCKED' THEN 'protected' ELSE 'unknown' END AS state,
  COUNT(*) AS consumers FROM consumers c LEFT JOIN st USING (dataset) GROUP BY 1, 2""")
def flow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    flag = F.max_by(F.concat("l_returnflag", "l_linestatus"), order)
    last = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("dataset")).agg(flag.alias("f"))
    status = last.select("dataset", F.when(F.col("f") == "NF", None).when(F.col("f") == "NO", "WARNING")
                         .when(F.col("f").startswith("R"), "BLOCKED").otherwise("PASSED").alias("status"))
    return L.flow_state(part_consumers(spark, sf_dir), status).groupBy("dataset", "state").agg(
        F.count(F.lit(1)).alias("consumers"))


_MATRIX_SQL = _IMPACT_SQL + """,
facts AS (
  SELECT 'part_' || l_partkey AS dataset, 100.0 - 100.0 * COUNT(*) FILTER (WHERE l_returnflag = 'R') / CAST(COUNT(*) AS DOUBLE) AS q0,
    ROUND((MAX(l_extendedprice) - AVG(l_extendedprice)) / STDDEV_SAMP(l_extendedprice), 2) AS z0
  FROM lineitem GROUP BY 1),
joined AS (
  SELECT i.dataset, i.criticality, i.owner, CASE WHEN p_size = 13 THEN 1 ELSE 0 END AS missing, CASE WHEN p_size = 27 THEN 2 ELSE 0 END AS mism,
    COALESCE(q0, 100.0) AS q0, COALESCE(z0, 0.0) AS z0, CASE WHEN COALESCE(z0, 0.0) > 1.5 THEN 1 ELSE 0 END AS a0
  FROM impact i JOIN part ON i.dataset = 'part_' || p_partkey LEFT JOIN facts f ON f.dataset = i.dataset),
branched AS (
  SELECT *, CASE WHEN missing + mism > 0 THEN 'schema_blocked' WHEN q0 < 50 THEN 'quality_blocked'
    WHEN a0 > 0 AND criticality IN ('HIGH', 'CRITICAL') AND z0 > 2.0 THEN 'anomaly_blocked'
    WHEN a0 > 0 AND criticality = 'LOW' AND z0 > 2.0 THEN 'anomaly_low'
    WHEN a0 > 0 AND z0 > 1.75 THEN 'anomaly_warning' WHEN q0 < 80 THEN 'quality_warning' ELSE 'passed' END AS branch
  FROM joined),
verdicts AS (
  SELECT dataset, criticality, owner, branch,
    CASE WHEN branch LIKE '%blocked' THEN 'BLOCKED' WHEN branch = 'passed' THEN 'PASSED' ELSE 'WARNING' END AS status,
    CASE WHEN branch = 'schema_blocked' THEN 0.0 ELSE q0 END AS quality_score,
    CASE WHEN branch IN ('schema_blocked', 'quality_blocked') THEN 0 ELSE a0 END AS anomaly_count,
    CASE WHEN branch IN ('schema_blocked', 'quality_blocked') THEN 0.0 ELSE z0 END AS max_z,
    CASE branch WHEN 'schema_blocked' THEN 'Schema Violation: Missing ' || missing || ' cols, ' || mism || ' mismatches.'
      WHEN 'quality_blocked' THEN 'Data Quality Score critically low: ' || printf('%.1f', ROUND(q0, 1)) || '% (threshold: 50%)'
      WHEN 'anomaly_blocked' THEN 'CRITICAL ANOMALY (Z=' || printf('%.1f', ROUND(z0, 1)) || ', threshold=2.0) on HIGH IMPACT dataset.'
      WHEN 'anomaly_low' THEN 'Anomaly detected (Z=' || printf('%.1f', ROUND(z0, 1)) || '), but impact is LOW.'
      WHEN 'anomaly_warning' THEN 'Anomaly detected (Z=' || printf('%.1f', ROUND(z0, 1)) || ', warning threshold=1.75).'
      WHEN 'quality_warning' THEN 'Data Quality Score below threshold: ' || printf('%.1f', ROUND(q0, 1)) || '% (threshold: 80%)'
      ELSE 'All checks passed.' END AS reason,
    CASE branch WHEN 'schema_blocked' THEN 'Quarantine, Fix Schema/Data' WHEN 'quality_blocked' THEN 'Quarantine, Investigate Value Violations'
      WHEN 'anomaly_blocked' THEN 'Quarantine, Alert Execs' WHEN 'anomaly_low' THEN 'Proceed to Load, Log Warning' ELSE 'Proceed to Load' END AS actions,
    CASE WHEN branch = 'quality_blocked' THEN 'SKIPPED (Quality too low)' WHEN branch LIKE '%blocked' THEN 'SKIPPED (Blocked by Agent)' ELSE '' END AS load_status
  FROM branched)
"""


def _part_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    facts = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("dataset")
    ).agg(
        (100.0 - 100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("quality_score"),
        F.round(F.try_divide(F.max(price) - F.avg(price), F.stddev_samp(price)), 2).alias("max_z"),
    )
    shape = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("dataset"),
        F.when(F.col("p_size") == 13, 1).otherwise(0).alias("missing_count"),
        F.when(F.col("p_size") == 27, 2).otherwise(0).alias("mismatch_count"))
    rows = _impact(spark, sf_dir).join(shape, "dataset").join(facts, "dataset", "left")
    return with_verdict(rows.withColumns({
        "quality_score": F.coalesce("quality_score", F.lit(100.0)), "max_z": F.coalesce("max_z", F.lit(0.0)),
    }).withColumns({
        "anomaly_count": F.when(F.col("max_z") > 1.5, 1).otherwise(0),
        "z_warning": F.lit(1.75), "z_critical": F.lit(2.0), "quality_warn": F.lit(80.0), "quality_block": F.lit(50.0),
    }))


@query("verdict_matrix", f"""WITH {_MATRIX_SQL}
SELECT dataset, criticality, owner, branch, status, ROUND(quality_score, 6) AS quality_score, anomaly_count, max_z, reason, actions, load_status FROM verdicts""")
def verdict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_verdicts(spark, sf_dir).select(
        "dataset", "criticality", "owner", "branch", "status", F.round("quality_score", 6).alias("quality_score"),
        "anomaly_count", "max_z", "reason", F.array_join("actions", ", ").alias("actions"),
        F.coalesce("load_status", F.lit("")).alias("load_status"))


ALERTS = {
    "channels": {"desk_room": {"type": "slack"}, "audit_room": {"type": "slack"}, "night_shift": {"type": "pagerduty"}},
    "routing": {
        "WARNING": {"channels": ["desk_room"], "required_criticality": ["LOW", "HIGH"]},
        "DEFAULT": {"channels": ["night_shift", "retired_room", "audit_room"]},
    },
}

_ALERT_SQL = _MATRIX_SQL + """,
rules AS (SELECT * FROM (VALUES ('WARNING', ['desk_room'], ['LOW', 'HIGH']),
  ('DEFAULT', ['night_shift', 'retired_room', 'audit_room'], CAST([] AS VARCHAR[]))) AS r(rule, channels, required)),
chans AS (SELECT * FROM (VALUES ('desk_room', 'slack'), ('audit_room', 'slack'), ('night_shift', 'pagerduty')) AS c(channel, channel_type)),
ruled AS (SELECT v.*, CASE WHEN v.status IN (SELECT rule FROM rules) THEN v.status ELSE 'DEFAULT' END AS rule FROM verdicts v WHERE status <> 'PASSED'),
fanned AS (SELECT x.*, unnest(r.channels) AS channel FROM ruled x JOIN rules r USING (rule)
  WHERE len(r.required) = 0 OR list_contains(r.required, x.criticality)),
alerts AS (SELECT f.*, channel_type FROM fanned f JOIN chans USING (channel))
"""


@query("alert_routing", f"""WITH {_ALERT_SQL}
SELECT dataset, status, criticality, owner, rule, channel, channel_type,
  CASE channel_type WHEN 'slack' THEN CASE WHEN status = 'BLOCKED' THEN '🚨' ELSE '⚠️' END || ' *' || status || ': ' || dataset || '* | Criticality: ' || criticality
      || ' | Reason: ' || reason || ' | Owner: ' || owner
    ELSE 'INCIDENT TRIGGERED: ' || dataset || ' is ' || status || ' | Severity: critical | Summary: ' || reason || ' | Owner: ' || owner END AS message
FROM alerts""")
def alert_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, channels = A.routing_tables(spark, ALERTS)
    routed = A.payloads(A.route(_part_verdicts(spark, sf_dir), rules, channels))
    return routed.select("dataset", "status", "criticality", "owner", "rule", "channel", "channel_type", "message")


def order_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who depends on orders, derived from the tables: each market segment, and the first region as owner."""
    segments = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").cast("int").alias("position"))
    consumers = segments.select(
        F.lit("orders").alias("dataset"), "position", F.col("c_mktsegment").alias("consumer"), F.lit("segment").alias("type"),
        F.lower("c_mktsegment").alias("owner"), F.when(F.col("c_mktsegment") < "F", "HIGH").otherwise("MEDIUM").alias("criticality"))
    owners = table(spark, sf_dir, "region").agg(F.min("r_name").alias("owner")).select(F.lit("orders").alias("dataset"), "owner")
    return L.impact(small_frame(spark, [("orders",)], "dataset string"), consumers, owners)


_ORDER_SQL = f"""
o AS (
  SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS batch, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, COUNT(*) AS n,
    COUNT(DISTINCT o_orderkey) AS u, COUNT(*) FILTER (WHERE o_custkey < 10) AS b_cust, COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS b_status,
    COUNT(*) FILTER (WHERE o_totalprice < 5000) + COUNT(*) FILTER (WHERE o_totalprice > 450000) AS b_price,
    COUNT(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^(?:^[1-4]-[A-Z]+)')) AS b_prio,
    COUNT(*) FILTER (WHERE NOT ({ORDER_CHECKS_SQL[0]})) AS k1,
    COUNT(*) FILTER (WHERE NOT ({ORDER_CHECKS_SQL[1]})) AS k2,
    AVG(o_orderkey) AS m_key, AVG(o_custkey) AS m_cust, AVG(o_totalprice) AS m_price
  FROM orders GROUP BY 1, 2),
q AS (
  SELECT *, GREATEST(0.0, (GREATEST(0.0, u / CAST(n AS DOUBLE) * 100) + GREATEST(0.0, (n - b_cust) / CAST(n AS DOUBLE) * 100)
    + GREATEST(0.0, (n - b_status) / CAST(n AS DOUBLE) * 100) + GREATEST(0.0, (n - b_price) / CAST(n AS DOUBLE) * 100) + 100.0
    + GREATEST(0.0, (n - b_prio) / CAST(n AS DOUBLE) * 100)) / 6
    - (CASE WHEN n < 3 THEN 5.0 ELSE 0.0 END + 3.0 * (CASE WHEN k1 > 0 THEN 1 ELSE 0 END + CASE WHEN k2 > 0 THEN 1 ELSE 0 END))) AS score
  FROM o),
history AS (
  SELECT batch AS run_id, ts, 'row_count' AS metric_name, CAST(n AS DOUBLE) AS v FROM o
  UNION ALL SELECT batch, ts, 'mean_o_orderkey', m_key FROM o UNION ALL SELECT batch, ts, 'mean_o_custkey', m_cust FROM o
  UNION ALL SELECT batch, ts, 'mean_o_totalprice', m_price FROM o),
framed AS (
  SELECT *, COUNT(*) OVER s AS s_n, AVG(v) OVER s AS s_m, STDDEV_SAMP(v) OVER s AS s_sd, MIN(v) OVER s AS s_lo, MAX(v) OVER s AS s_hi,
    COUNT(*) OVER g AS g_n, AVG(v) OVER g AS g_m, STDDEV_SAMP(v) OVER g AS g_sd, MIN(v) OVER g AS g_lo, MAX(v) OVER g AS g_hi
  FROM history
  WINDOW s AS (PARTITION BY metric_name, isodow(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         g AS (PARTITION BY metric_name ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
zs AS (
  SELECT run_id, CASE WHEN s_n >= 3 THEN CASE WHEN s_lo = s_hi THEN CASE WHEN v = s_lo THEN 0.0 WHEN v > s_lo THEN 10.0 ELSE -10.0 END ELSE (v - s_m) / s_sd END
    WHEN g_n >= 3 THEN CASE WHEN g_lo = g_hi THEN CASE WHEN v = g_lo THEN 0.0 WHEN v > g_lo THEN 10.0 ELSE -10.0 END ELSE (v - g_m) / g_sd END
    ELSE 0.0 END AS z, metric_name, v,
    CASE WHEN s_n >= 3 THEN CASE WHEN s_lo = s_hi THEN s_lo ELSE s_m END WHEN g_n >= 3 THEN CASE WHEN g_lo = g_hi THEN g_lo ELSE g_m END ELSE 0.0 END AS m
  FROM framed),
found AS (SELECT run_id AS batch, string_agg(metric_name || ' ' || printf('%.2f', ROUND(z, 2)) || ' of ' || printf('%.2f', ROUND(m, 2)), ', ' ORDER BY metric_name) AS anomalies
  FROM zs WHERE abs(z) > 3 GROUP BY 1),
st AS (SELECT run_id AS batch, COUNT(*) FILTER (WHERE abs(z) > 3) AS a0, COALESCE(MAX(abs(ROUND(z, 2))) FILTER (WHERE abs(z) > 3), 0.0) AS z0 FROM zs GROUP BY 1),
br AS (
  SELECT q.*, a0, z0, CASE WHEN score < 50 THEN 'quality_blocked' WHEN a0 > 0 AND z0 > 3.0 THEN 'anomaly_blocked'
    WHEN a0 > 0 AND z0 > 2.5 THEN 'anomaly_warning' WHEN score < 80 THEN 'quality_warning' ELSE 'passed' END AS branch
  FROM q JOIN st USING (batch)),
judged AS (
  SELECT batch, n, CASE WHEN branch LIKE '%blocked' THEN 'BLOCKED' WHEN branch = 'passed' THEN 'PASSED' ELSE 'WARNING' END AS status,
    CASE branch WHEN 'quality_blocked' THEN 'Data Quality Score critically low: ' || printf('%.1f', ROUND(score, 1)) || '% (threshold: 50%)'
      WHEN 'anomaly_blocked' THEN 'CRITICAL ANOMALY (Z=' || printf('%.1f', ROUND(z0, 1)) || ', threshold=3.0) on HIGH IMPACT dataset.'
      WHEN 'anomaly_warning' THEN 'Anomaly detected (Z=' || printf('%.1f', ROUND(z0, 1)) || ', warning threshold=2.5).'
      WHEN 'quality_warning' THEN 'Data Quality Score below threshold: ' || printf('%.1f', ROUND(score, 1)) || '% (threshold: 80%)'
      ELSE 'All checks passed.' END AS reason,
    ROUND(score, 6) AS quality_score, CAST(CASE WHEN branch = 'quality_blocked' THEN 0 ELSE a0 END AS INTEGER) AS anomaly_count,
    CASE WHEN branch = 'quality_blocked' THEN 0.0 ELSE z0 END AS max_z, 'HIGH' AS criticality, (SELECT MIN(r_name) FROM region) AS owner, k1, k2
  FROM br)
"""


def order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of orders judged in one go, each against the days before it."""
    history = small_frame(spark, [], SCHEMAS["metric_history"])
    verdicts, _, _ = judge(
        table(spark, sf_dir, "orders"), ORDERS, history, order_impact(spark, sf_dir),
        batch=F.to_date("o_orderdate"), at=F.to_timestamp("batch"), as_of=AS_OF, against="earlier", folder=fresh_folder(spark))
    return verdicts


@query("verdict", f"""WITH {_ORDER_SQL}
SELECT j.* EXCLUDE (n, k1, k2), COALESCE(anomalies, '') AS anomalies, '' AS new_columns, '' AS missing_columns, 0 AS mismatches
FROM judged j LEFT JOIN found USING (batch)""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform("anomalies", lambda a: F.format_string("%s %.2f of %.2f", a["metric_name"], a["z_score"], a["baseline_mean"]))
    return order_verdicts(spark, sf_dir).select(
        F.array_join(found, ", ").alias("anomalies"), F.array_join("new_columns", ",").alias("new_columns"),
        F.array_join("missing_columns", ",").alias("missing_columns"), F.size("type_mismatches").alias("mismatches"),
        "batch", "status", "reason", F.round("quality_score", 6).alias("quality_score"), "anomaly_count", "max_z",
        "criticality", "owner")


@query("gated_load", f"""WITH {_ORDER_SQL}
SELECT CASE WHEN status = 'BLOCKED' THEN 'quarantine' ELSE 'staging' END AS destination, o_orderstatus,
  COUNT(*) AS rows, COUNT(DISTINCT batch) AS batches, ROUND(SUM(o_totalprice), 2) AS total
FROM orders JOIN judged ON batch = CAST(CAST(o_orderdate AS DATE) AS VARCHAR) GROUP BY 1, 2""")
def gated_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = order_verdicts(spark, sf_dir)
    rows = sinks.by_verdict(table(spark, sf_dir, "orders"), verdicts, F.to_date("o_orderdate"))
    return rows.groupBy(sinks.destination().alias("destination"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("batch_key").alias("batches"),
        F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("error_summary", f"""WITH {_ORDER_SQL}
SELECT batch, CASE WHEN CAST(batch AS TIMESTAMP) <= {AS_OF_SQL} - INTERVAL 24 HOURS THEN 1 ELSE 0 END AS timeliness_issues, 0 AS schema_issues,
  CASE WHEN k1 > 0 THEN 1 ELSE 0 END + CASE WHEN k2 > 0 THEN 1 ELSE 0 END + CASE WHEN n < 3 THEN 1 ELSE 0 END AS profiling_issues,
  CASE WHEN CAST(batch AS TIMESTAMP) <= {AS_OF_SQL} - INTERVAL 24 HOURS THEN 1 ELSE 0 END + CASE WHEN k1 > 0 THEN 1 ELSE 0 END
    + CASE WHEN k2 > 0 THEN 1 ELSE 0 END + CASE WHEN n < 3 THEN 1 ELSE 0 END AS total_errors
FROM judged""")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    summary = P.summarise(df, ORDERS, F.to_date("o_orderdate"), metrics=False, distinct="none", as_of=AS_OF)
    late = F.to_timestamp("batch") <= moment(AS_OF) - F.expr("INTERVAL 24 HOURS")
    errors = F.concat(
        F.transform(F.filter("checks", lambda k: ~k["passed"]), lambda k: k["name"]),
        F.transform("constraints", lambda c: c["message"]))
    results = P.profile(summary, ORDERS).select(
        "batch", (~late).alias("timeliness_passed"), F.array().cast("array<string>").alias("schema_errors"),
        errors.alias("profiling_errors"))
    return sinks.error_summary(results).select(
        "batch", "timeliness_issues", "schema_issues", "profiling_issues", "total_errors")
