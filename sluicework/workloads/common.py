"""Contracts, derived histories and lineage shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework.contracts import Contract
from sluicework.operators import anomaly, profile as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF = datetime(2001, 6, 15, 12, 0, 0)
AS_OF_SQL = "TIMESTAMP '2001-06-15 12:00:00'"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDERS = Contract.from_dict(
    {
        "info": {"owner": "Order Desk", "domain": "sales", "version": "1.2.0"},
        "quality": {
            "min_rows": 3,
            "max_rows": 1000000000,
            "custom_checks": [
                {"name": "Open Orders Are Young", "severity": "error",
                 "sql_condition": "o_orderstatus <> 'O' OR o_orderdate >= now() - INTERVAL 2000 DAYS"},
                {"name": "Urgency Covers Handling", "severity": "warning",
                 "sql_condition": "o_orderpriority NOT LIKE '1-%' OR o_totalprice > 20000"},
            ],
        },
        "columns": [
            {"name": "o_orderkey", "data_type": "bigint", "nullable": False, "isPrimaryKey": True},
            {"name": "o_custkey", "data_type": "bigint", "nullable": False, "min_value": 10},
            {"name": "o_orderstatus", "data_type": "varchar", "nullable": False, "allowed_values": ["F", "O"]},
            {"name": "o_totalprice", "data_type": "double", "nullable": False, "min_value": 5000.0, "max_value": 450000.0},
            {"name": "o_orderdate", "data_type": "timestamp", "nullable": False},
            {"name": "o_orderpriority", "data_type": "varchar", "nullable": False, "pattern": "^[1-4]-[A-Z]+"},
        ],
    },
    "orders",
)

#: The custom checks of orders in SQL, with the clock pinned.
ORDER_CHECKS_SQL = [c.condition.replace("now()", AS_OF_SQL) for c in ORDERS.checks]

LINEITEM = Contract.from_dict(
    {
        "info": {"owner": "Shipping", "domain": "logistics", "version": "2.0.0"},
        "quality": {
            "min_rows": 10,
            "max_rows": 50,
            "custom_checks": [
                {"name": "Returned At Discount", "sql_condition": "l_returnflag <> 'R' OR l_discount < 0.09"},
                {"name": "Discount Percentage", "sql_condition": "l_discount * 100 BETWEEN 0 AND 100", "severity": "error"},
                {"name": "Tax Below Discount", "sql_condition": "l_tax <= l_discount + 0.05", "severity": "warning"},
                {"name": "Ship Date Range", "sql_condition": "l_shipdate >= DATE '1995-06-01' AND l_shipdate < DATE '2001-06-01'"},
            ],
        },
        "columns": [
            {"name": "l_orderkey", "data_type": "bigint", "nullable": False, "isPrimaryKey": True},
            {"name": "l_quantity", "data_type": "double", "nullable": False, "min_value": 2, "max_value": 48},
            {"name": "l_discount", "data_type": "double", "min_value": 0.01, "max_value": 0.09},
            {"name": "l_tax", "data_type": "float"},
            {"name": "l_returnflag", "data_type": "varchar", "nullable": False, "allowed_values": ["A", "N"]},
            {"name": "l_linestatus", "data_type": "char", "pattern": "[A-F]"},
            {"name": "l_shipdate", "data_type": "date", "nullable": False},
            {"name": "l_comment", "data_type": "text", "nullable": True},
        ],
    },
    "lineitem",
)

EVENTS = Contract.from_dict(
    {
        "info": {"owner": "Web", "domain": "analytics"},
        "quality": {"min_rows": 5, "custom_checks": [
            {"name": "Positive Value", "sql_condition": "value > 0.05", "severity": "error"}]},
        "columns": [
            {"name": "event_id", "data_type": "bigint", "nullable": False, "isPrimaryKey": True},
            {"name": "ts", "data_type": "timestamp", "nullable": False},
            {"name": "user_id", "data_type": "integer", "nullable": False, "min_value": 1, "max_value": 140},
            {"name": "event_type", "data_type": "varchar", "allowed_values": ["click", "purchase", "signup", "view"]},
            {"name": "value", "data_type": "double", "min_value": 0.1, "max_value": 200.0},
            {"name": "props", "data_type": "json", "pattern": "\\{\"k\": [0-9]\\}"},
        ],
    },
    "events",
)

DOCUMENTS = Contract.from_dict(
    {
        "info": {"owner": "Editors", "domain": "text", "lifecycle": "active"},
        "quality": {"min_rows": 1, "custom_checks": [
            {"name": "Length Matches", "sql_condition": "length(text) = n_chars", "severity": "error"},
            {"name": "Not Shouting", "sql_condition": "text <> upper(text)"}]},
        "columns": [
            {"name": "doc_id", "data_type": "bigint", "nullable": False, "isPrimaryKey": True},
            {"name": "text", "data_type": "text", "nullable": False, "pattern": "^[A-Z]"},
            {"name": "lang", "data_type": "varchar", "allowed_values": ["en", "fr"]},
            {"name": "source", "data_type": "varchar", "pattern": "^src[0-9]$"},
            {"name": "n_chars", "data_type": "bigint", "min_value": 20, "max_value": 10000},
        ],
    },
    "documents",
)

CONTRACTS = {c.dataset: c for c in (ORDERS, LINEITEM, EVENTS, DOCUMENTS)}


def shipping_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics of shipments, one dataset per return flag."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("lineitem_"), "l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"),
        "l_extendedprice", F.nullif("l_tax", F.lit(0.08)).alias("l_tax"))
    summary = P.summarise(rows, Contract("shipping"), ["flag", "day"], distinct="none")
    metrics = P.metric_rows(summary).where(~F.col("metric_name").isin("null_rate_flag", "null_rate_day"))
    parts = F.split("batch", r"\|")
    return anomaly.as_history(metrics, parts[0], F.to_timestamp(parts[1]), F.col("batch"))


SHIPPING_SQL = """
daily AS (
  SELECT 'lineitem_' || l_returnflag AS dataset_name, CAST(l_shipdate AS DATE) AS day, COUNT(*) AS n,
         COUNT(l_extendedprice) AS np, AVG(l_extendedprice) AS mp,
         COUNT(NULLIF(l_tax, 0.08)) AS nt, AVG(NULLIF(l_tax, 0.08)) AS mt
  FROM lineitem GROUP BY 1, 2),
history AS (
  SELECT dataset_name || '|' || CAST(day AS VARCHAR) AS run_id, CAST(day AS TIMESTAMP) AS ts, dataset_name,
         metric_name, metric_value, CAST(isodow(day) - 1 AS INTEGER) AS day_of_week
  FROM (
    SELECT dataset_name, day, 'row_count' AS metric_name, CAST(n AS DOUBLE) AS metric_value FROM daily
    UNION ALL SELECT dataset_name, day, 'null_rate_l_extendedprice', (n - np) / CAST(n AS DOUBLE) FROM daily
    UNION ALL SELECT dataset_name, day, 'mean_l_extendedprice', mp FROM daily
    UNION ALL SELECT dataset_name, day, 'null_rate_l_tax', (n - nt) / CAST(n AS DOUBLE) FROM daily
    UNION ALL SELECT dataset_name, day, 'mean_l_tax', mt FROM daily)
  WHERE metric_value IS NOT NULL)
"""

REPLAY_SQL = SHIPPING_SQL + """,
framed AS (
  SELECT *,
    COUNT(*) OVER s AS s_n, AVG(metric_value) OVER s AS s_m, STDDEV_SAMP(metric_value) OVER s AS s_sd,
    MIN(metric_value) OVER s AS s_lo, MAX(metric_value) OVER s AS s_hi,
    COUNT(*) OVER g AS g_n, AVG(metric_value) OVER g AS g_m, STDDEV_SAMP(metric_value) OVER g AS g_sd,
    MIN(metric_value) OVER g AS g_lo, MAX(metric_value) OVER g AS g_hi
  FROM history
  WINDOW s AS (PARTITION BY dataset_name, metric_name, day_of_week ORDER BY ts, run_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         g AS (PARTITION BY dataset_name, metric_name ORDER BY ts, run_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
based AS (
  SELECT *, CASE WHEN s_n >= 3 THEN 'seasonal' WHEN g_n >= 3 THEN 'global' ELSE 'initializing' END AS baseline_type,
    CASE WHEN s_n >= 3 THEN CASE WHEN s_lo = s_hi THEN s_lo ELSE s_m END
         WHEN g_n >= 3 THEN CASE WHEN g_lo = g_hi THEN g_lo ELSE g_m END ELSE 0.0 END AS baseline_mean,
    CASE WHEN s_n >= 3 THEN CASE WHEN s_lo = s_hi THEN 0.0 ELSE s_sd END
         WHEN g_n >= 3 THEN CASE WHEN g_lo = g_hi THEN 0.0 ELSE g_sd END ELSE 0.0 END AS baseline_std
  FROM framed),
scored AS (
  SELECT *, CASE WHEN baseline_type = 'initializing' THEN 0.0
    WHEN baseline_std = 0 THEN CASE WHEN metric_value = baseline_mean THEN 0.0
                                    WHEN metric_value > baseline_mean THEN 10.0 ELSE -10.0 END
    ELSE (metric_value - baseline_mean) / baseline_std END AS z
  FROM based)
"""


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log derived from orders, one run per priority and day."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    n = F.count(F.lit(1))
    agg = o.groupBy(F.concat(F.lit("orders_"), F.substring("o_orderpriority", 1, 1)).alias("dataset_name"), "day").agg(
        (100.0 - 100.0 * F.count_if(F.col("o_orderstatus") == "P") / n).alias("quality_score"),
        F.count_if(F.col("o_totalprice") > 450000).cast("int").alias("anomaly_count"),
        (F.max("o_totalprice") / 100000.0).alias("z_score_max"),
        F.pmod(F.sum("o_custkey"), F.lit(5000)).cast("int").alias("duration_ms"),
    )
    status = F.when(F.col("quality_score") < 50, "BLOCKED").when(F.col("quality_score") < 80, "WARNING").otherwise("PASSED")
    return agg.select(
        F.concat_ws("|", "dataset_name", F.col("day").cast("string")).alias("run_id"),
        F.col("day").cast("timestamp").alias("timestamp"), "dataset_name", status.alias("status"), "quality_score",
        "anomaly_count", "z_score_max",
        F.concat(F.lit("Run of "), F.col("dataset_name"), F.lit(" on "), F.col("day").cast("string"),
                 F.lit(" ended as "), status, F.lit(" after comparing all of its rows with the contract")).alias("reason"),
        "duration_ms",
    )


RUNS_SQL = """
run_base AS (
  SELECT 'orders_' || substr(o_orderpriority, 1, 1) AS dataset_name, CAST(o_orderdate AS DATE) AS day,
         100.0 - 100.0 * COUNT(*) FILTER (WHERE o_orderstatus = 'P') / CAST(COUNT(*) AS DOUBLE) AS quality_score,
         CAST(COUNT(*) FILTER (WHERE o_totalprice > 450000) AS INTEGER) AS anomaly_count,
         MAX(o_totalprice) / 100000.0 AS z_score_max, CAST(SUM(o_custkey) % 5000 AS INTEGER) AS duration_ms
  FROM orders GROUP BY 1, 2),
run_status AS (
  SELECT *, CASE WHEN quality_score < 50 THEN 'BLOCKED' WHEN quality_score < 80 THEN 'WARNING' ELSE 'PASSED' END AS status
  FROM run_base),
runs AS (
  SELECT dataset_name || '|' || CAST(day AS VARCHAR) AS run_id, CAST(day AS TIMESTAMP) AS ts, *,
         'Run of ' || dataset_name || ' on ' || CAST(day AS VARCHAR) || ' ended as ' || status ||
         ' after comparing all of its rows with the contract' AS reason
  FROM run_status)
"""


def part_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumer edges derived from shipments: each part is a dataset its suppliers depend on."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = table(spark, sf_dir, "supplier")
    label = (
        F.when(F.col("s_acctbal") > 9940, "critical").when(F.col("s_acctbal") > 9800, "HIGH")
        .when(F.col("s_acctbal") > 9500, "Medium").when(F.col("s_acctbal") > 4000, "LOW")
        .when(F.col("s_acctbal") > 0, "minor")
    )
    return pairs.join(s, pairs["l_suppkey"] == s["s_suppkey"]).select(
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("dataset"),
        F.col("s_suppkey").cast("int").alias("position"), F.col("s_name").alias("consumer"),
        F.lit("app").alias("type"), F.col("s_nationkey").cast("string").alias("owner"), label.alias("criticality"),
    )


CONSUMERS_SQL = """
consumers AS (
  SELECT 'part_' || l_partkey AS dataset, s_suppkey AS position, s_name AS consumer,
    CASE WHEN s_acctbal > 9940 THEN 'critical' WHEN s_acctbal > 9800 THEN 'HIGH' WHEN s_acctbal > 9500 THEN 'Medium'
         WHEN s_acctbal > 4000 THEN 'LOW' WHEN s_acctbal > 0 THEN 'minor' END AS criticality
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey),
ranked AS (
  SELECT dataset, position, UPPER(COALESCE(criticality, 'LOW')) AS label,
    CASE UPPER(COALESCE(criticality, 'LOW')) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank
  FROM consumers),
critical AS (
  SELECT dataset, FIRST(label ORDER BY rank DESC, position) AS criticality, COUNT(*) AS consumer_count
  FROM ranked GROUP BY dataset)
"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("dataset"))


def part_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 5").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("dataset"), F.col("p_brand").alias("owner"))
