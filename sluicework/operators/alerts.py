"""Alert routing: verdict rows to one alert row per channel."""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework import fixed_values as fv
from sluicework.session import small_frame


def routing_tables(spark: SparkSession, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Routing rules by status, and channels, of an alert configuration."""
    rules = [
        (status, (r or {}).get("channels") or [], (r or {}).get("required_criticality") or [])
        for status, r in ((config or {}).get("routing") or {}).items()
    ]
    channels = [(name, (c or {}).get("type")) for name, c in ((config or {}).get("channels") or {}).items()]
    return (
        small_frame(spark, rules, "rule string, channels array<string>, required array<string>"),
        small_frame(spark, channels, "channel string, channel_type string"),
    )


def route(verdicts: DataFrame, rules: DataFrame, channels: DataFrame) -> DataFrame:
    """Alerts for every verdict that is not PASSED.

    The rule is the one named like the status, else DEFAULT. A criticality the rule
    does not list silences the alert. How to join is left to measured sizes.
    """
    known = rules.select(F.col("rule").alias("_known"))
    loud = verdicts.where(F.col("status") != "PASSED")
    ruled = loud.join(known, loud["status"] == known["_known"], "left").withColumn(
        "rule", F.coalesce("_known", F.lit("DEFAULT")))
    kept = ruled.join(rules, "rule").where(
        (F.size("required") == 0) | F.array_contains("required", F.col("criticality")))
    return (
        kept.withColumn("channel", F.explode("channels"))
        .join(channels, "channel")
        .select(*verdicts.columns, "rule", "channel", "channel_type")
    )


def payloads(alerts: DataFrame) -> DataFrame:
    """The message of each alert, by channel type."""
    icon = F.when(F.col("status") == "BLOCKED", "🚨").otherwise("⚠️")
    slack = F.format_string(fv.MSG["slack"], icon, "status", "dataset", "criticality", "reason", "owner")
    pager = F.format_string(fv.MSG["pagerduty"], "dataset", "status", "reason", "owner")
    return alerts.withColumns({
        "root_cause_found": F.col("reason").contains("Root Cause:"),
        "message": F.when(F.col("channel_type") == "slack", slack).when(F.col("channel_type") == "pagerduty", pager),
    })
