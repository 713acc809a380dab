"""The verdict of a batch as one chain over columns of a single row.

Input columns: ``missing_count, mismatch_count, quality_score, anomaly_count, max_z,
criticality, z_warning, z_critical, quality_warn, quality_block``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluicework import fixed_values as fv
from sluicework.functions.rules import literal

BRANCH = """CASE
    WHEN missing_count + mismatch_count > 0 THEN 'schema_blocked'
    WHEN quality_score < quality_block THEN 'quality_blocked'
    WHEN anomaly_count > 0 AND criticality IN ('HIGH', 'CRITICAL') AND max_z > z_critical THEN 'anomaly_blocked'
    WHEN anomaly_count > 0 AND criticality = 'LOW' AND max_z > z_critical THEN 'anomaly_low'
    WHEN anomaly_count > 0 AND max_z > z_warning THEN 'anomaly_warning'
    WHEN quality_score < quality_warn THEN 'quality_warning'
    ELSE 'passed' END"""

EARLY = "branch IN ('schema_blocked', 'quality_blocked')"


def _message(key: str, *args: str) -> str:
    return f"format_string({', '.join([literal(fv.MSG[key]), *args])})"


def _plain(number: str) -> str:
    return f"regexp_replace(CAST({number} AS STRING), '[.]0$', '')"


REASON = f"""CASE branch
    WHEN 'schema_blocked' THEN {_message('schema_blocked', 'missing_count', 'mismatch_count')}
    WHEN 'quality_blocked' THEN {_message('quality_blocked', 'ROUND(quality_score, 1)', _plain('quality_block'))}
    WHEN 'anomaly_blocked' THEN {_message('anomaly_blocked', 'ROUND(max_z, 1)', 'CAST(z_critical AS STRING)')}
    WHEN 'anomaly_low' THEN {_message('anomaly_low', 'ROUND(max_z, 1)')}
    WHEN 'anomaly_warning' THEN {_message('anomaly_warning', 'ROUND(max_z, 1)', 'CAST(z_warning AS STRING)')}
    WHEN 'quality_warning' THEN {_message('quality_warning', 'ROUND(quality_score, 1)', _plain('quality_warn'))}
    ELSE {literal(fv.MSG['passed'])} END"""

ACTIONS = "CASE branch " + " ".join(
    f"WHEN '{key}' THEN array({', '.join(map(literal, fv.ACTIONS[key]))})"
    for key in ("schema_blocked", "quality_blocked", "anomaly_blocked", "anomaly_low")
) + f" ELSE array({', '.join(map(literal, fv.ACTIONS['passed']))}) END"


def with_verdict(df: DataFrame) -> DataFrame:
    """Add ``branch, status, reason, actions, load_status`` to one row per batch.

    The branch follows precedence: schema, low score, anomaly, score warning. A batch
    stopped early was never compared with its history, and one stopped by its schema
    was never profiled: their figures are recorded as zero.
    """
    return df.withColumn("branch", F.expr(BRANCH)).withColumns({
        "anomaly_count": F.expr(f"CAST(CASE WHEN {EARLY} THEN 0 ELSE anomaly_count END AS INT)"),
        "max_z": F.expr(f"CASE WHEN {EARLY} THEN 0D ELSE max_z END"),
        "quality_score": F.expr("CASE WHEN branch = 'schema_blocked' THEN 0D ELSE quality_score END"),
        "status": F.expr("CASE WHEN branch LIKE '%blocked' THEN 'BLOCKED' WHEN branch = 'passed' THEN 'PASSED' ELSE 'WARNING' END"),
        "reason": F.expr(REASON),
        "actions": F.expr(ACTIONS),
        "load_status": F.expr(
            f"CASE WHEN branch = 'quality_blocked' THEN {literal(fv.LOAD_LOW_QUALITY)} "
            f"WHEN branch LIKE '%blocked' THEN {literal(fv.LOAD_BLOCKED)} END"),
    })
