"""Names, thresholds, weights and message formats the results depend on."""

# --- Fixed values: declared type names accepted per type family ---
TYPE_FAMILIES = {
    "integer": ["integer", "int", "int4", "bigint", "int8", "long"],
    "smallint": ["smallint", "int2", "short"],
    "tinyint": ["tinyint", "int1"],
    "hugeint": ["hugeint"],
    "float": ["float", "float4", "real"],
    "double": ["double", "float8", "numeric"],
    "decimal": ["decimal", "numeric"],
    "varchar": ["varchar", "string", "text", "char"],
    "boolean": ["boolean", "bool"],
    "date": ["date"],
    "timestamp": ["timestamp", "datetime"],
    "time": ["time"],
    "interval": ["interval"],
    "blob": ["blob", "binary", "varbinary"],
    "json": ["json"],
    "list": ["list"],
    "struct": ["struct"],
}

# --- Fixed values: declared types whose columns get range statistics ---
NUMERIC_DECLARED = ["integer", "bigint", "smallint", "float", "double", "decimal", "int"]

# --- Fixed values: declared types coerced to timestamps before custom checks ---
DATETIME_DECLARED = ["date", "timestamp", "datetime"]

# --- Fixed values: texts a CSV reader takes for null (public pandas defaults) ---
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: default thresholds of a contract ---
Z_SCORE_WARNING = 2.5
Z_SCORE_CRITICAL = 3.0
QUALITY_SCORE_WARN = 80
QUALITY_SCORE_BLOCK = 50

# --- Fixed values: scoring ---
CONSTRAINT_PENALTY = 5.0
FAILED_CHECK_PENALTY = 3.0
SAMPLE_OFFENDERS = 5

# --- Fixed values: baselines and z-scores ---
MIN_HISTORY = 3
RECENT_RUNS = 30
ANOMALY_Z = 3.0
Z_FOR_CONSTANT_HISTORY = 10.0

# --- Fixed values: freshness ---
FRESHNESS_HOURS = 24
FRESHNESS_SLA_MINUTES = 30
UNCHANGED_TOLERANCE_SECONDS = 0.01

# --- Fixed values: criticality order ---
CRITICALITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# --- Fixed values: trust score ---
TRUST_WEIGHTS = {"history": 0.40, "verdict": 0.35, "quality": 0.25}
VERDICT_POINTS = {"PASSED": 100.0, "WARNING": 60.0, "BLOCKED": 10.0}
VERDICT_POINTS_OTHER = 50.0

# --- Fixed values: report lengths ---
HISTORY_LIMIT = 50
TREND_RUNS = 10
DRIFT_POINTS = 100
PULSE_REASON_CHARS = 60

# --- Fixed values: message formats ---
MSG = {
    "missing_column": "Column '%s' is missing from the data",
    "type_mismatch": "Column '%s' has incorrect type",
    "unexpected_column": "Unexpected column '%s' found in data",
    "duplicate_primary_key": "UNIQUENESS: Found %d duplicate IDs in Primary Key '%s'",
    "file_not_found": "Data file not found: %s",
    "load_error": "Failed to load data file: %s",
    "query_error": "Failed to execute query: %s",
    "unsupported_format": "Unsupported file format: %s",
    "not_null": "NOT NULL violation: %d null values found (%.1f%% of rows)",
    "primary_key": "PRIMARY KEY violation: %d duplicate values found (uniqueness: %.1f%%)",
    "below_min": "RANGE violation: %d values below minimum (%s). Actual min: %s",
    "above_max": "RANGE violation: %d values above maximum (%s). Actual max: %s",
    "pattern": "PATTERN violation: %d values don't match '%s' (%.1f%% of rows)",
    "allowed_values": "ALLOWED VALUES violation: %d values not in %s. Examples: %s",
    "row_count_below": "Row count (%d) is below minimum (%d)",
    "row_count_above": "Row count (%d) exceeds maximum (%d)",
    "contract_error": "Could not load contract from %s",
    "consistency": "CONSISTENCY: Rule '%s' failed on %d rows",
    "stale": "TIMELINESS: File is %.1f hours old (max allowed: %s hours)",
    "timeliness_missing": "TIMELINESS: File not found: %s",
    "z_initializing": "Baseline Initializing (insufficient history)",
    "z_anomaly": "CRITICAL ANOMALY: Z-Score %.2f > %.1f",
    "z_normal": "Normal (Z-Score: %.2f)",
    "z_context": "Expected %.2f ±%.2f, got %s",
    "passed": "All checks passed.",
    "schema_blocked": "Schema Violation: Missing %d cols, %d mismatches.",
    "quality_blocked": "Data Quality Score critically low: %.1f%% (threshold: %s%%)",
    "quality_warning": "Data Quality Score below threshold: %.1f%% (threshold: %s%%)",
    "anomaly_blocked": "CRITICAL ANOMALY (Z=%.1f, threshold=%s) on HIGH IMPACT dataset.",
    "anomaly_low": "Anomaly detected (Z=%.1f), but impact is LOW.",
    "anomaly_warning": "Anomaly detected (Z=%.1f, warning threshold=%s).",
    "verdict_file_missing": "File not found: %s",
    "verdict_load_failed": "Failed to load file: %s",
    "evaluation_error": "Evaluation error: %s",
    "deprecated": "Dataset is deprecated",
    "no_data": "No data file found",
    "unchanged": "Data file not modified since last scan",
    "infra_note": " (Note: Load skipped - Local DB unreachable. Root Cause: %s)",
    "load_failed_note": " (Load Failed: %s)",
    "local_issue": "Local Infrastructure Issue",
    "local_issue_up": "Local Infrastructure Issue (Upstream services are UP)",
    "outage": "Upstream Outage: %s",
    "slack": "%s *%s: %s* | Criticality: %s | Reason: %s | Owner: %s",
    "pagerduty": "INCIDENT TRIGGERED: %s is %s | Severity: critical | Summary: %s | Owner: %s",
}

# --- Fixed values: actions and load states per verdict branch ---
ACTIONS = {
    "passed": ["Proceed to Load"],
    "schema_blocked": ["Quarantine", "Fix Schema/Data"],
    "quality_blocked": ["Quarantine", "Investigate Value Violations"],
    "anomaly_blocked": ["Quarantine", "Alert Execs"],
    "anomaly_low": ["Proceed to Load", "Log Warning"],
    "abort": ["Abort"],
}
LOAD_BLOCKED = "SKIPPED (Blocked by Agent)"
LOAD_LOW_QUALITY = "SKIPPED (Quality too low)"
LOAD_INFRA_ERROR = "SKIPPED (Infra Error)"
INFRA_ERROR_MARKS = ["connection refused", "max retries exceeded"]

#: Name and severity of a check that has none: in profiles, and in the rule table.
PROFILE_CHECK = ("Unnamed Check", "warning")
RULE_CHECK = ("Custom Check", "error")
