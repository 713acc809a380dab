"""Schema, profile, rule and score queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework.contracts import Contract, declared_columns, rule_table
from sluicework.operators import profile as P, schema as S
from sluicework.session import fresh_folder
from sluicework.sources import readers
from sluicework.workloads.common import AS_OF, AS_OF_SQL, ORDER_CHECKS_SQL, CONTRACTS, DOCUMENTS, EVENTS, LINEITEM, ORDERS, query, table

_DECLARED = ", ".join(
    f"('{k.dataset}', '{c.name}', '{c.declared}')" for k in CONTRACTS.values() for c in k.columns)
_SCHEMA_SQL = f"""
declared AS (SELECT * FROM (VALUES {_DECLARED}) AS d(dataset, column_name, declared_type)),
described AS (
  SELECT 'orders' AS dataset, column_name, column_type FROM (DESCRIBE orders)
  UNION ALL SELECT 'lineitem', column_name, column_type FROM (DESCRIBE lineitem)
  UNION ALL SELECT 'events', column_name, column_type FROM (DESCRIBE events)
  UNION ALL SELECT 'documents', column_name, column_type FROM (DESCRIBE documents)),
observed AS (
  SELECT dataset, column_name AS observed_name, lower(column_type) AS observed_type,
    CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN ['integer', 'int', 'int4', 'bigint', 'int8', 'long']
         WHEN column_type = 'DOUBLE' THEN ['double', 'float8', 'numeric']
         WHEN column_type = 'VARCHAR' THEN ['varchar', 'string', 'text', 'char', 'time', 'json']
         WHEN column_type LIKE 'TIMESTAMP%' THEN ['timestamp', 'datetime'] ELSE [] END AS accepted
  FROM described),
compared AS (
  SELECT COALESCE(d.dataset, o.dataset) AS dataset, d.column_name, o.observed_name, d.declared_type, o.observed_type,
    CASE WHEN o.observed_name IS NULL THEN 'missing_column' WHEN d.column_name IS NULL THEN 'unexpected_column'
         WHEN list_contains(o.accepted, d.declared_type) THEN 'ok' ELSE 'type_mismatch' END AS outcome
  FROM declared d FULL OUTER JOIN observed o
    ON d.dataset = o.dataset AND lower(d.column_name) = lower(o.observed_name)),
keys AS (
  SELECT 'orders' AS dataset, 'o_orderkey' AS column_name, COUNT(*) - COUNT(DISTINCT o_orderkey) AS duplicate_count FROM orders
  UNION ALL SELECT 'lineitem', 'l_orderkey', COUNT(*) - COUNT(DISTINCT l_orderkey) FROM lineitem
  UNION ALL SELECT 'events', 'event_id', COUNT(*) - COUNT(DISTINCT event_id) FROM events
  UNION ALL SELECT 'documents', 'doc_id', COUNT(*) - COUNT(DISTINCT doc_id) FROM documents),
issues AS (
  SELECT dataset, CASE WHEN outcome = 'unexpected_column' THEN 'warning' ELSE 'fail' END AS severity,
    COALESCE(column_name, observed_name) AS column_name, outcome AS issue_type,
    CASE outcome WHEN 'missing_column' THEN 'Column ''' || column_name || ''' is missing from the data'
                 WHEN 'type_mismatch' THEN 'Column ''' || column_name || ''' has incorrect type'
                 ELSE 'Unexpected column ''' || observed_name || ''' found in data' END AS message,
    CASE outcome WHEN 'missing_column' THEN column_name WHEN 'type_mismatch' THEN declared_type
                 ELSE '<not in schema>' END AS expected,
    CASE outcome WHEN 'missing_column' THEN '<not found>' WHEN 'type_mismatch' THEN observed_type
                 ELSE observed_name END AS actual
  FROM compared WHERE outcome <> 'ok'
  UNION ALL
  SELECT dataset, 'fail', column_name, 'duplicate_primary_key',
    'UNIQUENESS: Found ' || duplicate_count || ' duplicate IDs in Primary Key ''' || column_name || '''',
    'unique values', duplicate_count || ' duplicates'
  FROM keys WHERE duplicate_count > 0)
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = {name: table(spark, sf_dir, name).schema for name in CONTRACTS}
    return S.compare(declared_columns(spark, CONTRACTS.values()), S.observed_columns(spark, schemas))


def _key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name, contract in CONTRACTS.items():
        one = S.key_duplicates(table(spark, sf_dir, name), contract.primary_key).select(
            F.lit(name).alias("dataset"), F.lit(contract.primary_key).alias("column_name"),
            "total_rows", "distinct_keys", "duplicate_count")
        found = one if found is None else found.unionByName(one)
    return found


def _all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.issues(_compared(spark, sf_dir)).unionByName(S.key_issues(_key_duplicates(spark, sf_dir)))


@query("schema_validation", f"WITH {_SCHEMA_SQL} SELECT * FROM issues")
def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_issues(spark, sf_dir)


@query("schema_status", f"""WITH {_SCHEMA_SQL}
SELECT dataset, CASE WHEN MAX(CASE severity WHEN 'fail' THEN 2 ELSE 1 END) = 2 THEN 'fail' ELSE 'warning' END AS status,
       COUNT(*) AS total_issues, COUNT(*) FILTER (WHERE severity = 'fail') AS failed_checks
FROM issues GROUP BY dataset""")
def schema_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold(_all_issues(spark, sf_dir))


@query("schema_diff", f"""WITH {_SCHEMA_SQL}
SELECT c.dataset,
  COALESCE(string_agg(c.column_name, ',' ORDER BY c.column_name) FILTER (WHERE outcome = 'missing_column'), '') AS missing_columns,
  COALESCE(string_agg(observed_name, ',' ORDER BY observed_name) FILTER (WHERE outcome = 'unexpected_column'), '') AS new_columns,
  COALESCE(string_agg(c.column_name || ':' || declared_type || ':' || observed_type, ',' ORDER BY c.column_name)
           FILTER (WHERE outcome = 'type_mismatch'), '') AS type_mismatches,
  COUNT(*) FILTER (WHERE outcome = 'ok') + MAX(CASE WHEN duplicate_count = 0 THEN 1 ELSE 0 END) AS passed_checks,
  CASE WHEN COUNT(*) FILTER (WHERE outcome IN ('missing_column', 'type_mismatch')) > 0 THEN 'BLOCKED' ELSE 'PASSED' END AS gate
FROM compared c JOIN keys k ON c.dataset = k.dataset GROUP BY c.dataset""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = _key_duplicates(spark, sf_dir).select("dataset", (F.col("duplicate_count") == 0).cast("int").alias("unique"))
    blocked = (F.size("missing_columns") + F.size("type_mismatches")) > 0
    return S.diff(_compared(spark, sf_dir)).join(unique, "dataset").select(
        "dataset", F.array_join("missing_columns", ",").alias("missing_columns"),
        F.array_join("new_columns", ",").alias("new_columns"),
        F.array_join(F.transform("type_mismatches", lambda m: F.concat_ws(":", m["column"], m["expected"], m["actual"])), ",")
        .alias("type_mismatches"),
        (F.col("passed_checks") + F.col("unique")).alias("passed_checks"),
        F.when(blocked, "BLOCKED").otherwise("PASSED").alias("gate"))


@query("pk_duplicates", """
SELECT 'orders' AS dataset, 'o_orderkey' AS column_name, COUNT(*) AS total_rows, COUNT(DISTINCT o_orderkey) AS distinct_keys,
       COUNT(*) - COUNT(DISTINCT o_orderkey) AS duplicate_count FROM orders
UNION ALL SELECT 'lineitem', 'l_orderkey', COUNT(*), COUNT(DISTINCT l_orderkey), COUNT(*) - COUNT(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'events', 'event_id', COUNT(*), COUNT(DISTINCT event_id), COUNT(*) - COUNT(DISTINCT event_id) FROM events
UNION ALL SELECT 'documents', 'doc_id', COUNT(*), COUNT(DISTINCT doc_id), COUNT(*) - COUNT(DISTINCT doc_id) FROM documents""")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_duplicates(spark, sf_dir)


def _profile_sql(tab: str, cols: list[tuple[str, bool]], batch: str = "'all'") -> str:
    def one(c: str, numeric: bool) -> str:
        stats = (f"CAST(MIN({c}) AS DOUBLE), CAST(MAX({c}) AS DOUBLE), ROUND(AVG({c}), 4)" if numeric
                 else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
        return f"""SELECT {batch}, '{c}', COUNT(*), COUNT(*) - COUNT({c}),
          ROUND((COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE), 6), COUNT(DISTINCT {c}),
          ROUND(COUNT(DISTINCT {c}) / CAST(COUNT(*) AS DOUBLE), 6), {stats} FROM {tab} GROUP BY 1"""

    body = " UNION ALL ".join(one(c, numeric) for c, numeric in cols)
    return (f"SELECT * FROM ({body}) AS p(batch, column_name, total_rows, null_count, null_rate, unique_count, "
            "uniqueness_rate, min_value, max_value, mean_value)")


def _profiled(df: DataFrame, contract, batch=None) -> DataFrame:
    profiles = P.profile(P.summarise(df, contract, batch, metrics=False, as_of=AS_OF, distinct="exact"), contract)
    flat = profiles.select("batch", "total_rows", F.inline("columns"))
    return flat.select(
        "batch", "column_name", "total_rows", "null_count", F.round("null_rate", 6).alias("null_rate"), "unique_count",
        F.round("uniqueness_rate", 6).alias("uniqueness_rate"), "min_value", "max_value",
        F.round("mean_value", 4).alias("mean_value"))


_LINE_NULLS = ("(SELECT * REPLACE (NULLIF(l_linestatus, 'O') AS l_linestatus, NULLIF(l_tax, 0.08) AS l_tax) FROM lineitem)")


def _line_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns(
        {"l_linestatus": F.nullif("l_linestatus", F.lit("O")), "l_tax": F.nullif("l_tax", F.lit(0.08))})


_LINE_COLS = [("l_orderkey", True), ("l_quantity", True), ("l_discount", True), ("l_tax", True),
              ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False)]


@query("column_profile", _profile_sql(_LINE_NULLS, _LINE_COLS))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(_line_with_nulls(spark, sf_dir), LINEITEM)


@query("column_profile_by_batch", _profile_sql(_LINE_NULLS, _LINE_COLS, "strftime(l_shipdate, '%Y-%m')"))
def column_profile_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(_line_with_nulls(spark, sf_dir), LINEITEM, F.date_format("l_shipdate", "yyyy-MM"))


@query("document_profile", _profile_sql("documents", [("doc_id", True), ("text", False), ("lang", False),
                                                      ("source", False), ("n_chars", True)], "source"))
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(table(spark, sf_dir, "documents"), DOCUMENTS, "source")


_RULES_SQL = """
SELECT batch, column_name, not_null_violations, duplicate_count, below_min, above_max, pattern_mismatches, disallowed,
  violation_count, ROUND(GREATEST(0.0, (n - violation_count) / CAST(n AS DOUBLE) * 100), 6) AS quality_score
FROM (SELECT *, not_null_violations + duplicate_count + below_min + above_max + pattern_mismatches + disallowed AS violation_count
FROM (
  SELECT strftime(l_shipdate, '%Y') AS batch, 'l_orderkey' AS column_name, COUNT(*) AS n,
    COUNT(*) - COUNT(l_orderkey) AS not_null_violations, COUNT(*) - COUNT(DISTINCT l_orderkey) AS duplicate_count,
    0 AS below_min, 0 AS above_max, 0 AS pattern_mismatches, 0 AS disallowed FROM t GROUP BY 1
  UNION ALL SELECT strftime(l_shipdate, '%Y'), 'l_quantity', COUNT(*), COUNT(*) - COUNT(l_quantity), 0,
    COUNT(*) FILTER (WHERE l_quantity < 2), COUNT(*) FILTER (WHERE l_quantity > 48), 0, 0 FROM t GROUP BY 1
  UNION ALL SELECT strftime(l_shipdate, '%Y'), 'l_discount', COUNT(*), 0, 0,
    COUNT(*) FILTER (WHERE l_discount < 0.01), COUNT(*) FILTER (WHERE l_discount > 0.09), 0, 0 FROM t GROUP BY 1
  UNION ALL SELECT strftime(l_shipdate, '%Y'), 'l_tax', COUNT(*), 0, 0, 0, 0, 0, 0 FROM t GROUP BY 1
  UNION ALL SELECT strftime(l_shipdate, '%Y'), 'l_returnflag', COUNT(*), COUNT(*) - COUNT(l_returnflag), 0, 0, 0, 0,
    COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM t GROUP BY 1
  UNION ALL SELECT strftime(l_shipdate, '%Y'), 'l_linestatus', COUNT(*), 0, 0, 0, 0,
    COUNT(*) FILTER (WHERE NOT regexp_matches(l_linestatus, '^(?:[A-F])')), 0 FROM t GROUP BY 1
  UNION ALL SELECT strftime(l_shipdate, '%Y'), 'l_shipdate', COUNT(*), COUNT(*) - COUNT(l_shipdate), 0, 0, 0, 0, 0 FROM t GROUP BY 1))
"""


@query("rule_violations", "WITH t AS (SELECT * REPLACE (NULLIF(l_returnflag, 'N') AS l_returnflag) FROM lineitem) " + _RULES_SQL)
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    profiles = P.profile(P.summarise(df, LINEITEM, F.date_format("l_shipdate", "yyyy"), metrics=False), LINEITEM)
    return profiles.select("batch", F.inline("columns")).select(
        "batch", "column_name", "not_null_violations", "duplicate_count", "below_min", "above_max", "pattern_mismatches",
        "disallowed", "violation_count", F.round("quality_score", 6).alias("quality_score"))


@query("allowed_value_samples", """
WITH bad AS (SELECT DISTINCT source AS batch, lang AS value FROM documents WHERE lang NOT IN ('en', 'fr')),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY batch ORDER BY value) AS r FROM bad)
SELECT batch, 'lang' AS column_name, string_agg(value, ',' ORDER BY value) AS samples FROM ranked WHERE r <= 5 GROUP BY batch""")
def allowed_value_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.sample_offenders(table(spark, sf_dir, "documents"), DOCUMENTS, "source")
    return found.select("batch", "column_name", F.array_join("samples", ",").alias("samples"))


@query("violation_messages", """
WITH s AS (
  SELECT source, COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT doc_id) AS dup,
    COUNT(*) FILTER (WHERE NOT regexp_matches(text, '^(?:^[A-Z])')) AS bad_text,
    COUNT(*) FILTER (WHERE lang NOT IN ('en', 'fr')) AS bad_lang,
    COUNT(*) FILTER (WHERE NOT regexp_matches(source, '^(?:^src[0-9]$)')) AS bad_source,
    COUNT(*) FILTER (WHERE n_chars < 20) AS low, COUNT(*) FILTER (WHERE n_chars > 10000) AS high,
    CAST(MIN(n_chars) AS DOUBLE) AS lo, CAST(MAX(n_chars) AS DOUBLE) AS hi,
    list_aggregate(list_slice(list_sort(list_distinct(list(lang) FILTER (WHERE lang NOT IN ('en', 'fr')))), 1, 5),
                   'string_agg', ', ') AS samples
  FROM documents GROUP BY source)
SELECT source AS batch, 'text' AS column_name, 'PATTERN violation: ' || bad_text || ' values don''t match ''^[A-Z]'' ('
  || printf('%.1f', 100.0 * bad_text / n) || '% of rows)' AS message FROM s WHERE bad_text > 0
UNION ALL SELECT source, 'source', 'PATTERN violation: ' || bad_source || ' values don''t match ''^src[0-9]$'' ('
  || printf('%.1f', 100.0 * bad_source / n) || '% of rows)' FROM s WHERE bad_source > 0
UNION ALL SELECT source, 'lang', 'ALLOWED VALUES violation: ' || bad_lang || ' values not in [''en'', ''fr'']. Examples: ['
  || samples || ']' FROM s WHERE bad_lang > 0
UNION ALL SELECT source, 'n_chars', 'RANGE violation: ' || low || ' values below minimum (20). Actual min: ' || lo FROM s WHERE low > 0
UNION ALL SELECT source, 'n_chars', 'RANGE violation: ' || high || ' values above maximum (10000). Actual max: ' || hi FROM s WHERE high > 0""")
def violation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    profiles = P.profile(P.summarise(df, DOCUMENTS, "source", metrics=False), DOCUMENTS)
    return P.violations(profiles, DOCUMENTS, P.sample_offenders(df, DOCUMENTS, "source"))


def _checks_sql(tab: str, checks: list[tuple[str, str, str]], batch: str) -> str:
    def one(name: str, severity: str, condition: str) -> str:
        return f"SELECT {batch} AS batch, '{name}' AS name, '{severity}' AS severity, COUNT(*) FILTER (WHERE NOT ({condition})) AS v, COUNT(*) AS n FROM {tab} GROUP BY 1"

    body = " UNION ALL ".join(one(*c) for c in checks)
    return f"""SELECT batch, name, severity, v = 0 AS passed, v AS violation_count, n AS total_rows,
      ROUND(v / CAST(n AS DOUBLE), 6) AS violation_rate,
      CASE WHEN v > 0 THEN 'CONSISTENCY: Rule ''' || name || ''' failed on ' || v || ' rows' ELSE '' END AS message
    FROM ({body})"""


def _check_rows(df: DataFrame, contract, batch=None) -> DataFrame:
    profiles = P.profile(P.summarise(df, contract, batch, metrics=False, distinct="none", as_of=AS_OF), contract)
    return P.check_results(profiles).select(
        "batch", "name", "severity", "passed", "violation_count", "total_rows",
        F.round(F.col("violation_count") / F.col("total_rows"), 6).alias("violation_rate"),
        F.coalesce("message", F.lit("")).alias("message"))


@query("custom_checks", _checks_sql("lineitem", [
    (c.name, c.severity, c.condition) for c in LINEITEM.checks], "strftime(l_shipdate, '%Y-%m')"))
def custom_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check_rows(table(spark, sf_dir, "lineitem"), LINEITEM, F.date_format("l_shipdate", "yyyy-MM"))


@query("consistency_as_of", _checks_sql("orders", [
    (c.name, c.severity, c.condition.replace("now()", AS_OF_SQL)) for c in ORDERS.checks], "'all'"))
def consistency_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check_rows(table(spark, sf_dir, "orders"), ORDERS)


@query("text_checks", _checks_sql("documents", [(c.name, c.severity, c.condition) for c in DOCUMENTS.checks], "lang"))
def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check_rows(table(spark, sf_dir, "documents"), DOCUMENTS, "lang")


EVENT_SCORE_SQL = """
e AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || event_type AS batch, COUNT(*) AS n, COUNT(DISTINCT event_id) AS u,
    COUNT(*) FILTER (WHERE user_id < 1) + COUNT(*) FILTER (WHERE user_id > 140) AS b_user,
    COUNT(*) FILTER (WHERE event_type NOT IN ('click', 'purchase', 'signup', 'view')) AS b_type,
    COUNT(*) FILTER (WHERE value < 0.1) + COUNT(*) FILTER (WHERE value > 200.0) AS b_value,
    COUNT(*) FILTER (WHERE NOT regexp_matches(props, '^(?:\\{"k": [0-9]\\})')) AS b_props,
    COUNT(*) FILTER (WHERE NOT (value > 0.05)) AS k1
  FROM events GROUP BY 1),
cs AS (
  SELECT batch, n, GREATEST(0.0, u / CAST(n AS DOUBLE) * 100) AS s1, 100.0 AS s2,
    GREATEST(0.0, (n - b_user) / CAST(n AS DOUBLE) * 100) AS s3, GREATEST(0.0, (n - b_type) / CAST(n AS DOUBLE) * 100) AS s4,
    GREATEST(0.0, (n - b_value) / CAST(n AS DOUBLE) * 100) AS s5, GREATEST(0.0, (n - b_props) / CAST(n AS DOUBLE) * 100) AS s6,
    CASE WHEN n < 5 THEN 1 ELSE 0 END AS c, CASE WHEN k1 > 0 THEN 1 ELSE 0 END AS f FROM e)
"""


@query("quality_score", f"""WITH {EVENT_SCORE_SQL},
scored AS (SELECT batch, n AS total_rows, c AS constraint_violations, f AS failed_checks,
  GREATEST(0.0, (s1 + s2 + s3 + s4 + s5 + s6) / 6 - (5.0 * c + 3.0 * f)) AS q FROM cs)
SELECT batch, total_rows, constraint_violations, failed_checks, ROUND(q, 6) AS quality_score,
  CASE WHEN q < 50 THEN 'BLOCKED' WHEN q < 80 THEN 'WARNING' ELSE 'PASSED' END AS gate FROM scored""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    batch = [F.to_date("ts"), F.col("event_type")]
    profiles = P.profile(P.summarise(df, EVENTS, batch, metrics=False), EVENTS)
    q = F.col("overall_score")
    return profiles.select(
        "batch", "total_rows", F.size("constraints").alias("constraint_violations"),
        F.size(F.filter("checks", lambda k: ~k["passed"])).alias("failed_checks"), F.round(q, 6).alias("quality_score"),
        F.when(q < EVENTS.quality_block, "BLOCKED").when(q < EVENTS.quality_warn, "WARNING").otherwise("PASSED").alias("gate"))


@query("row_count_bounds", """
SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS batch, CASE WHEN COUNT(*) < 10 THEN 'ROW_COUNT_BELOW_MIN' ELSE 'ROW_COUNT_ABOVE_MAX' END AS type,
  'error' AS severity,
  CASE WHEN COUNT(*) < 10 THEN 'Row count (' || COUNT(*) || ') is below minimum (10)'
       ELSE 'Row count (' || COUNT(*) || ') exceeds maximum (50)' END AS message,
  CAST(CASE WHEN COUNT(*) < 10 THEN 10 ELSE 50 END AS BIGINT) AS expected, COUNT(*) AS actual
FROM lineitem GROUP BY 1 HAVING COUNT(*) < 10 OR COUNT(*) > 50""")
def row_count_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    summary = P.summarise(df, LINEITEM, F.to_date("l_shipdate"), metrics=False, distinct="none")
    return P.constraint_results(P.profile(summary, LINEITEM))


@query("rule_outcomes", """
WITH o AS (SELECT strftime(o_orderdate, '%Y') AS batch, * FROM orders),
m AS (
  SELECT batch, 'dataset' AS scope, '' AS column_name, 'rowCount' AS rule, '' AS check_name,
         CASE WHEN COUNT(*) < 3 THEN 1 ELSE 0 END AS v FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_orderkey', 'notNull', '', COUNT(*) - COUNT(o_orderkey) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_custkey', 'notNull', '', COUNT(*) - COUNT(o_custkey) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_orderstatus', 'notNull', '', COUNT(*) - COUNT(o_orderstatus) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_totalprice', 'notNull', '', COUNT(*) - COUNT(o_totalprice) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_orderdate', 'notNull', '', COUNT(*) - COUNT(o_orderdate) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_orderpriority', 'notNull', '', COUNT(*) - COUNT(o_orderpriority) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_custkey', 'range', '', COUNT(*) FILTER (WHERE o_custkey < 10) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_totalprice', 'range', '',
         COUNT(*) FILTER (WHERE o_totalprice < 5000 OR o_totalprice > 450000) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'dataset', '', 'sql', 'Open Orders Are Young', COUNT(*) FILTER (WHERE NOT (@check0)) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'dataset', '', 'sql', 'Urgency Covers Handling', COUNT(*) FILTER (WHERE NOT (@check1)) FROM o GROUP BY 1
  UNION ALL SELECT batch, 'column', 'o_orderdate', 'freshness', '',
         CASE WHEN MAX(o_orderdate) >= @asof - INTERVAL 24 HOURS THEN 0 ELSE 1 END FROM o GROUP BY 1)
SELECT 'orders' AS dataset, batch, scope, column_name, rule, check_name, v AS violation_count, v = 0 AS passed FROM m
""".replace("@asof", AS_OF_SQL).replace("@check0", ORDER_CHECKS_SQL[0]).replace("@check1", ORDER_CHECKS_SQL[1]))
def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    batch = F.date_format("o_orderdate", "yyyy")
    profiles = P.profile(P.summarise(df, ORDERS, batch, metrics=False, as_of=AS_OF, distinct="none"), ORDERS)
    measured = P.rule_outcomes(profiles, rule_table(spark, [ORDERS]))
    fresh = P.freshness_outcomes(df, ORDERS, AS_OF, batch).select(
        F.lit("orders").alias("dataset"), "batch", F.lit("column").alias("scope"), "column_name",
        F.lit("freshness").alias("rule"), F.lit(None).cast("string").alias("check_name"),
        F.when(F.col("passed"), 0).otherwise(1).cast("bigint").alias("violation_count"), "passed")
    return measured.unionByName(fresh).withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("column_name", "check_name")})


@query("score_report", f"""WITH {EVENT_SCORE_SQL}, r AS (SELECT e.*, cs.s1, cs.s3, cs.s4, cs.s5, cs.s6 FROM e JOIN cs USING (batch))
SELECT batch, 'column' AS kind, 'event_id' AS name, ROUND(s1, 2) AS score, n - u AS violations FROM r
UNION ALL SELECT batch, 'column', 'ts', 100.0, 0 FROM r
UNION ALL SELECT batch, 'column', 'user_id', ROUND(s3, 2), b_user FROM r
UNION ALL SELECT batch, 'column', 'event_type', ROUND(s4, 2), b_type FROM r
UNION ALL SELECT batch, 'column', 'value', ROUND(s5, 2), b_value FROM r
UNION ALL SELECT batch, 'column', 'props', ROUND(s6, 2), b_props FROM r
UNION ALL SELECT batch, 'check', 'Positive Value', ROUND(k1 * 100 / CAST(n AS DOUBLE), 1), k1 FROM r WHERE k1 > 0""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluicework.plans.reports import score_report as report

    batch = [F.to_date("ts"), F.col("event_type")]
    return report(P.profile(P.summarise(table(spark, sf_dir, "events"), EVENTS, batch, metrics=False), EVENTS))


@query("typed_coercion", """
WITH t AS (
  SELECT role AS batch, CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) || CASE WHEN turn > 2 THEN 'th' ELSE '' END AS turn, text
  FROM conversations)
SELECT batch, 'conv_id' AS column_name, 'bigint' AS declared_type, COUNT(conv_id) AS filled,
  COUNT(*) FILTER (WHERE conv_id IS NOT NULL AND TRY_CAST(conv_id AS BIGINT) IS NULL) AS failures FROM t GROUP BY batch
UNION ALL SELECT batch, 'turn', 'integer', COUNT(turn), COUNT(*) FILTER (WHERE turn IS NOT NULL AND TRY_CAST(turn AS BIGINT) IS NULL) FROM t GROUP BY batch
UNION ALL SELECT batch, 'text', 'varchar', COUNT(text), 0 FROM t GROUP BY batch""")
def typed_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = Contract.from_dict({"columns": [
        {"name": "conv_id", "data_type": "bigint"}, {"name": "turn", "data_type": "integer"},
        {"name": "text", "data_type": "varchar"}]}, "conversations")
    suffix = F.when(F.col("turn") > 2, "th").otherwise("")
    df = table(spark, sf_dir, "conversations").select(
        "role", F.col("conv_id").cast("string").alias("conv_id"),
        F.concat(F.col("turn").cast("string"), suffix).alias("turn"), "text")
    return readers.coercion_failures(df, contract, "role")


_TEXT_DATES = Contract.from_dict({
    "columns": [{"name": "placed", "data_type": "timestamp", "nullable": False}, {"name": "o_orderstatus"}],
    "quality": {"custom_checks": [{"name": "Placed Before", "sql_condition": "placed <= now()", "severity": "error"}]},
}, "orders")


@query("text_date_checks", f"""
WITH t AS (SELECT o_orderpriority AS batch, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS placed FROM orders)
SELECT batch, COUNT(*) - COUNT(placed) AS null_count, COUNT(*) FILTER (WHERE NOT (TRY_CAST(placed AS TIMESTAMP) <= {AS_OF_SQL})) AS violation_count
FROM t GROUP BY batch""")
def text_date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", text.alias("placed"))
    summary = P.summarise(df, _TEXT_DATES, "o_orderpriority", metrics=False, distinct="none", as_of=AS_OF)
    return P.profile(summary, _TEXT_DATES).select(
        "batch", F.col("columns")[0]["null_count"].alias("null_count"), F.col("checks")[0]["violation_count"].alias("violation_count"))


@query("source_formats", " UNION ALL ".join(
    f"""SELECT '{kind}' AS source, COUNT(*) AS rows, COUNT(DISTINCT o_custkey) AS customers, ROUND(SUM(o_totalprice), 2) AS total,
    strftime(MAX(o_orderdate), '%Y-%m-%d') AS newest, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS filled FROM orders"""
    for kind in ("csv", "json", "parquet", "query", "table")))
def source_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table written in each file format and read back through the one loader."""
    orders = table(spark, sf_dir, "orders")
    root = fresh_folder(spark)
    orders.createOrReplaceTempView("sluicework_orders")
    orders.write.option("header", True).csv(f"{root}/csv")
    orders.write.json(f"{root}/json")
    orders.write.parquet(f"{root}/parquet")
    sources = {k: f"{root}/{k}" for k in ("csv", "json", "parquet")}
    sources.update(query="SELECT * FROM sluicework_orders", table="sluicework_orders")
    parts = [
        readers.load(spark, source, kind).agg(
            F.lit(kind).alias("source"), F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("customers"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
            F.date_format(F.max(F.to_date("o_orderdate")), "yyyy-MM-dd").alias("newest"),
            F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
        for kind, source in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)
