"""Queries that run the gate itself: batches are judged, written, recorded and read back."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluicework.contracts import Contract
from sluicework.operators import profile as P, schema as S
from sluicework.plans.gate import Gate
from sluicework.plans.validate import validate
from sluicework.session import fresh_folder, remove, small_frame
from sluicework.sources import landing, readers
from sluicework.workloads.common import AS_OF, ORDERS, query, table

DESK = Contract.from_dict(
    {
        "info": {"owner": "Desk"},
        "quality": {"min_rows": 1, "anomaly_thresholds": {"quality_score_block": 60, "quality_score_warn": 80}, "custom_checks": [
            {"name": "Priced", "sql_condition": "o_totalprice > 0", "severity": "error"}]},
        "columns": [
            {"name": "o_orderkey", "data_type": "bigint", "nullable": False, "isPrimaryKey": True},
            {"name": "o_totalprice", "data_type": "double", "nullable": False, "min_value": 150000.0},
        ],
    },
    "desk",
)

_KEYS_SQL = r"""
keyed AS (
  SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS k1,
    CASE WHEN o_orderpriority LIKE '5%' THEN NULL WHEN o_orderpriority LIKE '4%' THEN '' ELSE replace(o_orderpriority, '-', '|') END AS k2,
    CAST(floor(o_totalprice / 100000) AS BIGINT) AS band
  FROM orders),
texts AS (
  SELECT *, coalesce(k1, '\N') || '|' || CASE WHEN k2 IS NULL THEN '\N' WHEN k2 = '' THEN '\E' ELSE replace(k2, '|', '\|') END
    || '|' || coalesce(CAST(band AS VARCHAR), '\N') AS batch
  FROM keyed),
b AS (
  SELECT batch, COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS u, COUNT(*) FILTER (WHERE o_totalprice < 150000) AS low
  FROM texts GROUP BY 1),
scored AS (SELECT *, (u / CAST(n AS DOUBLE) * 100 + (n - low) / CAST(n AS DOUBLE) * 100) / 2 AS q FROM b),
judged AS (SELECT *, CASE WHEN q < 60 THEN 'BLOCKED' WHEN q < 80 THEN 'WARNING' ELSE 'PASSED' END AS status FROM scored)
"""


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    """Orders, and three batch keys: two with nulls, empty texts and separators in their values, and the band of the price.

    By its band a batch has only prices that the contract allows, half of them, or none: all verdicts occur.
    """
    priority = F.col("o_orderpriority")
    second = F.when(priority.startswith("5"), None).when(priority.startswith("4"), "").otherwise(F.translate(priority, "-", "|"))
    band = F.floor(F.col("o_totalprice") / 100000)
    return table(spark, sf_dir, "orders"), [F.nullif("o_orderstatus", F.lit("P")), second, band]


@query("batch_keys", f"""WITH {_KEYS_SQL}
SELECT batch, n AS total_rows, ROUND(q, 6) AS quality_score FROM scored""")
def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No two batches are merged, and none is lost, whatever their keys hold."""
    orders, keys = _keyed(spark, sf_dir)
    profiles = P.profile(P.summarise(orders, DESK, keys, metrics=False), DESK)
    return profiles.select("batch", "total_rows", F.round("overall_score", 6).alias("quality_score"))


def _after(spark: SparkSession, sf_dir: str, runs: int = 1) -> Gate:
    gate = Gate(spark, fresh_folder(spark))
    orders, keys = _keyed(spark, sf_dir)
    for _ in range(runs):
        gate.evaluate(orders, DESK, batch=keys, as_of=AS_OF)
    return gate


def _read(gate: Gate, folder: str, destination: str) -> DataFrame:
    rows = gate.spark.read.parquet(f"{gate.root}/{folder}")
    return rows.withColumns({"destination": F.lit(destination), "batch_key": F.col("batch_key").cast("string")})


@query("gated_write", f"""WITH {_KEYS_SQL}
SELECT CASE WHEN status = 'BLOCKED' THEN 'quarantine' ELSE 'warehouse' END AS destination, t.batch, COUNT(*) AS rows, ROUND(SUM(o_totalprice), 2) AS total
FROM texts t JOIN judged j ON t.batch = j.batch GROUP BY 1, 2""")
def gated_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate has written, read back from both destinations."""
    gate = _after(spark, sf_dir)
    both = _read(gate, "warehouse/desk", "warehouse").unionByName(_read(gate, "quarantine/desk", "quarantine"), allowMissingColumns=True)
    return both.groupBy("destination", F.col("batch_key").alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("gate_records", f"""WITH {_KEYS_SQL}
SELECT 'run' AS record, batch, status, ROUND(q, 6) AS figure FROM judged
UNION ALL SELECT 'report', batch, 'QUARANTINED', 0.0 FROM judged WHERE status = 'BLOCKED'
UNION ALL SELECT 'metric', 'row_count', 'PASSED', CAST(SUM(n) AS DOUBLE) FROM judged WHERE status = 'PASSED' HAVING COUNT(*) > 0
UNION ALL SELECT 'registry', 'desk', 'active', 2.0""")
def gate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log, quarantine reports, metric history and registry after the same batches were judged twice."""
    gate = _after(spark, sf_dir, runs=2)
    store = gate.store
    verdicts = spark.read.parquet(*_folders(gate, "verdicts/desk")).select("run_id", "batch").distinct()
    runs = store.read("run_history").join(verdicts, "run_id").select(
        F.lit("run").alias("record"), "batch", "status", F.round("quality_score", 6).alias("figure"))
    reports = store.read("quarantine_reports").select(
        F.lit("report"), "batch", "status", F.get_json_object("report", "$.anomaly_count").cast("double"))
    metrics = store.read("metric_history").where("metric_name = 'row_count'").groupBy("metric_name").agg(
        F.sum("metric_value").alias("v")).select(F.lit("metric"), "metric_name", F.lit("PASSED"), "v")
    registry = store.registry().select(F.lit("registry"), "dataset_name", "lifecycle", F.col("scan_count").cast("double"))
    return reduce(DataFrame.union, [runs, reports, metrics, registry])


def _folders(gate: Gate, folder: str) -> list[str]:
    """The tables that runs have left below a folder."""
    path = gate.spark._jvm.org.apache.hadoop.fs.Path(f"{gate.root}/{folder}")
    found = path.getFileSystem(gate.spark._jsc.hadoopConfiguration()).listStatus(path)
    return [f.getPath().toString() for f in found]


@query("gate_process", f"""WITH {_KEYS_SQL}
SELECT batch, status, CASE WHEN status = 'BLOCKED' THEN 'QUARANTINED' ELSE 'STAGED' END AS action_taken, n AS rows FROM judged""")
def gate_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge and move in one call: each batch lies where its own verdict sends it."""
    orders, keys = _keyed(spark, sf_dir)
    gate = Gate(spark, fresh_folder(spark))
    result = gate.process(orders, DESK, AS_OF, batch=keys)
    lying = _read(gate, "staging/desk", "STAGED").unionByName(_read(gate, "quarantine/desk", "QUARANTINED"), allowMissingColumns=True)
    rows = lying.groupBy(F.col("batch_key").alias("batch"), F.col("destination").alias("action_taken")).agg(F.count(F.lit(1)).alias("rows"))
    return result["batches"].join(rows, ["batch", "action_taken"], "left").select("batch", "status", "action_taken", "rows")


@query("delimited_text", """
SELECT kind AS source, COUNT(*) AS rows, SUM(length(text)) AS chars, COUNT(DISTINCT text) AS texts, MAX(lang) AS last_lang
FROM documents, (VALUES ('csv'), ('json')) AS s(kind) GROUP BY kind""")
def delimited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with line breaks and quotes, through CSV and JSON files and back."""
    docs, root = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fresh_folder(spark)
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(f"{root}/csv")
    docs.write.json(f"{root}/json")
    parts = [readers.load(spark, f"{root}/{kind}", kind).agg(
        F.lit(kind).alias("source"), F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"),
        F.count_distinct(F.sha2("text", 256)).alias("texts"), F.max("lang").alias("last_lang")) for kind in ("csv", "json")]
    return reduce(DataFrame.unionByName, parts)


@query("source_errors", """
SELECT source, issue_type, CASE WHEN source = 'ragged' THEN (SELECT COUNT(*) FROM orders) END AS lines
FROM (VALUES ('missing', 'file_not_found'), ('query', 'query_error'), ('ragged', 'load_error'), ('unsupported', 'load_error')) AS v(source, issue_type)""")
def source_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issue of each source that can't be read, one of them the lines of orders with some rows too wide."""
    root = fresh_folder(spark)
    line = F.concat_ws(",", "o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 1000 == 3, F.lit("x,y")))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of each file
    table(spark, sf_dir, "orders").select(F.when(first, F.concat(F.lit("key,name\n"), line)).otherwise(line).alias("line")).write.text(f"{root}/ragged")
    written = spark.read.text(f"{root}/ragged").where("value <> 'key,name'").count()
    tried = {"missing": (f"{root}/nothing", "csv"), "query": ("SELECT nothing FROM nowhere", "query"),
             "ragged": (f"{root}/ragged", "csv"), "unsupported": (f"{root}/ragged", "xml")}
    rows = []
    for name, (source, kind) in tried.items():
        try:
            readers.load(spark, source, kind)
        except readers.SourceError as exc:
            rows.append((name, exc.issue_type, written if name == "ragged" else None))
    remove(spark, root)
    return small_frame(spark, rows, "source string, issue_type string, lines bigint")


@query("evaluate_all_summary", """
WITH b AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS u, COUNT(*) FILTER (WHERE o_totalprice < 150000) AS low FROM orders),
s AS (SELECT (u / CAST(n AS DOUBLE) * 100 + (n - low) / CAST(n AS DOUBLE) * 100) / 2 AS q FROM b),
v AS (SELECT CASE WHEN q < 60 THEN 'BLOCKED' WHEN q < 80 THEN 'WARNING' ELSE 'PASSED' END AS status FROM s)
SELECT round, 5 AS total, CASE WHEN round = 1 AND status = 'PASSED' THEN 1 ELSE 0 END AS passed,
  CASE WHEN round = 1 AND status = 'WARNING' THEN 1 ELSE 0 END AS warning,
  2 - round + 1 + CASE WHEN round = 1 AND status = 'BLOCKED' THEN 1 ELSE 0 END AS blocked, 2 AS skipped, round - 1 + round - 1 AS unchanged
FROM v, (VALUES (1), (2)) AS r(round)""")
def evaluate_all_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five datasets judged twice: one in order, one without its columns, one deprecated, one missing, one broken contract."""
    root = fresh_folder(spark)
    gate = Gate(spark, root)
    columns = [{"name": "o_orderkey", "data_type": "bigint"}, {"name": "o_gone", "data_type": "double"}]
    contracts = [
        DESK, Contract.from_dict({"columns": columns}, "short"), Contract("unread", error="no such file", path="unread.yaml"),
        Contract.from_dict({"info": {"lifecycle": "deprecated"}, "columns": columns}, "old"), Contract.from_dict({"columns": columns}, "absent")]
    files = {k: f"{sf_dir}/orders.parquet" for k in ("desk", "short", "unread", "old")}
    totals = []
    for number in (1, 2):
        _, counted = gate.evaluate_all(contracts, files, skip_unchanged=number > 1, as_of=datetime(2001, 6, 15 + number))
        totals.append(counted.withColumn("round", F.lit(number)))
    return totals[0].unionByName(totals[1])


FLEET = [
    DESK,
    Contract.from_dict({"columns": [
        {"name": "l_orderkey", "data_type": "bigint", "nullable": False}, {"name": "l_quantity", "data_type": "double", "min_value": 1, "max_value": 50}]}, "lineitem"),
    Contract.from_dict({"quality": {"anomaly_thresholds": {"quality_score_block": 60}}, "columns": [
        {"name": "c_custkey", "data_type": "bigint", "isPrimaryKey": True}, {"name": "c_nationkey", "data_type": "bigint", "isPrimaryKey": True}]}, "customer"),
    Contract.from_dict({"columns": [{"name": "p_partkey", "data_type": "bigint"}, {"name": "p_gone", "data_type": "double"}]}, "part"),
    Contract.from_dict({"columns": [{"name": "s_suppkey", "data_type": "bigint", "nullable": False}]}, "supplier"),
    Contract.from_dict({"info": {"lifecycle": "deprecated"}, "columns": [{"name": "n_nationkey", "data_type": "bigint"}]}, "nation"),
    Contract.from_dict({"columns": [{"name": "x", "data_type": "bigint"}]}, "absent"),
]


@query("evaluate_fleet", """
WITH o AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS u, COUNT(*) FILTER (WHERE o_totalprice < 150000) AS low FROM orders),
c AS (SELECT COUNT(*) AS n, COUNT(DISTINCT c_custkey) AS u, COUNT(DISTINCT c_nationkey) AS v FROM customer),
l AS (SELECT COUNT(*) AS n, COUNT(l_orderkey) AS f, COUNT(*) FILTER (WHERE l_quantity < 1) AS below, COUNT(*) FILTER (WHERE l_quantity > 50) AS above FROM lineitem),
q AS (
  SELECT 'desk' AS dataset, 80 AS warn, 60 AS block, (u / CAST(n AS DOUBLE) * 100 + (n - low) / CAST(n AS DOUBLE) * 100) / 2 AS q, n FROM o
  UNION ALL SELECT 'customer', 80, 60, (u / CAST(n AS DOUBLE) * 100 + v / CAST(n AS DOUBLE) * 100) / 2, n FROM c
  UNION ALL SELECT 'lineitem', 80, 50, (f / CAST(n AS DOUBLE) * 100 + (n - below - above) / CAST(n AS DOUBLE) * 100) / 2, n FROM l)
SELECT dataset, CASE WHEN q < block THEN 'BLOCKED' WHEN q < warn THEN 'WARNING' ELSE 'PASSED' END AS status, ROUND(q, 6) AS quality_score, n AS total_rows FROM q
UNION ALL SELECT 'part', 'BLOCKED', 0.0, NULL
UNION ALL SELECT 'supplier', 'UNCHANGED', NULL, NULL
UNION ALL SELECT 'nation', 'SKIPPED', NULL, NULL
UNION ALL SELECT 'absent', 'SKIPPED', NULL, NULL""")
def evaluate_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables of different schemas judged at once, beside an unchanged, a deprecated and a missing one."""
    gate = Gate(spark, fresh_folder(spark))
    files = {k: f"{sf_dir}/{'orders' if k == 'desk' else k}.parquet" for k in ("desk", "lineitem", "customer", "part", "supplier", "nation")}
    gate.evaluate_all([FLEET[4]], files, as_of=AS_OF, take_action=False)
    results, _ = gate.evaluate_all(FLEET, files, skip_unchanged=True, as_of=datetime(2001, 6, 16), take_action=False)
    verdicts = spark.read.parquet(*_folders(gate, "verdicts/_together")).where(F.col("timestamp") == F.lit(datetime(2001, 6, 16)))
    told = verdicts.select("dataset", F.round("quality_score", 6).alias("quality_score"), "total_rows")
    return results.join(told, "dataset", "left").select("dataset", "status", "quality_score", "total_rows")


def _loads_sql(number: int, status: str, load: str) -> str:
    return (f"SELECT {number} AS attempt, batch, CASE WHEN status = 'BLOCKED' THEN status ELSE {status} END AS status, "
            f"CASE WHEN status = 'BLOCKED' THEN 'SKIPPED (Quality too low)' ELSE '{load}' END AS load_status, "
            f"CASE WHEN status = 'BLOCKED' OR {number} < 3 THEN 0 ELSE n END AS loaded FROM judged")


@query("load_attempts", f"""WITH {_KEYS_SQL}
{_loads_sql(1, "'WARNING'", 'SKIPPED (Infra Error)')} UNION ALL {_loads_sql(2, "'BLOCKED'", 'disk full')}
UNION ALL {_loads_sql(3, 'status', 'LOADED')} UNION ALL {_loads_sql(4, 'status', 'LOADED')}""")
def load_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that appends, can't be reached at first and has no room then: the third load is whole, the fourth adds no row."""
    root = fresh_folder(spark)
    failures = ["Connection refused", "disk full"]
    taken = small_frame(spark, [], "batch string, loaded bigint")
    parts = []

    def sink(rows: DataFrame, dataset: str) -> None:
        if failures:
            raise RuntimeError(failures.pop(0))
        rows.write.mode("append").parquet(f"{root}/target/{dataset}")

    gate = Gate(spark, f"{root}/gate", sink=sink)
    orders, keys = _keyed(spark, sf_dir)
    for number in range(1, 5):
        verdicts = gate.evaluate(orders, DESK, batch=keys, as_of=datetime(2001, 6, 15, number))
        if number == 3:
            taken = spark.read.parquet(f"{root}/target/desk")
        there = taken if number < 3 else spark.read.parquet(f"{root}/target/desk").groupBy(F.col("batch_key").alias("batch")).agg(F.count(F.lit(1)).alias("loaded"))
        parts.append(verdicts.join(there, "batch", "left").select(
            F.lit(number).alias("attempt"), "batch", "status", "load_status", F.coalesce("loaded", F.lit(0)).cast("long").alias("loaded")))
    return reduce(DataFrame.unionByName, parts)


@query("report_fetch", f"""WITH {_KEYS_SQL}
SELECT a.batch, CASE WHEN j.status = 'BLOCKED' THEN 'QUARANTINED' END AS status
FROM (SELECT batch FROM judged UNION ALL SELECT 'never seen') a LEFT JOIN judged j ON a.batch = j.batch""")
def report_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantine report of every batch, or null: passing batches and unknown ones have none."""
    gate = _after(spark, sf_dir)
    orders, keys = _keyed(spark, sf_dir)
    asked = orders.select(P.batch_of(keys).alias("batch")).distinct().unionByName(small_frame(spark, [("never seen",)], "batch string"))
    return gate.store.reports_of("desk", asked).select("batch", "status")


@query("landing_files", """
WITH d AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, COUNT(*) AS rows FROM orders GROUP BY 1)
SELECT 'orders_' || y AS dataset, rows, y % 2 = 0 AS stale, y % 3 = 0 AS unchanged, CASE WHEN y % 2 = 0 THEN 24.0 ELSE 23.5 END AS age_hours FROM d""")
def landing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from orders, one dataset a year, with the times that the file system gives them: age, and whether they changed."""
    root, year = fresh_folder(spark), F.year("o_orderdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("orders_"), year.cast("string")).alias("dataset"))
    orders.hint("rebalance", "dataset").write.option("header", True).partitionBy("dataset").csv(root)
    files = landing.list_files(spark, root).withColumn("dataset", F.regexp_extract("path", "dataset=([^/]+)/", 1))
    newest = files.groupBy("dataset").agg(F.max("mtime").alias("mtime"), F.max("modified").alias("modified"))
    number = F.substring("dataset", 8, 4).cast("int")
    registry = newest.select(F.col("dataset").alias("dataset_name"), F.when(number % 3 == 0, F.col("mtime")).otherwise(F.col("mtime") - 60).alias("last_file_mtime"))
    as_of = F.col("modified") + F.when(number % 2 == 0, F.expr("INTERVAL 24 HOURS")).otherwise(F.expr("INTERVAL 1410 MINUTES"))
    marked = landing.unchanged(landing.timeliness(newest.withColumn("as_of", as_of), F.col("as_of")), registry)
    held = spark.read.option("header", True).csv(root).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    return marked.join(held, "dataset").select("dataset", "rows", "stale", "unchanged", F.round("age_hours", 4).alias("age_hours"))


_VALID = {
    "pass": (Contract.from_dict({"columns": [{"name": "o_orderkey", "data_type": "bigint", "isPrimaryKey": True}, {"name": "o_totalprice", "data_type": "double"}]}, "pass"),
             "SELECT o_orderkey, o_totalprice FROM {view}"),
    "drift": (Contract.from_dict({"columns": [{"name": "o_orderkey", "data_type": "bigint", "isPrimaryKey": True}]}, "drift"),
              "SELECT o_orderkey, o_totalprice FROM {view}"),
    "fail": (Contract.from_dict({"columns": [{"name": "o_custkey", "data_type": "bigint", "isPrimaryKey": True}, {"name": "o_gone", "data_type": "varchar"}]}, "fail"),
             "SELECT o_custkey FROM {view}"),
}


@query("validate_sources", """
WITH d AS (SELECT COUNT(*) - COUNT(DISTINCT o_custkey) AS dup, COUNT(*) - COUNT(DISTINCT o_orderkey) AS own FROM orders),
v AS (
  SELECT 'pass' AS dataset, CASE WHEN own = 0 THEN 'pass' ELSE 'fail' END AS status, 2 + CAST(own = 0 AS INTEGER) AS passed_checks, CAST(own > 0 AS INTEGER) AS failed_checks,
    CASE WHEN own > 0 THEN own || ' duplicates' ELSE '' END AS details FROM d
  UNION ALL SELECT 'drift', CASE WHEN own = 0 THEN 'warning' ELSE 'fail' END, 1 + CAST(own = 0 AS INTEGER), CAST(own > 0 AS INTEGER),
    CASE WHEN own > 0 THEN own || ' duplicates,' ELSE '' END || 'unexpected_column' FROM d
  UNION ALL SELECT 'fail', 'fail', 1 + CAST(dup = 0 AS INTEGER), 1 + CAST(dup > 0 AS INTEGER), CASE WHEN dup > 0 THEN dup || ' duplicates,' ELSE '' END || 'missing_column' FROM d)
SELECT kind || '_' || dataset AS dataset, '{"dataset":"' || kind || '_' || dataset || '","status":"' || status || '","passed_checks":' || passed_checks
  || ',"failed_checks":' || failed_checks || ',"details":"' || details || '"}' AS result
FROM v, (VALUES ('table'), ('query')) AS k(kind)""")
def validate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passing, a drifting and a failing source, each as a table of the catalogue and as a query, with the serialised result."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("sluicework_orders")
    rows = []
    for name, (contract, text) in _VALID.items():
        sql = text.format(view="sluicework_orders")
        spark.sql(sql).createOrReplaceTempView(f"sluicework_{name}")
        for kind, source in (("table", f"sluicework_{name}"), ("query", sql)):
            result = validate(spark, contract, source, kind)
            details = result.issues.agg(F.array_join(F.sort_array(F.collect_list(
                F.when(F.col("issue_type") == "duplicate_primary_key", F.col("actual")).otherwise(F.col("issue_type")))), ",")).first()[0]
            rows.append((f"{kind}_{name}", result.status, result.passed_checks, result.failed_checks, details))
    frame = small_frame(spark, rows, "dataset string, status string, passed_checks int, failed_checks int, details string")
    return S.to_json(frame)
