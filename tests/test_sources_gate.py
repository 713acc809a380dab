import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluicework.contracts import Contract
from sluicework.plans.gate import Gate
from sluicework.plans.judge import judge
from sluicework.plans.validate import validate
from sluicework.operators import lineage as L, profile as P
from sluicework.plans import fleet
from sluicework.session import move_folders
from sluicework.sources import csv_records, landing, readers, sinks
from sluicework.sources.store import SCHEMAS, Store

AS_OF = datetime(2024, 3, 1, 12)
IDS = Contract.from_dict({"columns": [{"name": "id", "data_type": "varchar", "nullable": False}],
                          "quality": {"custom_checks": [{"name": "short", "sql_condition": "length(id) < 5"}]}}, "stable")


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


# --- readers ---

def test_csv_types_and_null_tokens(spark, tmp_path):
    p = write(tmp_path / "a.csv", "i,d,ts,day,s,b\n1,1.5,2024-01-01 10:00:00,2024-01-01,NA,true\n2,,2024-01-02 00:00:00,2024-01-02,x,false\n")
    df = readers.load(spark, p)
    assert [t for _, t in df.dtypes] == ["int", "double", "timestamp", "date", "string", "boolean"]
    assert [r["s"] for r in df.collect()] == [None, "x"]
    assert df.where("d is null").count() == 1


def test_contract_typed_csv_without_inference(spark, tmp_path):
    p = write(tmp_path / "a.csv", "id,n,at\na,1,2024-01-01\nb,x,nope\nc,NA,\n")
    k = Contract.from_dict({"columns": [{"name": "id"}, {"name": "n", "data_type": "integer"}, {"name": "at", "data_type": "date"}]}, "t")
    raw = readers.read_csv(spark, p, infer=False)
    failures = {r["column_name"]: (r["filled"], r["failures"]) for r in readers.coercion_failures(raw, k).collect()}
    assert failures == {"id": (3, 0), "n": (2, 1), "at": (2, 1)}
    typed = readers.cast_to_contract(raw, k)
    assert typed.dtypes == [("id", "string"), ("n", "bigint"), ("at", "date")]
    assert typed.where("n is not null").count() == 1


def test_parquet_json_table_query(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "s string, n bigint")
    df.write.parquet(str(tmp_path / "p.parquet"))
    df.write.json(str(tmp_path / "j.json"))
    df.createOrReplaceTempView("some_view")
    for source, kind in ((tmp_path / "p.parquet", "parquet"), (tmp_path / "j.json", "json"), ("some_view", "table"),
                         ("SELECT * FROM some_view", "query")):
        assert sorted(readers.load(spark, str(source), kind).columns) == ["n", "s"]
    assert [readers.format_of(p) for p in ("a.parquet", "b.json", "c.csv", "d")] == ["parquet", "json", "csv", "csv"]


@pytest.mark.parametrize("source, kind, issue", [
    ("/nowhere/x.csv", "csv", "file_not_found"), ("x", "xml", "load_error"), ("SELECT nope FROM nothing", "query", "query_error"),
    ("no_such_table", "table", "load_error"),
])
def test_load_errors(spark, source, kind, issue):
    with pytest.raises(readers.SourceError) as e:
        readers.load(spark, source, kind)
    assert e.value.issue_type == issue and e.value.row("d")[3] == issue


def test_validation_of_each_source(spark, tmp_path):
    k = Contract.from_dict({"columns": [{"name": "id", "isPrimaryKey": True}, {"name": "n", "data_type": "integer"}]}, "v")
    p = write(tmp_path / "v.csv", "id,n,extra\na,1,x\na,2,y\n,3,z\n")
    result = validate(spark, k, p)
    assert (result.status, result.passed_checks, result.failed_checks) == ("fail", 2, 1)
    kinds = {r["issue_type"]: r for r in result.issues.collect()}
    assert set(kinds) == {"unexpected_column", "duplicate_primary_key"}
    assert kinds["duplicate_primary_key"]["actual"] == "2 duplicates"
    spark.createDataFrame([("a", 1), ("b", 2)], "ID string, n bigint").createOrReplaceTempView("good_rows")
    for source, kind in (("good_rows", "table"), ("SELECT * FROM good_rows", "query")):
        assert validate(spark, k, source, kind)[:3] == ("pass", 3, 0)
    broken = validate(spark, k, "SELECT nope", "query")
    assert broken.status == "fail" and broken.issues.first()["issue_type"] == "query_error"
    with pytest.raises(FileNotFoundError):
        validate(spark, Contract("x", error="missing", path="x.yaml"), p)


# --- landing ---

@pytest.mark.parametrize("hours, limit, fresh", [(1, 24, True), (48, 24, False), (24, 24, False), (24.5, 24, False), (2, 1, False), (0, 24, True)])
def test_timeliness(spark, tmp_path, hours, limit, fresh):
    p = write(tmp_path / "f.csv", "a\n1\n")
    now = 1_700_000_000
    os.utime(p, (now - hours * 3600, now - hours * 3600))
    ok, error = landing.check_timeliness(spark, p, datetime.fromtimestamp(now), limit)
    assert ok is fresh
    if not fresh:
        assert "TIMELINESS" in error and f"{hours:.1f} hours old" in error and str(limit) in error


def test_missing_file_is_not_timely(spark):
    ok, error = landing.check_timeliness(spark, "/nowhere/f.csv", AS_OF)
    assert not ok and "File not found" in error


def test_listing_finds_csv_only(spark, tmp_path):
    write(tmp_path / "x" / "a.csv", "1")
    write(tmp_path / "b.json", "{}")
    assert [os.path.basename(r["path"]) for r in landing.list_files(spark, str(tmp_path)).collect()] == ["a.csv"]


# --- store ---

def test_registry_keeps_last_known_values(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.registry().count() == 0
    t = datetime(2024, 1, 1)
    rows = [("a", "p1", "active", "HIGH", t, "PASSED", 1000.0), ("a", "p2", "active", "LOW", t + timedelta(hours=1), "BLOCKED", 2000.0),
            ("a", "p3", "active", "LOW", t + timedelta(hours=2), None, None)]
    for r in rows:
        store.append("dataset_registry", spark.createDataFrame([r], SCHEMAS["dataset_registry"]))
    row = store.registry().first()
    assert (row["scan_count"], row["last_status"], row["last_file_mtime"], row["contract_path"], row["criticality"]) == (
        3, "BLOCKED", 2000.0, "p3", "LOW")


def test_baselines_are_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for mean, kind, at in ((1000.0, "global", 1), (1050.0, "seasonal", 2)):
        store.append("learned_thresholds", spark.createDataFrame(
            [("ds", "row_count", mean, 50.0, kind, datetime(2024, 1, at), 10)], SCHEMAS["learned_thresholds"]))
    rows = store.baselines().collect()
    assert len(rows) == 1 and rows[0]["baseline_mean"] == 1050.0 and rows[0]["baseline_type"] == "seasonal"


def test_store_prunes_to_the_dataset(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("r", datetime(2024, 1, 1), d, "m", 1.0, 0) for d in ("2024", "b")]
    store.append("metric_history", spark.createDataFrame(rows, SCHEMAS["metric_history"]))
    one = store.read("metric_history", "2024")
    assert one.first()["dataset_name"] == "2024" and one.count() == 1
    assert "PartitionFilters: [isnotnull(dataset_name" in one._jdf.queryExecution().executedPlan().toString()


# --- gate ---

def gate(spark, tmp_path, **kw):
    return Gate(spark, str(tmp_path / "gate"), **kw)


def test_clean_file_is_loaded_and_recorded(spark, tmp_path):
    g = gate(spark, tmp_path)
    p = write(tmp_path / "stable.csv", "id\na\nb\nc\n")
    row = g.evaluate_file(p, IDS, as_of=AS_OF).first()
    assert (row["status"], row["load_status"], row["quality_score"], row["reason"]) == ("PASSED", "LOADED", 100.0, "All checks passed.")
    assert spark.read.parquet(str(tmp_path / "gate/warehouse/stable")).count() == 3
    run = g.store.read("run_history").first()
    assert run["status"] == "PASSED" and run["duration_ms"] > 0
    assert {r["metric_name"] for r in g.store.read("metric_history").collect()} == {"row_count", "null_rate_id"}
    assert g.store.registry().first()["scan_count"] == 1


def test_schema_violation_quarantines_with_a_report(spark, tmp_path):
    g = gate(spark, tmp_path)
    k = Contract.from_dict({"columns": [{"name": "id"}, {"name": "gone"}]}, "bad")
    row = g.evaluate_file(write(tmp_path / "bad.csv", "id,x\na,1\n"), k, as_of=AS_OF).first()
    assert row["status"] == "BLOCKED" and row["reason"] == "Schema Violation: Missing 1 cols, 0 mismatches."
    assert not os.path.exists(tmp_path / "gate/warehouse/bad")
    assert spark.read.parquet(str(tmp_path / "gate/quarantine/bad")).count() == 1
    report = g.store.quarantine_report("bad", "all").first()
    assert report["total_errors"] == 1 and report["status"] == "QUARANTINED"
    assert json.loads(report["report"])["schema_errors"] == ["Column 'gone' is missing from the data"]
    assert g.store.quarantine_report("bad", "other").first() is None
    assert g.store.read("run_history").first()["quality_score"] == 0.0
    assert g.store.read("metric_history").count() == 0


def test_missing_file_is_blocked_and_not_recorded(spark, tmp_path):
    g = gate(spark, tmp_path)
    row = g.evaluate_file(str(tmp_path / "none.csv"), IDS).first()
    assert row["status"] == "BLOCKED" and row["reason"].startswith("File not found") and row["actions"] == ["Abort"]
    assert g.store.read("run_history").count() == 0


def test_batches_are_split_by_their_verdict(spark, tmp_path):
    g = gate(spark, tmp_path)
    k = Contract.from_dict({"columns": [{"name": "v", "data_type": "bigint", "max_value": 10}]}, "mixed")
    df = spark.range(90).select(F.when(F.col("id") % 3 == 0, 50).otherwise(1).cast("bigint").alias("v"),
                                F.when(F.col("id") % 3 == 0, "bad").otherwise("good").alias("day"))
    rows = {r["batch"]: r for r in g.evaluate(df, k, batch="day", as_of=AS_OF).collect()}
    assert rows["bad"]["status"] == "BLOCKED" and rows["good"]["status"] == "PASSED"
    assert {(r["v"], r["batch_key"]) for r in spark.read.parquet(str(tmp_path / "gate/warehouse/mixed")).collect()} == {(1, "good")}
    assert spark.read.parquet(str(tmp_path / "gate/quarantine/mixed")).count() == 30
    # judging the same batch again replaces it
    g.evaluate(df, k, batch="day", as_of=AS_OF)
    assert spark.read.parquet(str(tmp_path / "gate/warehouse/mixed")).count() == 60


def test_every_row_gets_its_batch_status(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("b"))
    verdicts = df.select(F.col("b").alias("batch")).distinct().withColumn(
        "status", F.when(F.col("batch") == "hot", "BLOCKED").otherwise("PASSED"))
    joined = sinks.by_verdict(df, verdicts, "b")
    assert {(r["id"], r["status"]) for r in joined.collect()} == {(i, "BLOCKED" if i % 3 == 0 else "PASSED") for i in range(500)}


@pytest.mark.parametrize("error, status, load", [
    ("Connection refused by host", "WARNING", "SKIPPED (Infra Error)"), ("disk full", "BLOCKED", "disk full")])
def test_load_failures(spark, tmp_path, error, status, load):
    def sink(rows, dataset):
        raise RuntimeError(error)

    lineage = {"datasets": {"stable": {"upstream": [{"name": "Auth"}]}}}
    health = spark.createDataFrame([("Auth", AS_OF, "DOWN", "timeout")], "upstream string, timestamp timestamp, status string, details string")
    g = gate(spark, tmp_path, sink=sink, lineage=lineage, health=health)
    row = g.evaluate(spark.createDataFrame([("a",)], "id string"), IDS, as_of=AS_OF).first()
    assert (row["status"], row["load_status"]) == (status, load)
    assert ("Root Cause: Upstream Outage: Auth (timeout)" in row["reason"]) is (status == "WARNING")
    assert ("Load Failed" in row["reason"]) is (status == "BLOCKED")


def test_check_that_fails_while_running_counts_as_failed(spark, tmp_path):
    k = Contract.from_dict({"columns": [{"name": "id"}], "quality": {"custom_checks": [
        {"name": "boom", "sql_condition": "CAST(id AS INT) > 0"}, {"name": "fine", "sql_condition": "id <> ''"}]}}, "risky")
    row = gate(spark, tmp_path).evaluate(spark.createDataFrame([("a",), ("1",)], "id string"), k, as_of=AS_OF).first()
    checks = {c["name"]: c for c in row["checks"]}
    assert checks["fine"]["passed"] and not checks["boom"]["passed"] and "CAST" in checks["boom"]["error"]
    assert row["quality_score"] == 97.0


def test_history_is_learnt_and_used(spark, tmp_path):
    lineage = {"datasets": {"vol": {"owner": "o", "consumers": [{"name": "c", "criticality": "HIGH"}]}}}
    g = gate(spark, tmp_path, lineage=lineage, alerts={
        "channels": {"chat": {"type": "slack"}}, "routing": {"DEFAULT": {"channels": ["chat"]}}})
    k = Contract.from_dict({"columns": [{"name": "v", "data_type": "bigint"}, {"name": "day", "data_type": "date"}]}, "vol")
    days = spark.range(1000).select(
        (F.col("id") % 7).alias("v"), F.expr("date_add(DATE'2024-01-01', CAST(id % 10 AS INT))").alias("day"))
    first = g.evaluate(days, k, batch="day", at=F.to_timestamp("batch"), as_of=AS_OF, against="earlier")
    assert first.count() == 10
    assert g.store.read("metric_history", "vol").where("metric_name = 'row_count'").count() >= 3
    late = spark.createDataFrame([(1,)], "v bigint").withColumn("day", F.expr("DATE'2024-02-01'"))
    row = g.evaluate(late, k, as_of=datetime(2024, 2, 1)).first()
    assert row["status"] == "BLOCKED" and row["max_z"] >= 10.0 and row["owner"] == "o"
    assert g.alerts_for(g.evaluate(late, k, as_of=datetime(2024, 2, 1), take_action=False)).first()["channel"] == "chat"
    assert g.store.read("learned_thresholds", "vol").count() >= 1


def test_evaluate_all(spark, tmp_path):
    g = gate(spark, tmp_path)
    paths = {"stable": write(tmp_path / "stable.csv", "id\na\nb\n"), "old": write(tmp_path / "old.csv", "id\na\n"),
             "broken": write(tmp_path / "broken.csv", "id\na\n")}
    old = Contract.from_dict({"info": {"lifecycle": "deprecated"}, "columns": [{"name": "id"}]}, "old")
    contracts = [IDS, old, Contract.from_dict({"columns": [{"name": "id"}]}, "no_data"), Contract("broken", error="bad yaml", path="b.yaml")]
    results, totals = g.evaluate_all(contracts, paths, as_of=AS_OF)
    status = {r["dataset"]: r["status"] for r in results.collect()}
    assert status == {"stable": "PASSED", "old": "SKIPPED", "no_data": "SKIPPED", "broken": "BLOCKED"}
    assert totals.first().asDict() == {"total": 4, "passed": 1, "warning": 0, "blocked": 1, "skipped": 2, "unchanged": 0}
    again, totals = g.evaluate_all(contracts, paths, skip_unchanged=True, as_of=AS_OF)
    assert {r["dataset"]: r["status"] for r in again.collect()}["stable"] == "UNCHANGED" and totals.first()["unchanged"] == 1


def test_process_stages_or_quarantines(spark, tmp_path):
    g = gate(spark, tmp_path)
    good = g.process(spark.createDataFrame([("a",)], "id string"), IDS, AS_OF)
    assert (good["overall_status"], good["action_taken"]) == ("PASS", "STAGED")
    assert spark.read.parquet(good["new_location"]).count() == 1
    assert g.store.read("staging_log").first()["status"] == "APPROVED"
    bad = g.process(spark.createDataFrame([(None,)], "id string"), IDS, AS_OF)
    assert (bad["overall_status"], bad["action_taken"]) == ("FAIL", "QUARANTINED")
    assert spark.read.parquet(bad["new_location"]).count() == 1
    names = [r["path"] for r in landing.list_files(spark, str(tmp_path / "gate" / "quarantine"), "*.parquet").collect()]
    assert names and all("20240301_120000" in n for n in names)


def test_error_summary(spark):
    df = spark.createDataFrame([(False, ["a"], ["b", "c"]), (None, None, [])],
                               "timeliness_passed boolean, schema_errors array<string>, profiling_errors array<string>")
    assert [r["total_errors"] for r in sinks.error_summary(df).collect()] == [4, 0]


def test_judging_scans_the_data_once_per_use(spark, tmp_path):
    """The verdict hangs on the stored summary, not on the data."""
    spark.range(100).select(F.col("id").cast("string").alias("id")).write.parquet(str(tmp_path / "d.parquet"))
    df = spark.read.parquet(str(tmp_path / "d.parquet"))
    consumers, _, owners = L.edges(spark, {})
    impact = L.impact(spark.createDataFrame([("stable",)], "dataset string"), consumers, owners)
    verdicts, _, _ = judge(df, IDS, spark.createDataFrame([], SCHEMAS["metric_history"]), impact, as_of=AS_OF, folder=str(tmp_path / "work"))
    assert "d.parquet" not in verdicts._jdf.queryExecution().optimizedPlan().toString()
    assert verdicts.count() == 1


# --- nothing is lost ---

MIXED = Contract.from_dict({"columns": [{"name": "v", "data_type": "bigint", "max_value": 10}]}, "mixed")


def keyed(spark):
    pairs = [("a|b", "c", 1), ("a", "b|c", 50), ("a", None, 1), (None, "a", 50), (None, "a", 60), ("", "2024-01-01 10:00:00", 1)]
    return spark.createDataFrame(pairs, "x string, y string, v bigint")


def test_null_and_odd_batch_keys_are_written_whole(spark, tmp_path):
    g = gate(spark, tmp_path)
    df = keyed(spark)
    verdicts = g.evaluate(df, MIXED, batch=["x", "y"], as_of=AS_OF).collect()
    assert len(verdicts) == 5 and sum(r["total_rows"] for r in verdicts) == df.count()
    loaded = spark.read.parquet(str(tmp_path / "gate/warehouse/mixed")).collect()
    held = spark.read.parquet(str(tmp_path / "gate/quarantine/mixed")).collect()
    assert sorted(r["v"] for r in loaded) == [1, 1, 1] and sorted(r["v"] for r in held) == [50, 50, 60]
    for report in g.store.read("quarantine_reports").collect():
        assert os.path.isdir(tmp_path / "gate" / report["location"])
    assert not os.listdir(tmp_path / "gate" / "_work")


def test_process_sends_each_batch_where_its_verdict_says(spark, tmp_path):
    g = gate(spark, tmp_path)
    result = g.process(keyed(spark), MIXED, AS_OF, batch=["x", "y"])
    assert (result["overall_status"], result["action_taken"]) == ("FAIL", "SPLIT")
    rows = result["batches"].collect()
    assert sorted((r["status"], r["action_taken"]) for r in rows) == [("BLOCKED", "QUARANTINED")] * 2 + [("PASSED", "STAGED")] * 3
    assert all(os.path.isdir(tmp_path / "gate" / r["location"]) for r in rows)
    assert spark.read.parquet(str(tmp_path / "gate/staging/mixed")).count() == 3
    assert spark.read.parquet(str(tmp_path / "gate/quarantine/mixed")).count() == 3


def test_a_repeated_run_is_recorded_once(spark, tmp_path):
    g = gate(spark, tmp_path)
    for _ in range(2):
        g.evaluate(spark.createDataFrame([("a",)], "id string"), IDS, as_of=AS_OF)
    assert g.store.read("run_history").count() == 1
    assert g.store.read("metric_history").count() == 2
    g.store.compact("run_history")
    assert g.store.read("run_history").count() == 1


def test_error_without_text_and_long_error(spark, tmp_path):
    for error, state in ((ValueError(), "ValueError"), (RuntimeError("first\nsecond"), "first\nsecond")):
        def sink(rows, dataset, error=error):
            raise error
        row = gate(spark, tmp_path, sink=sink).evaluate(spark.createDataFrame([("a",)], "id string"), IDS, as_of=AS_OF).first()
        assert (row["status"], row["load_status"]) == ("BLOCKED", state)


def test_rows_of_csv(spark, tmp_path):
    with pytest.raises(readers.SourceError) as e:
        readers.load(spark, write(tmp_path / "wide.csv", "a,b\n1,2\n3,4,5,6\n"))
    assert e.value.issue_type == "load_error" and "more than 2 values" in e.value.message
    short = readers.load(spark, write(tmp_path / "short.csv", "a,b\n1,2\n3\n"))
    assert [tuple(r) for r in short.collect()] == [(1, 2), (3, None)]
    broken = readers.load(spark, write(tmp_path / "broken.csv", 'a,b\n1,"two\nlines, and ""quotes"""\n2,x\n'))
    assert [tuple(r) for r in broken.collect()] == [(1, 'two\nlines, and "quotes"'), (2, "x")]
    g = gate(spark, tmp_path)
    assert g.evaluate_file(str(tmp_path / "wide.csv"), IDS).first()["status"] == "BLOCKED"


def test_json_over_several_lines(spark, tmp_path):
    df = readers.load(spark, write(tmp_path / "a.json", '[\n {"n": 1,\n  "s": "x"},\n {"n": 2, "s": "y"}\n]\n'), "json")
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(readers.SourceError):
        readers.load(spark, write(tmp_path / "b.json", '{"n": 1}\n{"n": \n'), "json")


def test_a_stale_file_is_blocked_before_it_is_read(spark, tmp_path):
    p = write(tmp_path / "old.csv", "id\na\n")
    os.utime(p, (1_700_000_000 - 90_000,) * 2)
    g = gate(spark, tmp_path)
    late = g.evaluate_file(p, IDS, as_of=datetime.fromtimestamp(1_700_000_000), max_age_hours=24).first()
    assert late["status"] == "BLOCKED" and "TIMELINESS" in late["reason"]
    assert g.evaluate_file(p, IDS, as_of=datetime.fromtimestamp(1_700_000_000), max_age_hours=26).first()["status"] == "PASSED"


def test_verdict_row_names_drift_and_anomalies(spark, tmp_path):
    g = gate(spark, tmp_path)
    k = Contract.from_dict({"columns": [{"name": "v", "data_type": "bigint"}]}, "vol")
    days = spark.range(1000).select((F.col("id") % 7).alias("v"), F.expr("date_add(DATE'2024-01-01', CAST(id % 10 AS INT))").alias("day"))
    g.evaluate(days, k, batch="day", at=F.to_timestamp("batch"), as_of=AS_OF, against="earlier")
    with pytest.raises(ValueError):
        g.evaluate(days, k, batch="day", as_of=AS_OF, against="earlier")
    row = g.evaluate(spark.range(3).select(F.col("id").alias("v"), F.lit("x").alias("extra")), k, as_of=datetime(2024, 2, 1)).first()
    found = {a["metric_name"]: a for a in row["anomalies"]}
    assert row["new_columns"] == ["extra"] and row["missing_columns"] == [] and row["anomaly_count"] == len(found)
    assert found["row_count"]["metric_value"] == 3.0 and found["row_count"]["baseline_mean"] == 100.0 and found["row_count"]["z_score"] == -10.0


def test_rows_are_brought_together_before_they_are_written(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 16).select("id", (F.col("id") % 40).cast("string").alias("batch_key"))
    sinks.write_batches(rows, str(tmp_path / "out"))
    files = landing.list_files(spark, str(tmp_path / "out"), "*.parquet").count()
    assert files == 40 and spark.read.parquet(str(tmp_path / "out")).count() == 4000


# --- loads are repeated, runs collide, many datasets at once ---

def test_a_load_that_failed_is_repeated_and_a_whole_one_is_not(spark, tmp_path):
    target, failures = str(tmp_path / "target"), ["Connection refused", "disk full"]

    def sink(rows, dataset):
        if failures:
            raise RuntimeError(failures.pop(0))
        rows.write.mode("append").parquet(target)

    g = gate(spark, tmp_path, sink=sink)
    got = []
    for hour in range(5):
        df = keyed(spark) if hour < 4 else keyed(spark).unionByName(keyed(spark).where("y = 'c'"))  # a batch has one more row
        rows = g.evaluate(df, MIXED, batch=["x", "y"], as_of=AS_OF.replace(hour=hour)).collect()
        got.append({(r["status"], r["load_status"]) for r in rows if r["max_z"] == 0 and r["status"] != "BLOCKED" or r["load_status"] == "disk full"})
    assert got[:4] == [{("WARNING", "SKIPPED (Infra Error)")}, {("BLOCKED", "disk full")}, {("PASSED", "LOADED")}, {("PASSED", "LOADED")}]
    loaded = [r["v"] for r in spark.read.parquet(target).collect()]
    assert len(loaded) == 3 + 2  # three batches once, then the changed one with both its rows
    states = {(r["batch"], r["state"]): r["rows"] for r in g.store.read("load_log").collect()}
    assert {s for _, s in states} == {"FAILED", "LOADED"} and states["a\\|b|c", "LOADED"] in (1, 2)


def test_checksums_tell_copies_apart_and_know_no_order(spark):
    def checksum(*values):
        rows = spark.createDataFrame([(v, "all") for v in values], "v int, batch_key string")
        return sinks.load_records(rows, "d", "a", F.lit(AS_OF), "LOADED").first()["checksum"]

    assert checksum(1, 2, 3) == checksum(3, 1, 2) and len({checksum(1, 1), checksum(1, 1, 1), checksum(2, 2), checksum(1, 2)}) == 4


def test_runs_within_a_second_do_not_replace_each_other(spark, tmp_path):
    g = gate(spark, tmp_path)
    bad = spark.createDataFrame([(None,)], "id string")
    for micros in (1, 2):
        g.evaluate(bad, IDS, as_of=AS_OF.replace(microsecond=micros))
    assert spark.read.parquet(str(tmp_path / "gate/quarantine/stable")).count() == 2


def test_moving_goes_on_where_it_was_stopped(spark, tmp_path):
    rows = spark.range(40).select("id", (F.col("id") % 4).cast("string").alias("batch_key"), F.lit("warehouse").alias("destination"))
    sinks.write_divided(rows, str(tmp_path / "attempt"))
    here, there = tmp_path / "attempt" / "destination=warehouse", tmp_path / "warehouse"
    there.mkdir()
    os.rename(here / "batch_key=2", there / "batch_key=2")  # what a killed run had moved already
    for _ in range(2):
        move_folders(spark, str(here), str(there))
    assert spark.read.parquet(str(there)).count() == 40
    move_folders(spark, str(tmp_path / "nothing"), str(there))


def test_the_source_is_read_once_for_all_destinations(spark, tmp_path):
    keyed(spark).write.parquet(str(tmp_path / "src"))
    df = spark.read.parquet(str(tmp_path / "src"))
    verdicts = df.select(P.batch_of(["x", "y"]).alias("batch"), F.when(F.col("v") > 10, "BLOCKED").otherwise("PASSED").alias("status")).distinct()
    verdicts.write.parquet(str(tmp_path / "verdicts"))
    divided = sinks.by_verdict(df, spark.read.parquet(str(tmp_path / "verdicts")), ["x", "y"])
    plan = divided._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/src") == 1


def fleet_of(spark, tmp_path, n):
    contracts, paths = [], {}
    for k in range(n):
        paths[f"d{k}"] = str(tmp_path / f"d{k}.parquet")
        spark.range(20).select(F.col("id").alias(f"c{k}"), (F.col("id") % 3).cast("string").alias("s")).write.parquet(paths[f"d{k}"])
        contracts.append(Contract.from_dict({"columns": [{"name": f"c{k}", "data_type": "bigint", "isPrimaryKey": True}, {"name": "s"}]}, f"d{k}"))
    return contracts, paths


def test_jobs_do_not_grow_with_datasets(spark, tmp_path):
    jobs = []
    for n in (2, 6):
        contracts, paths = fleet_of(spark, tmp_path / str(n), n)
        g = Gate(spark, str(tmp_path / f"gate{n}"))
        sets = [fleet.Dataset(spark.read.parquet(paths[k.dataset]), k) for k in contracts]
        spark.sparkContext.setJobGroup(f"fleet{n}", "")
        done = fleet.judge_all(spark, sets, g.store.read("metric_history"), g.impact, AS_OF, str(tmp_path / f"work{n}"), lambda _, k: k)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fleet{n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r["status"] for r in done.verdicts.collect()} == {"PASSED"} and done.verdicts.count() == n and not done.errors
    assert jobs[1] == jobs[0]


def test_a_dataset_that_cannot_be_read_does_not_stop_the_others(spark, tmp_path):
    contracts, paths = fleet_of(spark, tmp_path, 4)
    for f in os.listdir(paths["d2"]):
        if f.endswith(".parquet"):
            whole = open(os.path.join(paths["d2"], f), "rb").read()
            open(os.path.join(paths["d2"], f), "wb").write(whole[:4] + b"\0" * 40 + whole[44:])
    for f in os.listdir(paths["d2"]):
        if f.endswith(".crc"):
            os.remove(os.path.join(paths["d2"], f))
    risky = Contract.from_dict({"columns": [{"name": "s"}], "quality": {"custom_checks": [{"name": "boom", "sql_condition": "CAST(concat(s, 'x') AS INT) > 0"}]}}, "d3")
    results, totals = gate(spark, tmp_path).evaluate_all([*contracts[:3], risky], paths, as_of=AS_OF)
    got = {r["dataset"]: (r["status"], r["reason"]) for r in results.collect()}
    assert got["d0"][0] == got["d1"][0] == "PASSED" and got["d2"][0] == "BLOCKED"
    assert got["d3"][0] in ("PASSED", "WARNING") and totals.first()["blocked"] == 1
    assert spark.read.parquet(str(tmp_path / "gate/warehouse/d0")).count() == 20


def test_reports_of_asked_batches(spark, tmp_path):
    g = gate(spark, tmp_path)
    g.evaluate(keyed(spark), MIXED, batch=["x", "y"], as_of=AS_OF)
    asked = spark.createDataFrame([("a|b\\|c",), ("nobody",)], "batch string")
    got = {r["batch"]: r["status"] for r in g.store.reports_of("mixed", asked).collect()}
    assert got == {"a|b\\|c": "QUARANTINED", "nobody": None}


# --- CSV records over lines and splits ---

def test_quoted_line_breaks_are_read_in_splits(spark, tmp_path):
    rows = [(k, f'say "{k}"\n' * (k % 4) + "x" * (k % 7) + ("," if k % 3 else "\r\n\n"), None if k % 5 else k / 4) for k in range(3000)]
    rows[700] = (700, "long\n" * 9000 + '"', 1.0)  # over many splits
    df = spark.createDataFrame(rows, "k int, t string, v double")
    df.coalesce(2).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "c"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        text = spark.read.text(str(tmp_path / "c"))
        assert text.rdd.getNumPartitions() > 10
        found, inside = csv_records.inside_quotes(spark, str(tmp_path / "c"))
        assert found and len(inside) >= 5
        got = readers.load(spark, str(tmp_path / "c"))
        assert got.dtypes == [("k", "int"), ("t", "string"), ("v", "double")]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_types_of_records(spark, tmp_path):
    p = write(tmp_path / "t.csv", 'i,b,l,d,w,ts,n,e,s\n1,true,3000000000,1.5,2024-01-01,2024-01-01 10:00:00,NA,,"a\nb"\n2,FALSE,1,2,2024-01-02,2024-01-02T11:00:00,null,,007x\n')
    df = readers.load(spark, p)
    assert [t for _, t in df.dtypes] == ["int", "boolean", "bigint", "double", "date", "timestamp", "string", "string", "string"]
    assert [r["s"] for r in df.orderBy("i").collect()] == ["a\nb", "007x"] and df.where("n IS NULL AND e IS NULL").count() == 2
    with pytest.raises(readers.SourceError) as e:
        readers.load(spark, write(tmp_path / "w.csv", 'a,b\n1,"x\ny"\n3,4,5\n'))
    assert "more than 2 values" in e.value.message
    open_end = readers.load(spark, write(tmp_path / "o.csv", 'a,b\n1,x\n2,"never closed\n3,y\n'))
    assert open_end.count() == 2


def _runs(spark, ids):
    return spark.createDataFrame([(f"r{i}", "orders" if i % 2 else "items", "PASSED", float(i)) for i in ids],
                                 "run_id string, dataset_name string, status string, quality_score double").selectExpr(
        "run_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, quality_score) AS timestamp", "dataset_name", "status", "quality_score",
        "0 AS anomaly_count", "0.0D AS z_score_max", "'' AS reason", "1 AS duration_ms")


def _ids(store):
    return sorted(int(r.run_id[1:]) for r in store.read("run_history").collect())


def test_compaction_keeps_appends_that_end_while_it_runs(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.compact("run_history")  # nothing yet
    assert _ids(store) == []
    for i in range(4):
        store.append("run_history", _runs(spark, [i, i + 10]))
    publish = Store._publish

    def late(self, table, record):
        self.append("run_history", _runs(spark, [50]))  # ends between the listing and the new record
        publish(self, table, record)
        self.append("run_history", _runs(spark, [51]))

    monkeypatch.setattr(Store, "_publish", late)
    store.compact("run_history")
    want = [0, 1, 2, 3, 10, 11, 12, 13, 50, 51]
    assert _ids(store) == want
    assert store._stored("run_history", store._live("run_history", store._generation("run_history"))).count() == len(want)  # no row twice
    assert [r.run_id for r in store.read("run_history", "orders").where("quality_score < 2").collect()] == ["r1"]
    monkeypatch.undo()
    reader = store.read("run_history")  # planned over the folders of this generation
    store.compact("run_history")
    assert _ids(store) == want and len(store._live("run_history", store._generation("run_history"))) == 1
    assert reader.count() == len(want)
    store.append("run_history", _runs(spark, [0, 60]))
    assert _ids(store) == [*want, 60]  # run 0 is there once, as its newest row


def test_compaction_that_stops_anywhere_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    for i in range(3):
        store.append("run_history", _runs(spark, [i]))
    for step in ("_publish", "_add"):
        def stop(*_):
            raise OSError("executor of the driver lost")
        monkeypatch.setattr(Store, step, stop)
        with pytest.raises(OSError):
            store.compact("run_history")
        monkeypatch.undo()
        assert _ids(store) == [0, 1, 2]
    store.compact("run_history")
    # a second compaction with the same number loses and leaves the table as it is
    taken = store._generation("run_history")
    monkeypatch.setattr(Store, "_generation", lambda self, table: {"number": 0, "base": None, "replaced": []})
    store.append("run_history", _runs(spark, [7]))
    with pytest.raises(FileExistsError):
        store.compact("run_history")
    monkeypatch.undo()
    assert store._generation("run_history") == taken
    assert _ids(store) == [0, 1, 2, 7]
    assert len(os.listdir(tmp_path / "run_history" / "_generations")) <= 4  # the record, a hidden one and their checksums
