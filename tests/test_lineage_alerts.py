from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluicework.functions.verdict import with_verdict
from sluicework.operators import alerts as A, lineage as L

LINEAGE = {"datasets": {
    "tides": {"owner": "harbour", "consumers": [{"name": f"berth{k}", "criticality": c} for k, c in enumerate(("low", "Critical", "LOW", None, "high"))],
              "upstream": [{"name": n} for n in ("buoy", "radar", "gauge")]},
    "ferries": {"upstream": [{"name": "radar"}], "consumers": [{"name": "kiosk", "criticality": "seasonal"}]},
    "wrecks": {"owner": "museum"},
}}
ROUTING = {
    "channels": {"horn": {"type": "pagerduty"}, "deck": {"type": "slack"}, "log": {"type": "slack"}},
    "routing": {"WARNING": {"channels": ["log", "horn", "deck"], "required_criticality": ["LOW", "CRITICAL"]},
                "STALE": {"channels": ["deck"]},
                "DEFAULT": {"channels": ["nowhere", "horn"], "required_criticality": ["MEDIUM"]}},
}


def names(spark, *items):
    return spark.createDataFrame([(i,) for i in items], "dataset string")


def test_impact(spark):
    consumers, _, owners = L.edges(spark, LINEAGE)
    got = {r["dataset"]: (r["criticality"], r["consumer_count"], r["owner"])
           for r in L.impact(names(spark, "tides", "ferries", "wrecks", "unknown"), consumers, owners).collect()}
    assert got == {"tides": ("CRITICAL", 5, "harbour"), "ferries": ("SEASONAL", 1, "Unknown"), "wrecks": ("LOW", 0, "museum"),
                   "unknown": ("LOW", 0, "Unknown")}


def test_empty_lineage(spark):
    consumers, _, owners = L.edges(spark, {})
    assert L.impact(names(spark, "x"), consumers, owners).first()["criticality"] == "LOW"


def test_root_cause(spark):
    _, upstreams, _ = L.edges(spark, LINEAGE)
    noon = datetime(2023, 7, 9, 12)
    log = [("radar", noon, "DOWN", "fog"), ("radar", noon.replace(hour=13), "UP", "clear"), ("buoy", noon, "UP", None),
           ("gauge", noon, "DOWN", "frozen"), ("gauge", noon.replace(hour=11), "UP", "fine")]
    health = spark.createDataFrame(log, "upstream string, timestamp timestamp, status string, details string")
    got = {r["dataset"]: (r["down_count"], r["root_cause"]) for r in L.root_cause(names(spark, "tides", "ferries", "wrecks"), upstreams, health).collect()}
    assert got == {"tides": (1, "Upstream Outage: gauge (frozen)"), "ferries": (0, "Local Infrastructure Issue (Upstream services are UP)"),
                   "wrecks": (0, "Local Infrastructure Issue")}
    worse = health.where("details IS NULL OR details <> 'clear'")
    assert L.root_cause(names(spark, "tides"), upstreams, worse).first()["root_cause"] == "Upstream Outage: gauge (frozen), radar (fog)"
    cut = L.root_cause(names(spark, "tides"), upstreams, worse, most=1).first()
    assert (cut["down_count"], cut["root_cause"]) == (2, "Upstream Outage: gauge (frozen) and 1 more")
    rows = {(r["dataset"], r["upstream"], r["down"]) for r in L.outages(upstreams, worse).collect()}
    assert rows == {("tides", "gauge", True), ("tides", "radar", True), ("tides", "buoy", False), ("ferries", "radar", True)}


def test_flow_state(spark):
    consumers, _, _ = L.edges(spark, LINEAGE)
    status = spark.createDataFrame([("tides", "WARNING"), ("wrecks", "BLOCKED")], "dataset string, status string")
    got = {(r["dataset"], r["state"]): r["n"] for r in L.flow_state(consumers, status).groupBy("dataset", "state").agg(
        F.count("*").alias("n")).collect()}
    assert got == {("tides", "reached"): 5, ("ferries", "unknown"): 1}
    held = status.replace("WARNING", "BLOCKED", "status")
    assert {r["state"] for r in L.flow_state(consumers, held).where("dataset = 'tides'").collect()} == {"protected"}


FACTS = ("missing_count int, mismatch_count int, quality_score double, anomaly_count int, max_z double, criticality string, "
         "z_warning double, z_critical double, quality_warn double, quality_block double")


@pytest.mark.parametrize("facts, branch, status", [
    ((1, 0, None, 0, 0.0, "HIGH"), "schema_blocked", "BLOCKED"),
    ((0, 2, 100.0, 5, 9.0, "HIGH"), "schema_blocked", "BLOCKED"),
    ((0, 0, 49.9, 5, 9.0, "LOW"), "quality_blocked", "BLOCKED"),
    ((0, 0, 50.0, 0, 0.0, "LOW"), "quality_warning", "WARNING"),
    ((0, 0, 80.0, 0, 0.0, "LOW"), "passed", "PASSED"),
    ((0, 0, 100.0, 1, 3.01, "HIGH"), "anomaly_blocked", "BLOCKED"),
    ((0, 0, 100.0, 1, 3.01, "CRITICAL"), "anomaly_blocked", "BLOCKED"),
    ((0, 0, 100.0, 1, 3.0, "HIGH"), "anomaly_warning", "WARNING"),  # rounded to the limit: not above it
    ((0, 0, 70.0, 1, 8.0, "LOW"), "anomaly_low", "WARNING"),
    ((0, 0, 100.0, 1, 8.0, "MEDIUM"), "anomaly_warning", "WARNING"),
    ((0, 0, 70.0, 1, 2.5, "LOW"), "quality_warning", "WARNING"),
    ((0, 0, 100.0, 0, 8.0, "HIGH"), "passed", "PASSED"),
])
def test_verdict_branches(spark, facts, branch, status):
    row = with_verdict(spark.createDataFrame([(*facts, 2.5, 3.0, 80.0, 50.0)], FACTS)).first()
    assert (row["branch"], row["status"]) == (branch, status)
    if branch == "schema_blocked":
        assert row["quality_score"] == 0.0 and row["anomaly_count"] == 0 and row["max_z"] == 0.0
    if branch == "quality_warning" and facts[2] == 70.0:
        assert row["reason"] == "Data Quality Score below threshold: 70.0% (threshold: 80%)"
    if branch == "anomaly_blocked":
        assert row["reason"] == "CRITICAL ANOMALY (Z=3.0, threshold=3.0) on HIGH IMPACT dataset."
        assert row["actions"] == ["Quarantine", "Alert Execs"] and row["load_status"] == "SKIPPED (Blocked by Agent)"


def test_routing(spark):
    rules, channels = A.routing_tables(spark, ROUTING)
    rows = [("tides", "WARNING", "high water (Root Cause: moon)", "CRITICAL"), ("ferries", "WARNING", "late", "MEDIUM"),
            ("wrecks", "STALE", "old", "LOW"), ("reefs", "BLOCKED", "sharp", "MEDIUM"), ("sands", "BLOCKED", "soft", "HIGH"), ("shoals", "PASSED", "fine", "LOW")]
    verdicts = spark.createDataFrame([(*r, "crew") for r in rows], "dataset string, status string, reason string, criticality string, owner string")
    got = {(r["dataset"], r["channel"]): r for r in A.payloads(A.route(verdicts, rules, channels)).collect()}
    assert set(got) == {("tides", "log"), ("tides", "horn"), ("tides", "deck"), ("wrecks", "deck"), ("reefs", "horn")}
    assert got["tides", "log"]["root_cause_found"] and not got["reefs", "horn"]["root_cause_found"]
    assert got["reefs", "horn"]["message"] == "INCIDENT TRIGGERED: reefs is BLOCKED | Severity: critical | Summary: sharp | Owner: crew"
    assert got["reefs", "horn"]["rule"] == "DEFAULT" and got["wrecks", "deck"]["rule"] == "STALE"


def test_no_routing_configured(spark):
    rules, channels = A.routing_tables(spark, {})
    verdicts = spark.createDataFrame([("a", "BLOCKED", "r", "HIGH", "o")], "dataset string, status string, reason string, criticality string, owner string")
    assert A.route(verdicts, rules, channels).count() == 0
