import json

import pytest
from pyspark.sql import functions as F, types as T

from sluicework.contracts import Contract, declared_columns, discover, load_contract, rule_rows, rule_table
from sluicework.functions.types import accepted
from sluicework.operators import lineage as L, profile as P, schema as S
from sluicework.plans import reports as R
from sluicework.plans.judge import schema_gate


def contract(*columns, **quality):
    return Contract.from_dict(
        {"columns": [dict(zip(("name", "data_type"), c)) if isinstance(c, tuple) else c for c in columns],
         "quality": quality}, "t")


def gate(spark, k, ddl):
    return schema_gate(spark.createDataFrame([], ddl), k)


def test_matching_schema_is_clean(spark):
    found = gate(spark, contract(("a", "varchar"), ("b", "double")), "a string, b double")
    assert found == {"missing_columns": [], "new_columns": [], "type_mismatches": [], "passed_checks": 2}


def test_missing_new_and_mismatched_columns(spark):
    k = contract(("a", "varchar"), {"name": "gone", "data_type": "int", "nullable": True}, ("c", "date"))
    found = gate(spark, k, "a string, c timestamp, extra int")
    assert found["missing_columns"] == ["gone"]  # even though nullable
    assert found["new_columns"] == ["extra"]
    assert found["type_mismatches"] == [{"column": "c", "expected": "date", "actual": "timestamp"}]


def test_names_match_without_case(spark):
    assert gate(spark, contract(("Amount", "double")), "aMOUNT double")["passed_checks"] == 1


@pytest.mark.parametrize("declared, kind, ok", [
    ("integer", T.LongType(), True), ("bigint", T.IntegerType(), True), ("long", T.LongType(), True),
    ("int", T.ShortType(), False), ("float", T.DoubleType(), False), ("numeric", T.DoubleType(), True),
    ("numeric", T.DecimalType(10, 2), True), ("decimal", T.DecimalType(10, 2), True), ("double", T.DecimalType(10, 2), False),
    ("hugeint", T.DecimalType(38, 0), True), ("hugeint", T.DecimalType(20, 0), False),
    ("date", T.TimestampType(), False), ("timestamp", T.DateType(), False), ("datetime", T.TimestampNTZType(), True),
    ("text", T.StringType(), True), ("varchar", T.LongType(), False), ("blob", T.BinaryType(), True),
    ("bool", T.BooleanType(), True), ("list", T.ArrayType(T.LongType()), True), ("struct", T.ArrayType(T.LongType()), False),
    ("tinyint", T.ByteType(), True), ("interval", T.DayTimeIntervalType(), True),
])
def test_type_compatibility(declared, kind, ok):
    assert (declared in accepted(kind)) is ok


def test_precision_is_ignored(spark):
    assert gate(spark, contract(("p", "DECIMAL(10,2)")), "p decimal(18,4)")["passed_checks"] == 1


def test_issue_rows_fold_to_status(spark):
    k = contract(("a", "varchar"), ("b", "double"))
    schemas = {"t": T.StructType.fromDDL("a string, x int")}
    found = S.issues(S.compare(declared_columns(spark, [k]), S.observed_columns(spark, schemas)))
    rows = {r["issue_type"]: r for r in found.collect()}
    assert rows["missing_column"]["severity"] == "fail" and rows["missing_column"]["actual"] == "<not found>"
    assert rows["unexpected_column"]["severity"] == "warning"
    assert S.fold(found).first().asDict() == {"dataset": "t", "status": "fail", "total_issues": 2, "failed_checks": 1}
    only_new = found.where("issue_type = 'unexpected_column'")
    assert S.fold(only_new).first()["status"] == "warning"
    assert json.loads(S.to_json(S.fold(found)).first()["result"])["status"] == "fail"


def test_key_duplicates_count_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    row = S.key_duplicates(df, "k").first()
    assert (row["total_rows"], row["distinct_keys"], row["duplicate_count"]) == (4, 2, 2)
    assert S.key_duplicates(df.limit(0), "k").first()["duplicate_count"] == 0


def test_change_log(spark):
    rows = [("t", 1, "a", "int"), ("t", 1, "b", "int"), ("t", 2, "a", "long"), ("t", 2, "c", "int"), ("t", 5, "a", "long"),
            ("t", 5, "c", "int"), ("u", 3, "z", "int")]
    snaps = spark.createDataFrame(rows, "dataset string, version int, column_name string, data_type string")
    log = {(r["version"], r["column_name"], r["change"]) for r in S.change_log(snaps).collect()}
    assert log == {(2, "a", "retyped"), (2, "b", "removed"), (2, "c", "added")}


def test_removed_columns_are_refused(spark):
    ddl = "dataset string, column_name string"
    old = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "x")], ddl)
    new = spark.createDataFrame([("t", "a"), ("u", "x"), ("u", "y")], ddl)
    assert {r["dataset"]: r["accepted"] for r in S.keeps_columns(old, new).collect()} == {"t": False, "u": True}


def test_rule_table(spark, test_contract):
    rules = [(r[3], r[2]) for r in rule_rows(test_contract)]
    assert rules == [("rowCount", None), ("notNull", "crate"), ("notNull", "gross_kg"), ("notNull", "packed"),
                     ("range", "gross_kg"), ("sql", None)]
    stamped = contract({"name": "seen", "data_type": "timestamp"})
    assert [r[3] for r in rule_rows(stamped)] == ["freshness"]
    open_end = contract({"name": "x", "data_type": "int", "min_value": 3}, max_rows=5)
    assert rule_rows(open_end)[0][4:6] == (3.0, float("inf"))  # and no rowCount without min_rows
    assert rule_table(spark, [test_contract]).count() == 6


def test_check_without_name_or_severity(spark):
    k = Contract.from_dict({"columns": [], "quality": {"custom_checks": [{"sql_condition": "x > 1"}, {"name": "own", "sql_condition": "x < 9"}]}}, "t")
    assert [(r[7], r[8], r[9]) for r in rule_rows(k)] == [("Custom Check", "x > 1", "error"), ("own", "x < 9", "error")]
    profiles = P.profile(P.summarise(spark.range(3).select(F.col("id").alias("x")), k), k)
    assert [(c["name"], c["severity"]) for c in profiles.first()["checks"]] == [("Unnamed Check", "warning"), ("own", "warning")]
    got = {(r["check_name"], r["passed"], r["violation_count"]) for r in P.rule_outcomes(profiles, rule_table(spark, [k])).collect()}
    assert got == {("Custom Check", False, 2), ("own", True, 0)}


def test_discovery_skips_backups_and_reports_errors(spark, tmp_path):
    (tmp_path / "alpha.json").write_text(json.dumps({
        "info": {"owner": "Team", "domain": "d", "version": "2.0.0"}, "columns": [{"name": "a"}, {"name": "b"}],
        "quality": {"custom_checks": [{"name": "c", "sql_condition": "1=1"}]}}))
    (tmp_path / "beta.json").write_text("{broken")
    (tmp_path / "alpha.backup_20260101_000000.json").write_text("{}")
    found = discover(tmp_path)
    consumers, _, _ = L.edges(spark, {"datasets": {"alpha": {"consumers": [{"name": "x", "criticality": "high"}]}}})
    rows = {r["dataset"]: r for r in R.catalogue(spark, found, consumers).collect()}
    assert set(rows) == {"alpha", "beta"}
    a = rows["alpha"]
    assert (a["column_count"], a["columns"], a["has_quality_rules"], a["lifecycle"], a["criticality"], a["version"]) == (
        2, ["a", "b"], True, "active", "HIGH", "2.0.0")
    assert rows["beta"]["lifecycle"] == "error" and rows["beta"]["criticality"] == "UNKNOWN"


def test_yaml_contract(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text("quality:\n  min_rows: 3\ncolumns:\n  - name: a\n    data_type: DATE\n    nullable: false\n")
    k = load_contract(path)
    assert k.min_rows == 3 and k.columns[0].declared == "date" and not k.columns[0].nullable
    assert load_contract(tmp_path / "none.yaml").error
