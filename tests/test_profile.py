from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluicework.contracts import Contract, rule_table
from sluicework.functions.rules import at_time
from sluicework.operators import profile as P


def run(df, contract, batch=None, **kw):
    return P.profile(P.summarise(df, contract, batch, **kw), contract)


def columns(profiles):
    return {r["column_name"]: r for r in P.column_profiles(profiles).collect()}


def test_clean_data_scores_100(clean, test_contract):
    profiles = run(clean, test_contract)
    row = profiles.first()
    assert row["overall_score"] == 100.0 and row["constraints"] == [] and row["checks"][0]["passed"]
    assert P.violations(profiles, test_contract).count() == 0


def test_dirty_data(dirty, test_contract):
    profiles = run(dirty, test_contract)
    cols = columns(profiles)
    scores = [cols[c]["quality_score"] for c in ("crate", "gross_kg", "tare_kg", "grade", "packed")]
    assert scores == [60.0, 60.0, 100.0, 80.0, 80.0]  # two, two, none, one and one violation in five rows
    row = profiles.first()
    assert row["overall_score"] == pytest.approx(76.0 - 3.0) and row["constraints"] == []
    assert row["checks"][0]["violation_count"] == 1 and not row["checks"][0]["passed"]
    texts = "\n".join(r["message"] for r in P.violations(
        profiles, test_contract, P.sample_offenders(dirty, test_contract)).collect())
    for part in ("PRIMARY KEY violation: 1", "PATTERN violation: 1", "below minimum (2.5). Actual min: 1.0",
                 "above maximum (80.0)", "Examples: [mouldy]"):
        assert part in texts


def test_nulls_patterns_and_missing_columns(spark):
    k = Contract.from_dict({
        "quality": {"min_rows": 6, "custom_checks": [
            {"name": "Past", "sql_condition": "seen <= now()"},
            {"name": "Quiet At Night", "sql_condition": "decibel < 70 OR NOT night"}]},
        "columns": [
            {"name": "probe", "nullable": False, "isPrimaryKey": True, "pattern": "^p[0-9]"},
            {"name": "site", "nullable": False, "pattern": "^north"},
            {"name": "decibel", "data_type": "double", "min_value": 10, "max_value": 120},
            {"name": "seen", "data_type": "date"},
            {"name": "night", "data_type": "boolean"},
            {"name": "altitude", "data_type": "integer"}]}, "noise")
    at = datetime(2022, 5, 4)
    df = spark.createDataFrame(
        [("p1", "north-a", 30.0, at, False), ("p2", None, 75.0, at, True), ("p3", "south", 5.0, at, False), ("p3", "north-b", 60.0, at, None),
         ("x", "northern", 130.0, at, False)],
        "probe string, site string, decibel double, seen timestamp, night boolean")
    profiles = run(df, k)
    scores = {c: r["quality_score"] for c, r in columns(profiles).items()}
    assert scores == {"probe": 60.0, "site": 60.0, "decibel": 60.0, "seen": 100.0, "night": 100.0}
    assert profiles.first()["overall_score"] == pytest.approx(76.0 - 5 - 3)


def test_empty_data(spark, test_contract):
    profiles = run(spark.createDataFrame([], "crate string, gross_kg double, tare_kg double, grade string, packed date"), test_contract)
    row = profiles.first()
    assert row["total_rows"] == 0 and row["overall_score"] == 0.0
    assert {r["quality_score"] for r in P.column_profiles(profiles).collect()} == {0.0}
    metrics = {r["metric_name"]: r["metric_value"] for r in P.metric_rows(P.summarise(
        spark.createDataFrame([], "a int"), test_contract)).collect()}
    assert metrics == {"row_count": 0.0}


def test_pattern_is_anchored_at_start_only_and_unicode(spark):
    k = Contract.from_dict({"columns": [{"name": "s", "pattern": "\\d"}]}, "t")
    df = spark.createDataFrame([("1x",), ("x1",), ("٣",), (None,)], "s string")
    assert columns(run(df, k))["s"]["pattern_mismatches"] == 1


def test_nan_counts_as_null(spark):
    k = Contract.from_dict({"columns": [{"name": "v", "data_type": "double", "nullable": False, "max_value": 5}]}, "t")
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (9.0,)], "v double")
    c = columns(run(df, k, distinct="exact"))["v"]
    assert (c["null_count"], c["unique_count"], c["max_value"], c["mean_value"], c["above_max"]) == (2, 2, 9.0, 5.0, 1)


def test_limits_are_strict_and_null_check_condition_passes(spark):
    k = Contract.from_dict({
        "columns": [{"name": "v", "data_type": "int", "min_value": 1, "max_value": 3}],
        "quality": {"custom_checks": [{"name": "c", "sql_condition": "v > 1"}, {"name": "empty", "sql_condition": ""},
                                      {"name": "broken", "sql_condition": "nope = 1"}]}}, "t")
    row = run(spark.createDataFrame([(1,), (3,), (0,), (4,), (None,)], "v int"), k).first()
    c = row["columns"][0]
    assert (c["below_min"], c["above_max"]) == (1, 1)
    checks = {x["name"]: x for x in row["checks"]}
    assert set(checks) == {"c", "broken"}
    assert checks["c"]["violation_count"] == 2
    assert not checks["broken"]["passed"] and "nope" in checks["broken"]["error"]
    assert row["overall_score"] == pytest.approx(60.0 - 6.0)


def test_text_dates_are_coerced_for_checks_only(spark):
    k = Contract.from_dict({
        "columns": [{"name": "d", "data_type": "timestamp", "nullable": False}],
        "quality": {"custom_checks": [{"name": "past", "sql_condition": "d <= now()"}]}}, "t")
    df = spark.createDataFrame([("2020-01-01 10:00:00",), ("oops",), ("2031-01-01",)], "d string")
    row = run(df, k, as_of=datetime(2030, 1, 1)).first()
    assert row["columns"][0]["null_count"] == 0
    assert row["checks"][0]["violation_count"] == 1


def test_documented_rule_shapes(spark):
    conditions = {
        "range": "start_date < end_date",
        "age": "add_months(birth_date, 12 * 18) <= current_date()",
        "refund": "refund <= amount",
        "percent": "discount BETWEEN 0 AND 100",
    }
    k = Contract.from_dict({"columns": [], "quality": {"custom_checks": [
        {"name": n, "sql_condition": c} for n, c in conditions.items()]}}, "t")
    df = spark.sql("""SELECT DATE'2024-01-02' start_date, DATE'2024-01-01' end_date, DATE'2000-01-01' birth_date, 5 refund, 4 amount, 50 discount
        UNION ALL SELECT DATE'2024-01-01', DATE'2024-01-02', DATE'2015-01-01', 1, 4, 101""")
    checks = {c["name"]: c["violation_count"] for c in run(df, k, as_of=datetime(2024, 6, 1)).first()["checks"]}
    assert checks == {"range": 1, "age": 1, "refund": 1, "percent": 1}


def test_clock_is_pinned():
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert at_time("t <= NOW() AND d < current_date", at) == (
        "t <= TIMESTAMP '2024-01-02 03:04:05.000000' AND d < DATE '2024-01-02'")


def test_batches_row_layouts_and_sketches_agree(spark, test_contract):
    df = spark.range(1000).select(
        F.concat(F.lit("QX-"), F.col("id") % 700).alias("crate"), (F.col("id") % 50).cast("double").alias("gross_kg"),
        F.lit(0.5).alias("tare_kg"), F.when(F.col("id") % 10 == 0, "mouldy").otherwise("prime").alias("grade"),
        F.lit("2024-01-01").cast("date").alias("packed"), (F.col("id") % 3).alias("b"))

    def by(**kw):
        return {(r["batch"], r["column_name"]): r["unique_count"] for r in P.column_profiles(
            run(df, test_contract, "b", **kw)).collect()}

    exact = by(distinct="exact")
    pdf = df.toPandas()
    for (batch, column), n in exact.items():
        assert n == pdf[pdf.b == int(batch)][column].nunique()
    assert by(distinct="exact", columnar=False) == exact
    approx = by(distinct="approx")
    assert all(abs(approx[k] - n) <= max(2, 0.15 * n) for k, n in exact.items())


def test_hot_batch_and_values(spark, test_contract):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "QX-1").otherwise(F.concat(F.lit("QX-"), "id")).alias("crate"),
        F.lit(5.0).alias("gross_kg"), F.lit(1.0).alias("tare_kg"), F.lit("prime").alias("grade"), F.lit("2024-01-01").cast("date").alias("packed"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 40)).alias("b"))
    got = {r["batch"]: r for r in P.column_profiles(run(df, test_contract, "b")).where("column_name = 'crate'").collect()}
    pdf = df.toPandas()
    for batch, part in pdf.groupby("b"):
        assert got[batch]["total_rows"] == len(part) and got[batch]["duplicate_count"] == len(part) - part["crate"].nunique()


def test_sample_offenders_are_first_in_order(spark):
    k = Contract.from_dict({"columns": [{"name": "s", "allowed_values": ["ok"]}]}, "t")
    df = spark.createDataFrame([(c,) for c in "zyxwvutsrq" * 30] + [("ok",), (None,)], "s string")
    assert P.sample_offenders(df, k).first()["samples"] == list("qrstu")
    assert P.sample_offenders(df, Contract.from_dict({"columns": [{"name": "s"}]}, "t")).count() == 0


def test_rule_outcomes_and_freshness(spark, dirty, test_contract):
    profiles = run(dirty, test_contract)
    rows = {(r["rule"], r["column_name"]): r for r in P.rule_outcomes(profiles, rule_table(spark, [test_contract])).collect()}
    assert rows[("range", "gross_kg")]["violation_count"] == 2 and not rows[("sql", None)]["passed"]
    assert rows[("notNull", "crate")]["passed"] and rows[("rowCount", None)]["passed"] and not rows[("notNull", "packed")]["passed"]


def test_freshness(spark):
    k = Contract.from_dict({"columns": [{"name": "seen", "data_type": "timestamp"}]}, "t")
    df = spark.createDataFrame([(datetime(2024, 9, 3),)], "seen timestamp")
    fresh = P.freshness_outcomes(df, k, datetime(2024, 9, 4)).first()
    assert fresh["passed"] and fresh["age_minutes"] == 1440
    assert not P.freshness_outcomes(df, k, datetime(2024, 9, 4, 0, 1)).first()["passed"]


def test_unreadable_contract(clean):
    k = Contract("t", error="broken", path="x.yaml")
    row = run(clean, k).first()
    assert row["overall_score"] == 100.0 and row["constraints"][0]["type"] == "CONTRACT_ERROR"


def test_awkward_column_names(spark):
    k = Contract.from_dict({"columns": [{"name": "a.b", "nullable": False}, {"name": "it's", "pattern": "o'c\\\\"}]}, "t")
    df = spark.createDataFrame([("x", "o'c\\"), (None, "nope")], "`a.b` string, `it's` string")
    cols = columns(run(df, k))
    assert cols["a.b"]["not_null_violations"] == 1 and cols["it's"]["pattern_mismatches"] == 1


FIVE = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), (None, "a"), ("", "\\N"), (None, "")]


def test_batch_keys_lose_and_merge_nothing(spark):
    k = Contract.from_dict({"columns": [{"name": "v", "data_type": "bigint", "isPrimaryKey": True}]}, "t")
    df = spark.createDataFrame([(i, *pair) for i, pair in enumerate(FIVE)], "v bigint, x string, y string")
    for distinct in ("keys", "none", "exact"):
        rows = {r["batch"]: r for r in run(df, k, ["x", "y"], distinct=distinct).collect()}
        assert {b: r["total_rows"] for b, r in rows.items()} == {
            "a\\|b|c": 1, "a|b\\|c": 1, "a|\\N": 1, "\\N|a": 2, "\\E|\\\\N": 1, "\\N|\\E": 1}
        assert {r["overall_score"] for r in rows.values()} == {100.0}
    one = {r["batch"]: r["total_rows"] for r in run(df, k, "x").collect()}
    assert one == {"a|b": 1, "a": 2, "\\N": 3, "\\E": 1}


def test_clock_words_inside_texts_stay():
    assert at_time("a = 'now()' AND b <= now()", datetime(2024, 1, 2)) == "a = 'now()' AND b <= TIMESTAMP '2024-01-02 00:00:00.000000'"


def test_long_texts_are_counted_by_digest(spark):
    df = spark.createDataFrame([("x" * 500 + str(i % 3), "s") for i in range(9)] + [(None, "t")], "a string, b string")
    assert {r["column_name"]: r["unique_count"] for r in P.distinct_counts(df, ["a", "b"]).collect()} == {"a": 3, "b": 2}


def test_many_summaries_equal_each_alone(spark, test_contract):
    """One aggregate over datasets of different schemas gives what each summary gives, an empty dataset included."""
    odd = Contract.from_dict({"quality": {"min_rows": 2, "custom_checks": [{"name": "c", "sql_condition": "n > 1"}, {"sql_condition": "s <> 'b'"}]}, "columns": [
        {"name": "n", "data_type": "bigint", "min_value": 1, "max_value": 5, "isPrimaryKey": True}, {"name": "at", "data_type": "timestamp", "isPrimaryKey": True},
        {"name": "x", "data_type": "double", "min_value": 0.5}, {"name": "s", "pattern": "a", "allowed_values": ["a", "ab"]}, {"name": "gone"}]}, "odd")
    rows = [(1, datetime(2024, 1, 1), float("nan"), "a", b"1"), (1, None, 2.5, "b", b"1"), (None, datetime(2024, 1, 1), 0.25, None, None), (9, datetime(2024, 1, 2), 0.5, "ab", b"")]
    ddl = "n bigint, at timestamp, x double, s string, raw binary"
    sets = {"odd": (spark.createDataFrame(rows, ddl), odd), "none": (spark.createDataFrame([], ddl), odd),
            "bare": (spark.range(3).select(F.lit("t").alias("t")), Contract("bare"))}
    for name, summary in P.summarise_many(sets).items():
        df, contract = sets[name]
        alone = P.summarise(df, contract)
        assert summary.schema.simpleString() == alone.schema.simpleString()
        assert summary.collect() == alone.collect()
        assert P.profile(summary, contract).collect() == P.profile(alone, contract).collect()
