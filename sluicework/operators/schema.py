"""Schema comparison of many datasets in one join, key duplicates, and schema history."""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sluicework import fixed_values as fv
from sluicework.functions.rules import ref
from sluicework.contracts import Contract, declared_columns
from sluicework.functions.types import accepted, shown
from sluicework.session import small_frame

ISSUE_COLUMNS = ["dataset", "severity", "column_name", "issue_type", "message", "expected", "actual"]


def observed_columns(spark: SparkSession, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """One row per column of every dataset: its name, type and the declarations it satisfies."""
    rows = [
        (dataset, f.name, shown(f.dataType), accepted(f.dataType))
        for dataset, schema in schemas.items()
        for f in schema.fields
    ]
    return small_frame(
        spark, rows, "dataset string, observed_name string, observed_type string, accepted array<string>"
    )


def compare(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Outcome per column, names matched without case: ``ok, missing_column, type_mismatch, unexpected_column``."""
    d = declared.withColumn("_name", F.lower("column_name"))
    o = observed.withColumn("_name", F.lower("observed_name"))
    outcome = (
        F.when(F.col("observed_name").isNull(), "missing_column")
        .when(F.col("column_name").isNull(), "unexpected_column")
        .when(F.array_contains("accepted", F.col("declared_type")), "ok")
        .otherwise("type_mismatch")
    )
    return d.join(o, ["dataset", "_name"], "full_outer").select(
        "dataset", "column_name", "observed_name", "declared_type", "observed_type", outcome.alias("outcome")
    )


def issues(compared: DataFrame) -> DataFrame:
    """The columns that do not conform, as issue rows."""
    kind = F.col("outcome")
    name = F.coalesce("column_name", "observed_name")

    def text(key: str) -> Column:
        return F.format_string(fv.MSG[key], name)

    return compared.where(kind != "ok").select(
        "dataset",
        F.when(kind == "unexpected_column", "warning").otherwise("fail").alias("severity"),
        name.alias("column_name"),
        kind.alias("issue_type"),
        F.when(kind == "missing_column", text("missing_column"))
        .when(kind == "type_mismatch", text("type_mismatch"))
        .otherwise(text("unexpected_column")).alias("message"),
        F.when(kind == "missing_column", F.col("column_name"))
        .when(kind == "type_mismatch", F.col("declared_type"))
        .otherwise("<not in schema>").alias("expected"),
        F.when(kind == "missing_column", "<not found>")
        .when(kind == "type_mismatch", F.col("observed_type"))
        .otherwise(F.col("observed_name")).alias("actual"),
    )


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows less distinct keys; a null key counts as a duplicate.

    Keys are collapsed before the counts are added up, so a hot key costs one row per task.
    """
    per_key = df.groupBy(ref(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("key").alias("distinct_keys"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("key")).alias("duplicate_count"),
    )


def key_issues(duplicates: DataFrame) -> DataFrame:
    """Issue rows from ``dataset, column_name, duplicate_count``."""
    return duplicates.where("duplicate_count > 0").select(
        "dataset",
        F.lit("fail").alias("severity"),
        "column_name",
        F.lit("duplicate_primary_key").alias("issue_type"),
        F.format_string(fv.MSG["duplicate_primary_key"], "duplicate_count", "column_name").alias("message"),
        F.lit("unique values").alias("expected"),
        F.format_string("%d duplicates", "duplicate_count").alias("actual"),
    )


def fold(issue_rows: DataFrame) -> DataFrame:
    """Status per dataset, ``pass < warning < fail``, with counts."""
    rank = F.max(F.when(F.col("severity") == "fail", 2).otherwise(1))
    return issue_rows.groupBy("dataset").agg(
        F.when(rank == 2, "fail").otherwise("warning").alias("status"),
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "fail").alias("failed_checks"),
    )


def diff(compared: DataFrame) -> DataFrame:
    """Missing, new and mistyped columns per dataset; lists are as long as a schema is wide."""

    def names(kind: str, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("outcome") == kind, value)))

    mismatch = F.struct(
        F.col("column_name").alias("column"),
        F.col("declared_type").alias("expected"),
        F.col("observed_type").alias("actual"),
    )
    return compared.groupBy("dataset").agg(
        names("missing_column", F.col("column_name")).alias("missing_columns"),
        names("unexpected_column", F.col("observed_name")).alias("new_columns"),
        names("type_mismatch", mismatch).alias("type_mismatches"),
        F.count_if(F.col("outcome") == "ok").alias("passed_checks"),
    )


def diff_of(spark: SparkSession, contracts: Iterable[Contract], schemas: Mapping[str, T.StructType]) -> DataFrame:
    """Schema diff of every dataset that has both a contract and data."""
    chosen = [k for k in contracts if k.dataset in schemas]
    return diff(compare(declared_columns(spark, chosen), observed_columns(spark, schemas)))


def to_json(result: DataFrame) -> DataFrame:
    """A result row per dataset as one JSON text."""
    return result.select("dataset", F.to_json(F.struct(*result.columns)).alias("result"))


def evolution(snapshots: DataFrame) -> DataFrame:
    """For each version of a schema but the first, whether it keeps every column of the version before it."""
    steps = (
        snapshots.select("dataset", "version").distinct()
        .withColumn("next", F.lead("version").over(Window.partitionBy("dataset").orderBy("version")))
        .where("next is not null")
    )
    old = snapshots.join(steps, ["dataset", "version"]).select("dataset", F.col("next").alias("version"), "column_name")
    return keeps_columns(old, snapshots, ["dataset", "version"])


def change_log(snapshots: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between consecutive versions of a schema.

    ``snapshots`` holds one row per ``dataset, version, column_name`` with its ``data_type``.
    Versions are collapsed first, so the ordered window only sees one row per version.
    """
    steps = (
        snapshots.select("dataset", "version").distinct()
        .withColumn("previous", F.lag("version").over(Window.partitionBy("dataset").orderBy("version")))
        .where("previous is not null")
    )
    new = snapshots.join(steps, ["dataset", "version"]).select(
        "dataset", "version", "column_name", F.col("data_type").alias("new_type")
    )
    old = snapshots.withColumnRenamed("version", "previous").join(steps, ["dataset", "previous"]).select(
        "dataset", "version", "column_name", F.col("data_type").alias("old_type")
    )
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return (
        old.join(new, ["dataset", "version", "column_name"], "full_outer")
        .withColumn("change", change)
        .where("change is not null")
    )


def keeps_columns(old: DataFrame, new: DataFrame, on: Sequence[str] = ("dataset",)) -> DataFrame:
    """Whether a proposed schema keeps every column of the old one, per dataset or per step of one."""
    keys = [*on, "column_name"]
    removed = old.select(*keys).distinct().join(
        new.select(*keys).distinct().withColumn("_kept", F.lit(True)), keys, "left")
    return removed.groupBy(*on).agg(
        F.count_if(F.col("_kept").isNull()).alias("removed_columns"),
        (F.count_if(F.col("_kept").isNull()) == 0).alias("accepted"),
    )
