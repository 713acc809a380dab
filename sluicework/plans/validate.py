"""Schema check of a file, table or query against a contract, in one call."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from sluicework.contracts import Contract, declared_columns
from sluicework.operators import schema as S
from sluicework.session import error_text, small_frame
from sluicework.sources import readers

ISSUES = ", ".join(f"{c} string" for c in S.ISSUE_COLUMNS)


class Validation(NamedTuple):
    status: str
    passed_checks: int
    failed_checks: int
    issues: DataFrame


def validate(spark: SparkSession, contract: Contract, source: str, source_type: str = "csv") -> Validation:
    """Load, compare the schema and count duplicates of the first primary key.

    Only the key count reads data. A source that cannot be read is itself an issue, and a
    key that cannot be counted only warns.
    """
    name = contract.dataset
    if contract.error is not None:
        raise FileNotFoundError(contract.path or contract.error)
    try:
        df = readers.load(spark, source, source_type)
    except readers.SourceError as exc:
        return Validation("fail", 0, 1, small_frame(spark, [exc.row(name)], ISSUES))
    compared = S.compare(declared_columns(spark, [contract]), S.observed_columns(spark, {name: df.schema}))
    found = S.issues(compared).select(*S.ISSUE_COLUMNS)
    passed = compared.where("outcome = 'ok'").count()
    key = next((c for c in df.columns if contract.primary_key and c.lower() == contract.primary_key.lower()), None)
    if key is not None:
        try:
            duplicates = S.key_duplicates(df, key).first()["duplicate_count"]
        except Exception as exc:
            row = (name, "warning", key, "uniqueness_check_error",
                   f"Could not check uniqueness for '{key}': {error_text(exc)}", "unique check", "error")
            found = found.unionByName(small_frame(spark, [row], ISSUES))
        else:
            passed += duplicates == 0
            counted = small_frame(spark, [(name, key, duplicates)], "dataset string, column_name string, duplicate_count bigint")
            found = found.unionByName(S.key_issues(counted))
    status = S.fold(found).first()
    return Validation(status["status"] if status else "pass", passed, status["failed_checks"] if status else 0, found)
