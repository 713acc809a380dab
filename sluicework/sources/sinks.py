"""Writing the rows of judged batches: onward, staged or quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluicework import fixed_values as fv
from sluicework.operators.profile import Batch, batch_of

#: Characters that a folder name of a partition can't have as they are, and what stands for them.
_ESCAPED = '%"#\'*/:=?\\\x7f{[]^' + "".join(map(chr, range(1, 32)))


def by_verdict(df: DataFrame, verdicts: DataFrame, batch: Batch = None) -> DataFrame:
    """Attach ``batch_key`` and ``status`` to every row.

    An ordinary join on the batch, whose text is never null: adaptive execution broadcasts
    a side it measured to be small, and otherwise cuts the partition of a hot batch into
    pieces by size. Rows are not salted by content, since a hot batch may consist of copies,
    nor by a random number, which would differ when a lost task runs again.
    """
    rows = df.withColumn("batch_key", batch_of(batch))
    if batch is None:  # one verdict for all rows: nothing to join
        one = verdicts.select("status").first()
        return rows.withColumn("status", F.lit(one["status"])) if one else rows.withColumn("status", F.lit("")).limit(0)
    return rows.join(verdicts.select(F.col("batch").alias("batch_key"), "status"), "batch_key")


def folder_of(batch: Column) -> Column:
    """The name of a batch's folder as the writer makes it."""
    text = batch
    for c in _ESCAPED:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit("batch_key="), text)


def destination() -> Column:
    return F.when(F.col("status") == "BLOCKED", "quarantine").otherwise("staging")


def write_batches(rows: DataFrame, path: str) -> None:
    """Write rows into one folder per batch; a batch written again replaces itself.

    Rows are first brought together by batch. Adaptive execution joins small batches in a task and
    cuts large ones, so the number of files follows the data and not tasks times batches.
    """
    rows.hint("rebalance", "batch_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_key").parquet(path)


def write_divided(rows: DataFrame, path: str) -> None:
    """Write rows once, divided by ``destination`` and ``batch_key``: the source is read once for all destinations."""
    rows.hint("rebalance", "destination", "batch_key").write.partitionBy("destination", "batch_key").parquet(path)


def load_records(landed: DataFrame, dataset: str, attempt: str, at: Column, state: str) -> DataFrame:
    """One load record for each batch of written rows: how many rows, and a sum of their hashes that no order changes."""
    body = [F.col(f"`{c}`") for c in landed.columns if c not in ("destination", "batch_key")]
    # a sum of 64-bit hashes as a decimal: unlike an exclusive or it tells two copies of a row from none
    total = F.sum(F.xxhash64(*body).cast("decimal(20,0)")).cast("string")
    return landed.groupBy(F.col("batch_key").cast("string").alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"), total.alias("checksum")).select(
        F.lit(dataset).alias("dataset_name"), "batch", F.lit(attempt).alias("attempt"), at.alias("timestamp"),
        "rows", "checksum", F.lit(state).alias("state"))


def still_to_load(records: DataFrame, log: DataFrame) -> DataFrame:
    """The records whose batch was not loaded with the same rows already: a repeated load has nothing to do."""
    newest = log.where("state = 'LOADED'").groupBy("dataset_name", "batch").agg(
        F.max_by(F.struct("rows", "checksum"), F.struct("timestamp", "attempt")).alias("l")).select("dataset_name", "batch", "l.*")
    return records.join(newest, ["dataset_name", "batch", "rows", "checksum"], "left_anti")


def load_failure(error: str) -> tuple[str, str]:
    """Status and load state after a failed load: an unreachable target only warns."""
    if any(mark in error.lower() for mark in fv.INFRA_ERROR_MARKS):
        return "WARNING", fv.LOAD_INFRA_ERROR
    return "BLOCKED", error


def error_summary(results: DataFrame) -> DataFrame:
    """Number of timeliness, schema and profiling errors per batch.

    Input: ``timeliness_passed boolean, schema_errors array, profiling_errors array``.
    """
    late = F.when(F.coalesce(F.col("timeliness_passed"), F.lit(True)), 0).otherwise(1)

    def size(name: str) -> Column:
        return F.coalesce(F.array_size(name), F.lit(0))

    return results.withColumns({
        "timeliness_issues": late,
        "schema_issues": size("schema_errors"),
        "profiling_issues": size("profiling_errors"),
        "total_errors": late + size("schema_errors") + size("profiling_errors"),
    })
