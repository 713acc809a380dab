"""System tables: append-only Parquet, with views giving the newest row per key.

Appending never rewrites what other runs wrote, so a run that is retried or killed
leaves the tables readable; replace and upsert semantics come from the views.

A table is a set of folders: one for each append, moved into place when it is whole, and at most one base that
compaction made of earlier ones. The newest record in ``_generations`` names the base and the folders that it stands
for; readers follow that record and take every other append as it is. So nothing is lost or read twice if an append
ends while a compaction runs, or if a compaction stops anywhere. Folders that a record replaced are deleted by the
compaction after it, so readers that began before it find their files.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from sluicework.session import child_names, move_new, read_text, remove, small_frame, write_text

SCHEMAS = {
    "metric_history": "run_id string, timestamp timestamp, dataset_name string, metric_name string, "
                      "metric_value double, day_of_week int",
    "run_history": "run_id string, timestamp timestamp, dataset_name string, status string, quality_score double, "
                   "anomaly_count int, z_score_max double, reason string, duration_ms int",
    "learned_thresholds": "dataset_name string, metric_name string, baseline_mean double, baseline_std double, "
                          "baseline_type string, last_updated timestamp, sample_count int",
    "dataset_registry": "dataset_name string, contract_path string, lifecycle string, criticality string, "
                        "last_scanned timestamp, last_status string, last_file_mtime double",
    "quarantine_reports": "dataset_name string, batch string, timestamp timestamp, location string, status string, "
                          "total_errors int, report string",
    "staging_log": "dataset_name string, batch string, timestamp timestamp, location string, status string, report string",
    "load_log": "dataset_name string, batch string, attempt string, timestamp timestamp, rows bigint, checksum string, state string",
    "distinct_sketches": "dataset_name string, batch string, column_name string, filled bigint, sketch binary",
}


#: What a row of a table is about. Of rows with one key, as a repeated run appends them, readers see the newest.
KEYS = {
    "metric_history": ["dataset_name", "run_id", "metric_name"],
    "run_history": ["dataset_name", "run_id"],
    "quarantine_reports": ["dataset_name", "batch", "timestamp"],
    "staging_log": ["dataset_name", "batch", "timestamp"],
    "load_log": ["dataset_name", "batch", "attempt"],
    "distinct_sketches": ["dataset_name", "batch", "column_name"],
}


def latest_baselines(events: DataFrame) -> DataFrame:
    """The newest baseline per dataset and metric."""
    rest = [c for c in events.columns if c not in ("dataset_name", "metric_name")]
    newest = F.max_by(F.struct(*rest), F.struct("last_updated", *[c for c in rest if c != "last_updated"]))
    return events.groupBy("dataset_name", "metric_name").agg(newest.alias("b")).select(
        "dataset_name", "metric_name", "b.*")


def latest_registry(events: DataFrame) -> DataFrame:
    """The registry entry per dataset: newest values, number of scans.

    Status and file time keep their last known value when a scan did not give one.
    """
    at = F.col("last_scanned")

    def known(name: str):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(at, F.col(name))))

    return events.groupBy("dataset_name").agg(
        *[F.max_by(c, F.struct(at, F.col(c))).alias(c) for c in ("contract_path", "lifecycle", "criticality")],
        F.max(at).alias("last_scanned"),
        known("last_status").alias("last_status"),
        known("last_file_mtime").alias("last_file_mtime"),
        F.count(F.lit(1)).alias("scan_count"),
    )


class Store:
    """The system tables below one root, split by dataset on disk."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame) -> None:
        schema = T.DataType.fromDDL(SCHEMAS[table])
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        typed = typed.withColumn("recorded_at", F.current_timestamp())
        self._add(table, f"run={uuid.uuid4().hex}", typed)

    def _add(self, table: str, name: str, rows: DataFrame) -> None:
        """Write a folder out of readers' sight and move it into place."""
        hidden = f"{self.path(table)}/_writing-{uuid.uuid4().hex}"
        rows.write.partitionBy("dataset_name").parquet(hidden)
        move_new(self.spark, hidden, f"{self.path(table)}/{name}")

    def _generation(self, table: str) -> dict:
        """The newest record: its number, the base, and the folders that the base stands for."""
        folder = f"{self.path(table)}/_generations"
        names = sorted(n for n in child_names(self.spark, folder) if n.endswith(".json") and not n.startswith("_"))
        if not names:
            return {"number": 0, "base": None, "replaced": []}
        return json.loads(read_text(self.spark, f"{folder}/{names[-1]}"))

    def _publish(self, table: str, record: dict) -> None:
        """Make a record the newest; fails if another compaction took its number."""
        folder = f"{self.path(table)}/_generations"
        hidden = f"{folder}/_{uuid.uuid4().hex}"
        write_text(self.spark, hidden, json.dumps(record))
        move_new(self.spark, hidden, f"{folder}/{record['number']:08d}.json")

    def _live(self, table: str, record: dict) -> list[str]:
        """Names of the folders that make up the table by a record that was read before they are listed."""
        gone = set(record["replaced"])
        return [n for n in child_names(self.spark, self.path(table))
                if n == record["base"] or (n.startswith("run=") and not n.startswith("run=base-") and n not in gone)]

    def _stored(self, table: str, names: list[str]) -> DataFrame:
        stored = T.DataType.fromDDL(SCHEMAS[table] + ", recorded_at timestamp")
        paths = [f"{self.path(table)}/{n}" for n in names]
        return self.spark.read.schema(stored).option("basePath", self.path(table)).parquet(*paths).select(*stored.names)

    def append_all(self, tables: dict[str, DataFrame]) -> None:
        """Append to several tables side by side: each is a small job of its own."""
        with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
            list(pool.map(lambda name: self.append(name, tables[name]), tables))

    def read(self, table: str, dataset: str | None = None) -> DataFrame:
        """The newest row of each key, or all rows of a table without one; a dataset name prunes to its folder."""
        schema = T.DataType.fromDDL(SCHEMAS[table])
        names = self._live(table, self._generation(table))
        if not names:
            return small_frame(self.spark, [], SCHEMAS[table])  # nothing appended yet
        rows = self._stored(table, names)
        if dataset is not None:
            rows = rows.where(F.col("dataset_name") == dataset)
        keys = KEYS.get(table)
        if keys is None:
            return rows.select(*schema.names)
        rest = [c for c in schema.names if c not in keys]
        newest = F.max_by(F.struct(*rest), F.struct("recorded_at", *rest))
        return rows.groupBy(*keys).agg(newest.alias("r")).select(*[c if c in keys else f"r.{c}" for c in schema.names])

    def compact(self, table: str) -> None:
        """Put what many runs have appended into a few files for each dataset. Runs may read and append meanwhile.

        Two compactions of one table may not run at once: the one that ends later fails and changes nothing.
        """
        before = self._generation(table)
        for name in before["replaced"]:
            remove(self.spark, f"{self.path(table)}/{name}")
        names = self._live(table, before)
        if not names:
            return
        base = f"run=base-{uuid.uuid4().hex}"
        self._add(table, base, self._stored(table, names).hint("rebalance", "dataset_name"))
        try:
            self._publish(table, {"number": before["number"] + 1, "base": base, "replaced": names})
        except FileExistsError:
            remove(self.spark, f"{self.path(table)}/{base}")
            raise

    def baselines(self) -> DataFrame:
        return latest_baselines(self.read("learned_thresholds"))

    def registry(self) -> DataFrame:
        return latest_registry(self.read("dataset_registry"))

    def reports_of(self, dataset: str, batches: DataFrame) -> DataFrame:
        """The newest quarantine report of each batch asked for, with nulls where there is none."""
        newest = F.max_by(F.struct("timestamp", "location", "status", "total_errors", "report"), "timestamp")
        reports = self.read("quarantine_reports", dataset).groupBy("batch").agg(newest.alias("r")).select("batch", "r.*")
        return batches.join(reports, "batch", "left")

    def quarantine_report(self, dataset: str, batch: str) -> DataFrame:
        """The reports of one quarantined batch; empty when there is none."""
        return self.read("quarantine_reports", dataset).where(F.col("batch") == batch)
