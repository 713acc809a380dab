"""Many datasets judged together.

Each dataset has a schema of its own, but what its rules count has the same layout. So the scans of
all datasets are branches of one aggregate, and what follows (metrics, baselines, impact, verdicts) runs
once over the union: the number of jobs and shuffles doesn't grow with the number of datasets.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce
from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework import fixed_values as fv
from sluicework.contracts import Contract
from sluicework.functions.rules import moment
from sluicework.functions.verdict import with_verdict
from sluicework.operators import anomaly, profile as P
from sluicework.plans.judge import NO_ANOMALIES, anomaly_schema, found_anomalies, run_id, schema_gate
from sluicework.session import durable, error_text, small_frame
from sluicework.sources import landing

Marker = Callable[[DataFrame, Contract], Contract]


class Dataset(NamedTuple):
    data: DataFrame
    contract: Contract
    columnar: bool = True
    mtime: float | None = None


class Judged(NamedTuple):
    """``verdicts`` has one row a dataset, ``scored`` its metrics, ``errors`` why a dataset could not be judged."""

    verdicts: DataFrame
    scored: DataFrame
    errors: dict[str, str]
    found: dict[str, dict]


def waiting(spark: SparkSession, contracts: list[Contract], paths: dict[str, str], registry: DataFrame | None) -> DataFrame:
    """What to do with each dataset: SKIPPED, UNCHANGED or JUDGE, with the reason and the time of its newest file.

    All folders are listed in one job, and the registry is joined to what was found.
    """
    asked = small_frame(spark, [(k.dataset, k.info.get("lifecycle") == "deprecated") for k in contracts], "dataset string, deprecated boolean")
    listed = [landing.list_files(spark, paths[k.dataset], "*").select(F.lit(k.dataset).alias("dataset"), "mtime")
              for k in contracts if k.dataset in paths]
    none = small_frame(spark, [], "dataset string, mtime double")
    files = reduce(DataFrame.unionByName, listed, none).groupBy("dataset").agg(F.max("mtime").alias("mtime"))
    found = asked.join(files, "dataset", "left")
    if registry is None:
        found = found.withColumn("last_file_mtime", F.lit(None).cast("double"))
    else:
        found = found.join(registry.select(F.col("dataset_name").alias("dataset"), "last_file_mtime"), "dataset", "left")
    same = F.coalesce(F.abs(F.col("mtime") - F.col("last_file_mtime")) < fv.UNCHANGED_TOLERANCE_SECONDS, F.lit(False))
    cases = ((F.col("deprecated"), "SKIPPED", "deprecated"), (F.col("mtime").isNull(), "SKIPPED", "no_data"), (same, "UNCHANGED", "unchanged"))
    decision, reason = F.lit("JUDGE"), F.lit("")
    for hit, status, key in reversed(cases):
        decision, reason = F.when(hit, status).otherwise(decision), F.when(hit, fv.MSG[key]).otherwise(reason)
    return found.select("dataset", decision.alias("decision"), reason.alias("reason"), "mtime")


def _together(sets: list[Dataset], as_of: datetime, folder: str) -> DataFrame:
    """One row a dataset: a projection of what one aggregate over all of them has stored."""
    found = P.summarise_many({s.contract.dataset: (s.data, s.contract) for s in sets}, as_of, lambda rows: durable(rows, folder))
    rows = [P.profile(found[s.contract.dataset], s.contract, carry=("metrics",)).select(
        F.lit(s.contract.dataset).alias("dataset"), "batch", "total_rows", "overall_score", "columns", "constraints", "checks", "metrics") for s in sets]
    return durable(reduce(DataFrame.unionByName, rows), folder)


def summaries(sets: list[Dataset], as_of: datetime, folder: str, mark: Marker) -> tuple[list[DataFrame], dict[str, str]]:
    """One stored row a dataset from one job over all of them.

    If the job fails, halves are tried on their own down to the dataset that is at fault. Its failing
    checks are set aside by ``mark``; if none fails by itself, the dataset has an error instead of a row.
    """
    if not sets:
        return [], {}
    try:
        return [_together(sets, as_of, folder)], {}
    except Exception as exc:
        if len(sets) > 1:
            half = len(sets) // 2
            first, second = (summaries(part, as_of, folder, mark) for part in (sets[:half], sets[half:]))
            return first[0] + second[0], {**first[1], **second[1]}
        contract = mark(sets[0].data, sets[0].contract)
        if contract == sets[0].contract:
            return [], {contract.dataset: error_text(exc)}
        return summaries([sets[0]._replace(contract=contract)], as_of, folder, lambda _, k: k)


def judge_all(spark: SparkSession, sets: list[Dataset], history: DataFrame, impact: Callable[[DataFrame], DataFrame],
              as_of: datetime, folder: str, mark: Marker, anomaly_z: float = fv.ANOMALY_Z) -> Judged:
    """A verdict row for each dataset, each taken as one batch; ``history`` is that of all datasets."""
    found = {s.contract.dataset: schema_gate(s.data, s.contract) for s in sets}
    wrong = {k: (len(f["missing_columns"]), len(f["type_mismatches"])) for k, f in found.items()}
    kept, errors = summaries([s for s in sets if not any(wrong[s.contract.dataset])], as_of, folder, mark)
    at = moment(as_of)
    facts = small_frame(spark, [(k, "all") for k, w in wrong.items() if any(w)], "dataset string, batch string").withColumn(
        "quality_score", F.lit(None).cast("double"))
    scored = small_frame(spark, [], anomaly_schema())
    if kept:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
        metrics = rows.select("dataset", "batch", F.inline("metrics")).where("metric_value IS NOT NULL")
        names = [s.contract.dataset for s in sets]
        past = history.where(F.col("dataset_name").isin(names))
        scored = durable(anomaly.evaluate(
            anomaly.as_history(metrics, F.col("dataset"), at, run_id(F.col("dataset"), at)), past, anomaly_z), folder)
        facts = rows.drop("metrics").withColumnRenamed("overall_score", "quality_score").unionByName(facts, allowMissingColumns=True)
    limits = small_frame(spark, [
        (k.dataset, *wrong[k.dataset], k.z_warning, k.z_critical, k.quality_warn, k.quality_block, k.path, s.mtime)
        for s in sets for k in [s.contract]], "dataset string, missing_count int, mismatch_count int, z_warning double, z_critical double, "
        "quality_warn double, quality_block double, contract_path string, mtime double")
    statuses = anomaly.run_status(scored).select("run_id", "anomaly_count", "max_z")
    joined = facts.withColumns({"run_id": run_id(F.col("dataset"), at), "timestamp": at}).join(limits, "dataset").join(
        impact(limits.select("dataset")).select("dataset", "criticality", "owner"), "dataset").join(statuses, "run_id", "left")
    verdicts = with_verdict(joined.withColumns({
        "anomaly_count": F.coalesce("anomaly_count", F.lit(0)), "max_z": F.coalesce("max_z", F.lit(0.0))}))
    named = verdicts.join(found_anomalies(scored, anomaly_z), "run_id", "left").withColumn(
        "anomalies", F.coalesce("anomalies", F.array().cast(NO_ANOMALIES)))
    return Judged(durable(named, folder), scored, errors, found)


def without(contract: Contract, errors: dict[str, str]) -> Contract:
    """The contract with the checks that have an error set aside; the same one if there is none."""
    if not any(errors.values()):
        return contract
    return replace(contract, checks=tuple(replace(c, error=errors.get(c.name)) for c in contract.checks))
