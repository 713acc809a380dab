"""From data to one verdict row per batch."""

from __future__ import annotations

from datetime import datetime
from pyspark.sql import Column, DataFrame, functions as F

from sluicework import fixed_values as fv
from sluicework.contracts import Contract
from sluicework.functions.rules import moment
from sluicework.functions.types import accepted, shown
from sluicework.functions.verdict import with_verdict
from sluicework.operators import anomaly, profile as P
from sluicework.session import durable, small_frame


def schema_gate(df: DataFrame, contract: Contract) -> dict:
    """Schema diff of one dataset as plain lists, names matched without case; no job runs for two lists of names."""
    declared = {c.name.lower(): c for c in contract.columns}
    observed = {f.name.lower(): f for f in df.schema.fields}
    both = [(declared[k], observed[k].dataType) for k in declared if k in observed]
    wrong = [(c, kind) for c, kind in both if c.declared not in accepted(kind)]
    return {
        "missing_columns": sorted(c.name for k, c in declared.items() if k not in observed),
        "new_columns": sorted(f.name for k, f in observed.items() if k not in declared),
        "type_mismatches": sorted(
            ({"column": c.name, "expected": c.declared, "actual": shown(kind)} for c, kind in wrong), key=lambda m: m["column"]),
        "passed_checks": len(both) - len(wrong),
    }


def found_anomalies(scored: DataFrame, anomaly_z: float = fv.ANOMALY_Z) -> DataFrame:
    """The metrics of each run that are anomalous, with what was expected: as many as the data has metrics."""
    return anomaly.report(scored, anomaly_z).where("is_anomaly").groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(
        "metric_name", "metric_value", "z_score", "baseline_mean", "baseline_std", "baseline_type", "context"))).alias("anomalies"))


NO_ANOMALIES = (
    "array<struct<metric_name:string,metric_value:double,z_score:double,baseline_mean:double,baseline_std:double,"
    "baseline_type:string,context:string>>")


def _with_evolution(verdicts: DataFrame, found: dict) -> DataFrame:
    """The schema diff on every verdict row: new columns show up on passing batches too."""
    mismatches = F.array(*[F.struct(*[F.lit(m[k]).alias(k) for k in ("column", "expected", "actual")]) for m in found["type_mismatches"]])
    return verdicts.withColumns({
        "new_columns": F.array(*map(F.lit, found["new_columns"])).cast("array<string>"),
        "missing_columns": F.array(*map(F.lit, found["missing_columns"])).cast("array<string>"),
        "type_mismatches": mismatches.cast("array<struct<column:string,expected:string,actual:string>>"),
    })


def run_id(dataset: str | Column, at: Column) -> Column:
    """The same batch judged at the same time has the same id, so a retried run repeats itself."""
    name = dataset if isinstance(dataset, Column) else F.lit(dataset)
    return F.md5(F.concat_ws("|", name, F.col("batch"), at.cast("string")))


def scored_metrics(summary: DataFrame, dataset: str, history: DataFrame, at: Column,
                   against: str = "stored", anomaly_z: float = fv.ANOMALY_Z) -> DataFrame:
    """Metrics of the batches with their z-scores.

    ``against="stored"`` compares with recorded history; ``"earlier"`` also counts the
    earlier ones of these batches as history, for judging a backlog in one job.
    """
    metrics = anomaly.as_history(P.metric_rows(summary), F.lit(dataset), at, run_id(dataset, at))
    if against == "stored":
        return anomaly.evaluate(metrics, history, anomaly_z)
    past = history.where(F.col("dataset_name") == dataset).select(*metrics.columns, F.lit(False).alias("_new"))
    both = past.unionByName(metrics.withColumn("_new", F.lit(True)))
    return anomaly.replay(both, anomaly_z).where("_new").drop("_new")


def combine(profiles: DataFrame, statuses: DataFrame, contract: Contract, impact: DataFrame,
            missing: int = 0, mismatches: int = 0) -> DataFrame:
    """Join scores, anomaly outcomes and criticality, and decide.

    ``profiles`` carries ``batch, run_id, quality_score``; ``statuses`` comes from
    ``anomaly.run_status``; the one row of ``impact`` for this dataset gives criticality and owner.
    """
    known = impact.where(F.col("dataset") == contract.dataset).select("criticality", "owner").first()
    criticality, owner = known or ("LOW", "Unknown")
    joined = profiles.join(statuses.select("run_id", "anomaly_count", "max_z"), "run_id", "left")
    facts = joined.withColumns({
        "dataset": F.lit(contract.dataset), "criticality": F.lit(criticality), "owner": F.lit(owner),
        "anomaly_count": F.coalesce("anomaly_count", F.lit(0)),
        "max_z": F.coalesce("max_z", F.lit(0.0)),
        "missing_count": F.lit(missing), "mismatch_count": F.lit(mismatches),
        "z_warning": F.lit(contract.z_warning), "z_critical": F.lit(contract.z_critical),
        "quality_warn": F.lit(contract.quality_warn), "quality_block": F.lit(contract.quality_block),
    })
    return with_verdict(facts)


def judge(df: DataFrame, contract: Contract, history: DataFrame, impact: DataFrame, *,
          batch: P.Batch = None, at: Column | None = None, as_of: datetime | None = None,
          against: str = "stored", columnar: bool = True, anomaly_z: float = fv.ANOMALY_Z,
          folder: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Verdicts, scored metrics and the schema diff of the batches in ``df``.

    ``at`` gives the time of a batch from its key (default: ``as_of`` or now). A schema
    violation ends the evaluation before any data is read, unless batches must be listed.
    With ``folder``, a shared one, the one-row-per-batch summary and the scored metrics are kept
    there, so the data is scanned once whatever is derived from them.
    """
    if against == "earlier" and at is None:
        raise ValueError("batches that are judged against earlier ones need their times: give `at`")
    kept = (lambda rows: durable(rows, folder)) if folder else (lambda rows: rows)
    when = at if at is not None else moment(as_of or datetime.now())
    found = schema_gate(df, contract)
    missing, mismatches = len(found["missing_columns"]), len(found["type_mismatches"])
    spark = df.sparkSession
    if missing + mismatches > 0:
        keys = spark.range(1).select(P.batch_of(None).alias("batch")) if batch is None else (
            df.select(P.batch_of(batch).alias("batch")).distinct())
        bare = keys.select("batch", run_id(contract.dataset, when).alias("run_id"), when.alias("timestamp"),
                           F.lit(None).cast("double").alias("quality_score"))
        none = small_frame(spark, [], "run_id string, anomaly_count bigint, max_z double")
        scored = small_frame(spark, [], anomaly_schema())
        judged = combine(bare, none, contract, impact, missing, mismatches).withColumn("anomalies", F.array().cast(NO_ANOMALIES))
        return _with_evolution(judged, found), scored, found
    summary = kept(P.summarise(df, contract, batch, as_of=as_of, columnar=columnar))
    scored = kept(scored_metrics(summary, contract.dataset, history, when, against, anomaly_z))
    profiles = P.profile(summary, contract)
    carried = [c for c in ("columns", "constraints", "checks") if c in profiles.columns]
    scores = profiles.select(
        "batch", run_id(contract.dataset, when).alias("run_id"), when.alias("timestamp"),
        F.col("overall_score").alias("quality_score"), "total_rows", *carried)
    judged = combine(scores, anomaly.run_status(scored), contract, impact).join(
        found_anomalies(scored, anomaly_z), "run_id", "left").withColumn("anomalies", F.coalesce("anomalies", F.array().cast(NO_ANOMALIES)))
    return _with_evolution(judged, found), scored, found


def anomaly_schema() -> str:
    return (
        "run_id string, timestamp timestamp, dataset_name string, metric_name string, metric_value double, "
        "day_of_week int, baseline_type string, baseline_mean double, baseline_std double, sample_count bigint, "
        "z_score double, is_anomaly boolean"
    )
