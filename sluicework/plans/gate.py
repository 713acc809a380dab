"""The gate: judge a dataset, write its rows where the verdict sends them, and record the run."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any, Callable, Mapping

from pyspark.errors import (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException,
    NumberFormatException, SparkRuntimeException,
)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sluicework import fixed_values as fv
from sluicework.contracts import Contract
from sluicework.functions.rules import at_time, moment
from sluicework.operators import alerts as A, anomaly, lineage as L
from sluicework.operators import profile as P
from sluicework.operators.profile import Batch
from sluicework.plans import fleet, reports
from sluicework.plans.judge import judge, schema_gate
from sluicework.session import durable, error_text, move_folders, remove, small_frame
from sluicework.sources import landing, readers, sinks
from sluicework.sources.store import Store

#: Errors that a check's own condition can raise; anything else, such as a lost executor, is no fault of a check.
CHECK_ERRORS = (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException,
    NumberFormatException, SparkRuntimeException,
)

Sink = Callable[[DataFrame, str], Any]


@dataclass
class Gate:
    """Everything around a verdict: history, lineage, alert rules and target folders.

    ``sink`` receives the rows of passing batches; by default they are written to
    ``{root}/warehouse/{dataset}``, one folder per batch.
    """

    spark: SparkSession
    root: str
    lineage: Mapping[str, Any] = field(default_factory=dict)
    alerts: Mapping[str, Any] = field(default_factory=dict)
    sink: Sink | None = None
    health: DataFrame | None = None
    learn_from: str = "passed"

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")
        self.store = Store(self.spark, f"{self.root}/system")
        self.consumers, self.upstreams, self.owners = L.edges(self.spark, self.lineage)

    def impact(self, datasets: DataFrame) -> DataFrame:
        return L.impact(datasets, self.consumers, self.owners)

    def root_cause(self, dataset: str) -> str:
        """Why a load to the warehouse may fail now, from the upstreams' health."""
        if self.health is None:
            health = small_frame(self.spark, [], "upstream string, timestamp timestamp, status string, details string")
        else:
            health = self.health
        one = small_frame(self.spark, [(dataset,)], "dataset string")
        return L.root_cause(one, self.upstreams, health).first()["root_cause"]

    def evaluate(self, df: DataFrame, contract: Contract, *, batch: Batch = None,
                 at: Column | None = None, as_of: datetime | None = None, against: str = "stored",
                 columnar: bool = True, mtime: float | None = None, take_action: bool = True) -> DataFrame:
        """Judge, act and record; returns one verdict row per batch."""
        started = time.time()
        as_of = as_of or datetime.now()
        name = contract.dataset
        impact = self.impact(small_frame(self.spark, [(name,)], "dataset string"))
        work = f"{self.root}/_work/{uuid.uuid4().hex}"
        args = dict(batch=batch, at=at, as_of=as_of, against=against, columnar=columnar, folder=work)
        history = self.store.read("metric_history", name)
        verdicts, scored, found = self._judged(df, contract, history, impact, args)
        # recording appends to the history being read, so the result is fixed first
        kept = f"{self.root}/verdicts/{name}"
        verdicts = durable(verdicts.withColumn("timely", F.lit(True)), work if take_action else kept)
        if take_action:
            verdicts = durable(self._act(df, verdicts, contract, batch, as_of, found), kept)
        self._record(verdicts, scored, contract, as_of, mtime, int((time.time() - started) * 1000))
        remove(self.spark, work)
        return verdicts

    def _judged(self, df: DataFrame, contract: Contract, history: DataFrame, impact: DataFrame,
                args: dict) -> tuple[DataFrame, DataFrame, dict]:
        """Judge in one pass; if a custom check fails while running, set those that fail aside and count them as failed."""
        try:
            return judge(df, contract, history, impact, **args)
        except CHECK_ERRORS:
            rows = P._coerced(P.fold_nan(df), contract)
            errors = {c.name: self._error_of(rows, c.condition, args["as_of"]) for c in contract.checks if c.condition}
            if not any(errors.values()):
                raise
            return judge(df, fleet.without(contract, errors), history, impact, **args)

    def _error_of(self, df: DataFrame, condition: str, as_of: datetime) -> str | None:
        try:
            df.agg(F.count_if(F.expr(f"NOT ({at_time(condition, as_of)})"))).first()
            return None
        except CHECK_ERRORS as exc:
            return error_text(exc)

    def _divided(self, rows: DataFrame, onward: str) -> str:
        """Write rows that have a status once, each under its destination, into a folder of their own."""
        attempt = f"{self.root}/_attempts/{uuid.uuid4().hex}"
        where_to = F.when(F.col("status") == "BLOCKED", "quarantine").otherwise(onward)
        sinks.write_divided(rows.withColumn("destination", where_to).drop("status"), attempt)
        return attempt

    def _handed_on(self, attempt: str, df: DataFrame, name: str, as_of: datetime) -> tuple[str | None, str, str]:
        """Load what was written for the warehouse: a changed status or None, a note for the reason, and the load status."""
        try:
            if self.sink is not None:
                self._sent(self._landed(attempt, "warehouse", df), name, attempt, as_of)
            else:
                move_folders(self.spark, f"{attempt}/destination=warehouse", f"{self.root}/warehouse/{name}")
        except Exception as exc:
            status, state = sinks.load_failure(error_text(exc))
            note = (fv.MSG["infra_note"] % self.root_cause(name) if status == "WARNING"
                    else fv.MSG["load_failed_note"] % error_text(exc))
            return status, note, state
        return None, "", "LOADED"

    def _landed(self, attempt: str, destination: str, columns: DataFrame) -> DataFrame:
        kinds = T.StructType([*columns.schema.fields, T.StructField("batch_key", T.StringType())])
        return self.spark.read.schema(kinds).parquet(f"{attempt}/destination={destination}")

    def _sent(self, landed: DataFrame, name: str, attempt: str, as_of: datetime) -> None:
        """Hand the landed rows to the sink, but for batches that an earlier attempt has loaded with the same rows.

        The log has a record of each batch: LOADING before, LOADED or FAILED after. Records of a
        batch and attempt replace each other, so a killed run leaves LOADING, and is tried again.
        """
        label = attempt.rsplit("/", 1)[-1]
        records = durable(sinks.load_records(landed, name, label, moment(as_of), "LOADING"), attempt)
        log = self.store.read("load_log", name)
        left = durable(sinks.still_to_load(records, log), attempt)
        if left.isEmpty():
            return
        self.store.append("load_log", left)
        todo = landed.join(left.select(F.col("batch").alias("batch_key")), "batch_key", "left_semi")
        try:
            self.sink(todo.select(*landed.columns), name)
        except Exception:
            self.store.append("load_log", left.withColumn("state", F.lit("FAILED")))
            raise
        self.store.append("load_log", left.withColumn("state", F.lit("LOADED")))

    @staticmethod
    def _stamp(as_of: datetime) -> str:
        """The time of a run as a folder name, so that runs within a second stay apart."""
        return as_of.strftime("%Y%m%d_%H%M%S") + (f"_{as_of.microsecond:06d}" if as_of.microsecond else "")

    def _act(self, df: DataFrame, verdicts: DataFrame, contract: Contract, batch: Batch,
             as_of: datetime, found: dict) -> DataFrame:
        name = contract.dataset
        tally = {r["status"]: r["n"] for r in verdicts.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocked = tally.get("BLOCKED", 0)
        good = F.col("status") != "BLOCKED"
        attempt, acted = self._divided(sinks.by_verdict(df, verdicts, batch), "warehouse"), verdicts
        if sum(tally.values()) > blocked:
            status, note, state = self._handed_on(attempt, df, name, as_of)
            acted = verdicts.withColumns({
                "load_status": F.when(good, state).otherwise(F.col("load_status")),
                "reason": F.when(good, F.concat("reason", F.lit(note))).otherwise(F.col("reason")),
                "status": F.when(good, F.lit(status)).otherwise(F.col("status")) if status else F.col("status"),
            })
        if blocked:
            place = f"quarantine/{name}/ts={self._stamp(as_of)}"
            move_folders(self.spark, f"{attempt}/destination=quarantine", f"{self.root}/{place}")
            self.store.append("quarantine_reports", self._reports(verdicts.where(~good), name, place, "QUARANTINED", as_of, found))
        remove(self.spark, attempt)
        return acted

    def stage(self, df: DataFrame, verdicts: DataFrame, contract: Contract, as_of: datetime,
              batch: Batch = None) -> str:
        """Write approved batches to staging with an audit row each; the same batch replaces itself."""
        name = contract.dataset
        path = f"{self.root}/staging/{name}"
        approved = verdicts.where(F.col("status") != "BLOCKED")
        sinks.write_batches(sinks.by_verdict(df, approved, batch).drop("status"), path)
        self.store.append("staging_log", self._reports(approved, name, f"staging/{name}", "APPROVED", as_of, {}))
        return path

    def _reports(self, verdicts: DataFrame, name: str, place: str, status: str, as_of: datetime, found: dict) -> DataFrame:
        schema_errors = [fv.MSG["missing_column"] % c for c in found.get("missing_columns", [])] + [
            fv.MSG["type_mismatch"] % m["column"] for m in found.get("type_mismatches", [])]
        errors = F.array(*[F.lit(e) for e in schema_errors]).cast("array<string>")
        have = set(verdicts.columns)
        found_in_data = F.array().cast("array<string>")
        if "checks" in have:
            failed = F.filter("checks", lambda k: ~k["passed"])
            found_in_data = F.transform(failed, lambda k: F.format_string(
                fv.MSG["consistency"], k["name"], F.coalesce(k["violation_count"], F.lit(0))))
            found_in_data = F.concat(found_in_data, F.transform("constraints", lambda c: c["message"]))
        counted = sinks.error_summary(verdicts.withColumns({
            "timeliness_passed": F.col("timely") if "timely" in have else F.lit(True), "schema_errors": errors, "profiling_errors": found_in_data}))
        body = F.to_json(F.struct(
            F.lit(status).alias("status"), "dataset", "batch", "reason", "quality_score", "anomaly_count",
            "schema_errors", "profiling_errors", F.lit(json.dumps(found)).alias("schema_evolution")))
        return counted.select(
            F.lit(name).alias("dataset_name"), "batch", moment(as_of).alias("timestamp"),
            F.concat(F.lit(f"{place}/"), sinks.folder_of(F.col("batch"))).alias("location"),
            F.lit(status).alias("status"), "total_errors", body.alias("report"))

    def _record(self, verdicts: DataFrame, scored: DataFrame, contract: Contract, as_of: datetime,
                mtime: float | None, duration_ms: int) -> None:
        told = verdicts.withColumns({
            "dataset_name": F.lit(contract.dataset), "contract_path": F.lit(contract.path), "mtime": F.lit(mtime).cast("double")})
        self._record_all(told, scored, as_of, duration_ms)

    def _record_all(self, verdicts: DataFrame, scored: DataFrame, as_of: datetime, duration_ms: int) -> None:
        """Append what runs of any number of datasets leave; ``verdicts`` also has dataset_name, contract_path and mtime."""
        learnt = scored
        if self.learn_from == "passed":
            learnt = scored.join(verdicts.where(F.col("status") == "PASSED").select("run_id"), "run_id", "left_semi")
        last = F.max_by(F.struct("contract_path", "criticality", "status", "mtime"), F.struct("timestamp", "batch")).alias("l")
        self.store.append_all({
            "run_history": verdicts.select(
                "run_id", "timestamp", "dataset_name", "status", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
                "anomaly_count", F.col("max_z").alias("z_score_max"), "reason", F.lit(duration_ms).alias("duration_ms")),
            "dataset_registry": verdicts.groupBy("dataset_name").agg(last).select(
                "dataset_name", "l.contract_path", F.lit("active").alias("lifecycle"), "l.criticality",
                moment(as_of).alias("last_scanned"), F.col("l.status").alias("last_status"), F.col("l.mtime").alias("last_file_mtime")),
            "metric_history": learnt,
            "learned_thresholds": anomaly.learned_thresholds(learnt),
        })

    def record_metrics(self, metrics: DataFrame) -> None:
        """Add rows in the layout of metric history, whatever their verdict."""
        self.store.append("metric_history", metrics)

    def alerts_for(self, verdicts: DataFrame) -> DataFrame:
        rules, channels = A.routing_tables(self.spark, self.alerts)
        return A.payloads(A.route(verdicts, rules, channels))

    def evaluate_file(self, path: str, contract: Contract, max_age_hours: float | None = None, **args: Any) -> DataFrame:
        """Judge one file. A file that is too old, missing or unreadable is blocked and not recorded.

        With ``max_age_hours`` timeliness is the first stage: a stale file is not read.
        """
        if max_age_hours is not None:
            fresh, late = landing.check_timeliness(self.spark, path, args.get("as_of") or datetime.now(), max_age_hours)
            if not fresh:
                return self.unjudged(contract.dataset, "BLOCKED", late, fv.ACTIONS["abort"])
        kind = readers.format_of(path)
        try:
            df = readers.load(self.spark, path, kind)
        except readers.SourceError as exc:
            key = "verdict_file_missing" if exc.issue_type == "file_not_found" else "verdict_load_failed"
            detail = path if exc.issue_type == "file_not_found" else exc.message
            return self.unjudged(contract.dataset, "BLOCKED", fv.MSG[key] % detail, fv.ACTIONS["abort"])
        if contract.error is not None:
            return self.unjudged(contract.dataset, "BLOCKED", fv.MSG["contract_error"] % contract.path, fv.ACTIONS["abort"])
        row = landing.list_files(self.spark, path, "*").agg(F.max("mtime").alias("m")).first()
        return self.evaluate(df, contract, columnar=kind in readers.COLUMNAR, mtime=row["m"], **args)

    def unjudged(self, dataset: str, status: str, reason: str, actions: list[str]) -> DataFrame:
        return small_frame(
            self.spark, [(dataset, status, reason, actions)], "dataset string, status string, reason string, actions array<string>")

    def evaluate_all(self, contracts: list[Contract], paths: Mapping[str, str], *, skip_unchanged: bool = False,
                     parallel: int = 4, as_of: datetime | None = None, take_action: bool = True) -> tuple[DataFrame, DataFrame]:
        """Judge every dataset that is active, has data and, if asked, changed; returns results and totals.

        Judging takes as many jobs for many datasets as for one. Only what concerns files one by one is
        done side by side: finding out a file's columns, and writing the rows of a dataset where its verdict sends them.
        """
        started, as_of = time.time(), as_of or datetime.now()
        known = self.store.registry() if skip_unchanged else None
        plan = {r["dataset"]: r for r in fleet.waiting(self.spark, contracts, dict(paths), known).collect()}
        outcomes = {k: (r["decision"], r["reason"]) for k, r in plan.items() if r["decision"] != "JUDGE"}
        chosen = [k for k in contracts if plan[k.dataset]["decision"] == "JUDGE"]

        def opened(contract: Contract) -> fleet.Dataset | str:
            path = paths[contract.dataset]
            if contract.error is not None:
                return fv.MSG["contract_error"] % contract.path
            kind = readers.format_of(path)
            try:
                df = readers.load(self.spark, path, kind)
            except readers.SourceError as exc:
                return fv.MSG["verdict_load_failed"] % exc.message
            return fleet.Dataset(df, contract, kind in readers.COLUMNAR, plan[contract.dataset]["mtime"])

        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            loaded = list(pool.map(opened, chosen))
            outcomes.update({k.dataset: ("BLOCKED", d) for k, d in zip(chosen, loaded) if isinstance(d, str)})
            sets = [d for d in loaded if not isinstance(d, str)]
            if sets:
                judged = self._judged_together(sets, as_of, pool if take_action else None, started)
                outcomes.update(judged)
        rows = [(k.dataset, *outcomes[k.dataset]) for k in contracts]
        results = small_frame(self.spark, rows, "dataset string, status string, reason string")
        return results, reports.summary_counts(results)

    def _judged_together(self, sets: list[fleet.Dataset], as_of: datetime, pool: ThreadPoolExecutor | None,
                         started: float) -> dict[str, tuple[str, str]]:
        work = f"{self.root}/_work/{uuid.uuid4().hex}"

        def mark(df: DataFrame, contract: Contract) -> Contract:
            rows = P._coerced(P.fold_nan(df), contract)
            return fleet.without(contract, {c.name: self._error_of(rows, c.condition, as_of) for c in contract.checks if c.condition})

        done = fleet.judge_all(self.spark, sets, self.store.read("metric_history"), self.impact, as_of, work, mark)
        verdicts = done.verdicts
        told = {r["dataset"]: r for r in verdicts.select("dataset", "status", "reason", "load_status").collect()}
        after = {k: (r["status"], r["reason"], r["load_status"]) for k, r in told.items()}
        if pool is not None:
            acting = [s for s in sets if s.contract.dataset in told]
            moved = list(pool.map(lambda s: self._move(s, told[s.contract.dataset], as_of), acting))
            after.update(zip((s.contract.dataset for s in acting), moved))
            held = [s.contract.dataset for s in acting if told[s.contract.dataset]["status"] == "BLOCKED"]
            if held:
                self.store.append("quarantine_reports", reduce(DataFrame.unionByName, [
                    self._reports(verdicts.where(F.col("dataset") == k), k, f"quarantine/{k}/ts={self._stamp(as_of)}", "QUARANTINED", as_of, done.found[k])
                    for k in held]))
        final = small_frame(self.spark, [(k, *v) for k, v in after.items()], "dataset string, status string, reason string, load_status string")
        kept = durable(verdicts.drop("status", "reason", "load_status").join(final, "dataset"), f"{self.root}/verdicts/_together")
        self._record_all(kept.withColumn("dataset_name", F.col("dataset")), done.scored, as_of, int((time.time() - started) * 1000))
        remove(self.spark, work)
        failed = {k: ("BLOCKED", fv.MSG["evaluation_error"] % e) for k, e in done.errors.items()}
        return {**failed, **{k: v[:2] for k, v in after.items()}}

    def _move(self, one: fleet.Dataset, verdict: Any, as_of: datetime) -> tuple[str, str, str | None]:
        """Write a whole dataset where its verdict sends it; returns status, reason and load status."""
        name, status, reason = one.contract.dataset, verdict["status"], verdict["reason"]
        rows = one.data.withColumns({"batch_key": P.batch_of(None), "status": F.lit(status)})
        attempt = self._divided(rows, "warehouse")
        try:
            if status == "BLOCKED":
                move_folders(self.spark, f"{attempt}/destination=quarantine", f"{self.root}/quarantine/{name}/ts={self._stamp(as_of)}")
                return status, reason, verdict["load_status"]
            status, note, state = self._handed_on(attempt, one.data, name, as_of)
            return status or verdict["status"], reason + note, state
        finally:
            remove(self.spark, attempt)

    def process(self, df: DataFrame, contract: Contract, as_of: datetime, batch: Batch = None, **args: Any) -> dict:
        """Judge and move in one call; every batch goes where its own verdict sends it.

        Returns the overall status (FAIL if a batch is blocked), the action taken, the new location
        and ``batches``: status, action and location of each.
        """
        verdicts = self.evaluate(df, contract, as_of=as_of, batch=batch, take_action=False, **args)
        good, name = F.col("status") != "BLOCKED", contract.dataset
        tally = verdicts.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")).first()
        places = {"QUARANTINED": f"quarantine/{name}/ts={self._stamp(as_of)}", "STAGED": f"staging/{name}"}
        attempt, logs = self._divided(sinks.by_verdict(df, verdicts, batch), "staging"), {}
        for folder, place in (("quarantine", places["QUARANTINED"]), ("staging", places["STAGED"])):
            move_folders(self.spark, f"{attempt}/destination={folder}", f"{self.root}/{place}")
        if tally["bad"]:
            logs["quarantine_reports"] = self._reports(
                verdicts.where(~good), name, places["QUARANTINED"], "QUARANTINED", as_of, schema_gate(df, contract))
        if tally["good"]:
            logs["staging_log"] = self._reports(verdicts.where(good), name, places["STAGED"], "APPROVED", as_of, {})
        self.store.append_all(logs)
        remove(self.spark, attempt)
        action = F.when(good, "STAGED").otherwise("QUARANTINED")
        place = F.when(good, places["STAGED"]).otherwise(places["QUARANTINED"])
        taken = "SPLIT" if tally["good"] and tally["bad"] else "QUARANTINED" if tally["bad"] else "STAGED"
        return {
            "overall_status": "FAIL" if tally["bad"] else "PASS", "action_taken": taken,
            "new_location": self.root if taken == "SPLIT" else f"{self.root}/{places[taken]}",
            "batches": verdicts.select("batch", "status", action.alias("action_taken"), F.concat(
                place, F.lit("/"), sinks.folder_of(F.col("batch"))).alias("location")),
        }
