"""One-pass profiling of batches against a contract.

Every count, rule and custom check of all columns is one aggregate of a single
scan, grouped by batch. Exact distinct counts run beside it over one narrow
column at a time: folded into the same aggregate they would carry every other
aggregate's buffer through a shuffle of all distinct values.
"""

from __future__ import annotations

import re
from datetime import datetime
from typing import Callable, Mapping, NamedTuple, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sluicework import fixed_values as fv
from sluicework.contracts import Check, ColumnSpec, Contract
from sluicework.functions import rules
from sluicework.functions.rules import literal, moment, quoted, ref
from sluicework.functions.types import is_numeric
from sluicework.session import error_text, small_frame

WHOLE = "all"


Batch = Column | str | Sequence[Column | str] | None


def _keys(batch: Batch) -> list[Column]:
    parts = [] if batch is None else [batch] if isinstance(batch, (Column, str)) else list(batch)
    return [ref(p) if isinstance(p, str) else p for p in parts]


def batch_of(batch: Batch) -> Column:
    """The batch key of a row as text, never null; several columns are joined by ``|``.

    Different keys have different texts: a null reads ``\\N`` and an empty text ``\\E``, and a
    backslash, or a ``|`` among several columns, has a backslash before it.
    """
    keys = _keys(batch)
    return F.lit(WHOLE) if not keys else F.concat_ws("|", *[_key_text(k, len(keys) > 1) for k in keys])


def _key_text(key: Column, joined: bool) -> Column:
    text = F.replace(key.cast("string"), F.lit("\\"), F.lit("\\\\"))
    if joined:
        text = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.when(text.isNull(), "\\N").when(text == "", "\\E").otherwise(text)


def by_batch(df: DataFrame, batch: Batch, aggs: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """Group by the batch key in its own types; it becomes text only on the result rows."""
    keys = [k.alias(f"_b{i}") for i, k in enumerate(_keys(batch))]
    grouped = df.groupBy(*keys, *extra).agg(*aggs)
    names = [f"_b{i}" for i in range(len(keys))]
    return grouped.select(batch_of(names or None).alias("batch"), *[F.col(c) for c in grouped.columns if c not in names])


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN counts as null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(ref(c)), ref(c)) for c in floats}) if floats else df


def _told_apart(text: Column) -> Column:
    """A text, or its 256-bit digest where that is shorter: whole texts are not shuffled to be counted."""
    return F.when(F.octet_length(text) > 72, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def distinct_counts(df: DataFrame, columns: Sequence[str], batch: Batch = None,
                    columnar: bool = True) -> DataFrame:
    """Exact distinct non-null values: one row per ``batch, column_name``.

    Values are collapsed per task before the shuffle on (batch, value), so neither a
    hot value nor a hot batch lands in one task. Long texts count by their digests. A columnar source is read once
    per column; a row-oriented one once per type, with the columns of that type stacked.
    """
    keys = [k.alias(f"_b{i}") for i, k in enumerate(_keys(batch))]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    df = df.withColumns({c: _told_apart(ref(c)) for c in columns if isinstance(kinds[c], T.StringType)})
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(c if columnar else kinds[c].simpleString(), []).append(c)
    names = [f"_b{i}" for i in range(len(keys))]
    parts = []
    for held in groups.values():
        if len(held) == 1:
            values = df.select(*keys, F.lit(held[0]).alias("column_name"), ref(held[0]).alias("value"))
        else:
            stacked = F.array(*[F.struct(F.lit(c).alias("column_name"), ref(c).alias("value")) for c in held])
            values = df.select(*keys, F.inline(stacked))
        distinct = values.where("value is not null").distinct()
        parts.append(by_batch(distinct, names or None, [F.count(F.lit(1)).alias("unique_count")], ["column_name"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def approx_distinct_counts(df: DataFrame, columns: Sequence[str], batch: Batch = None) -> DataFrame:
    """Sketch-based counts in one scan, on request only."""
    counts = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.approx_count_distinct(ref(c)).alias("unique_count")) for c in columns
    ])
    return by_batch(df, batch, [counts.alias("u")]).select("batch", F.inline("u"))


def usable_checks(df: DataFrame, contract: Contract, as_of: datetime | None) -> tuple[list[Check], dict[str, str]]:
    """Checks that analyse against the data, and the error text of those that do not."""
    good, bad = [], {}
    for check in contract.checks:
        if not check.condition:
            continue
        if check.error is not None:
            bad[check.name] = check.error
            continue
        try:
            df.select(F.expr(f"NOT ({rules.at_time(check.condition, as_of)})")).schema
            good.append(check)
        except AnalysisException as exc:
            bad[check.name] = error_text(exc)
    return good, bad


def _coerced(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared dates held as text become timestamps for the checks; the raw text stays under ``raw:``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [
        c.name for c in contract.columns
        if c.declared in fv.DATETIME_DECLARED and isinstance(kinds.get(c.name), T.StringType)
    ]
    if not texts:
        return df
    return df.withColumns({f"raw:{c}": ref(c) for c in texts}).withColumns(
        {c: F.try_to_timestamp(ref(c)) for c in texts}
    )


def summarise(df: DataFrame, contract: Contract, batch: Batch = None, *,
              metrics: bool = True, distinct: str = "keys", columnar: bool = True,
              as_of: datetime | None = None) -> DataFrame:
    """One row per batch holding every raw count that profiling and drift metrics need.

    ``metrics`` adds null counts and means of columns outside the contract; without
    it the scan reads contract columns and whatever the checks mention.
    ``distinct`` is ``keys`` (exact, primary keys only: all that scores need), ``exact`` (every column), ``approx`` or ``none``.
    """
    plan = _planned(df, contract, metrics, as_of)
    exprs = [F.expr(sql).alias(name) for name, sql in plan.aggs.items()]
    scan = by_batch(plan.work, batch, exprs)
    merged = _with_distinct(scan, plan.data, plan.present, batch, distinct, columnar)
    return _shape(merged, contract, plan.present, plan.kinds, plan.good, plan.bad, metrics)


class _Plan(NamedTuple):
    """What a summary of one dataset needs: ``aggs`` are the aggregates by name, over the rows of ``work``."""

    data: DataFrame
    work: DataFrame
    kinds: dict
    present: list[ColumnSpec]
    good: list[Check]
    bad: dict[str, str]
    aggs: dict[str, str]


def _planned(df: DataFrame, contract: Contract, metrics: bool, as_of: datetime | None) -> _Plan:
    df = fold_nan(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in contract.columns if c.name in kinds]
    work = _coerced(df, contract)
    good, bad = usable_checks(work, contract, as_of)
    known = {c.name: i for i, c in enumerate(present)}
    aggs = {"total_rows": "COUNT(1)"}
    for i, spec in enumerate(present):
        kind = kinds[spec.name]
        raw = quoted(f"raw:{spec.name}" if f"raw:{spec.name}" in work.columns else spec.name)
        aggs[f"c{i}_filled"] = f"COUNT({raw})"
        if rules.has_range(spec, kind):
            number = rules.as_number(raw, kind)
            aggs.update({f"c{i}_{s}": f"{f}({number})" for s, f in (("min", "MIN"), ("max", "MAX"), ("mean", "AVG"))})
        marks = {
            "below": rules.below_min(spec, raw, kind), "above": rules.above_max(spec, raw, kind),
            "pattern": rules.breaks_pattern(spec, raw, kind), "allowed": rules.not_allowed(spec, raw, kind),
        }
        aggs.update({f"c{i}_{k}": f"COUNT_IF({m})" for k, m in marks.items() if m is not None})
    for j, check in enumerate(good):
        aggs[f"k{j}"] = f"COUNT_IF(NOT ({rules.at_time(check.condition, as_of)}))"
    for m, (name, kind) in enumerate(kinds.items() if metrics else ()):
        if name not in known:
            aggs[f"m{m}_filled"] = f"COUNT({quoted(name)})"
        if is_numeric(kind) and f"c{known.get(name)}_mean" not in aggs:
            aggs[f"m{m}_mean"] = f"AVG(CAST({quoted(name)} AS DOUBLE))"
    return _Plan(df, work, kinds, present, good, bad, aggs)


_AGGREGATE = re.compile(r"(COUNT_IF|COUNT|MIN|MAX|AVG)\((.*)\)", re.S)
_SHOWN = {"MIN": "lo", "MAX": "hi", "AVG": "av"}


def summarise_many(sets: Mapping[str, tuple[DataFrame, Contract]], as_of: datetime | None = None,
                   keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, DataFrame]:
    """The summary of each whole dataset, as ``summarise`` gives it, from one aggregate over all of them.

    Each dataset's rows are projected to one layout: 0 or 1 for whatever it counts, and the numbers
    whose range and mean it takes. Their union is grouped by dataset once, and so are the values of
    all primary keys: the number of shuffles doesn't grow with the number of datasets. ``keep`` stores
    the result, one row a dataset, from which each summary is a projection.
    """
    plans = {name: _planned(df, contract, True, as_of) for name, (df, contract) in sets.items()}
    spark = next(iter(plans.values())).work.sparkSession
    counted, numbers, shown = {}, {}, {}
    for name, plan in plans.items():
        counted[name], numbers[name], shown[name] = [], [], []
        for alias, sql in plan.aggs.items():
            kind, arg = _AGGREGATE.fullmatch(sql).groups()
            if kind in _SHOWN:
                number = f"CAST({arg} AS DOUBLE)"
                if number not in numbers[name]:
                    numbers[name].append(number)
                shown[name].append(f"{_SHOWN[kind]}{numbers[name].index(number)} AS {alias}")
            else:
                hit = f"({arg}) IS NOT NULL" if kind == "COUNT" else f"({arg})"
                shown[name].append(f"n{len(counted[name])} AS {alias}")
                counted[name].append(f"CASE WHEN {hit} THEN 1L ELSE 0L END")
    n, v = max(map(len, counted.values())), max(map(len, numbers.values()))
    layout = ["dataset string", *(f"n{i} bigint" for i in range(n)), *(f"v{i} double" for i in range(v))]
    rows = small_frame(spark, [(name, *[0] * n, *[None] * v) for name in plans], ", ".join(layout))  # an empty dataset has a row too
    values = small_frame(spark, [], "dataset string, column_name string, value string")
    for name, plan in plans.items():
        rows = rows.unionByName(plan.work.selectExpr(
            f"{literal(name)} AS dataset",
            *[f"{counted[name][i] if i < len(counted[name]) else '0L'} AS n{i}" for i in range(n)],
            *[f"{numbers[name][i] if i < len(numbers[name]) else 'CAST(NULL AS DOUBLE)'} AS v{i}" for i in range(v)]))
        for c in plan.present:
            if c.primary_key:
                values = values.unionByName(plan.data.select(
                    F.lit(name).alias("dataset"), F.lit(c.name).alias("column_name"), _told_apart(_as_text(ref(c.name), plan.kinds[c.name])).alias("value")))
    grouped = rows.groupBy("dataset").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)],
        *[f(f"v{i}").alias(f"{k}{i}") for i in range(v) for k, f in (("lo", F.min), ("hi", F.max), ("av", F.avg))])
    unique = values.where("value IS NOT NULL").distinct().groupBy("dataset", "column_name").agg(F.count(F.lit(1)).alias("u"))
    unique = unique.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "u"))).alias("unique"))
    stored = keep(grouped.join(unique, "dataset", "left"))
    out = {}
    for name, plan in plans.items():
        keys = [f"COALESCE(unique[{literal(c.name)}], 0L) AS c{i}_unique" if c.primary_key else f"CAST(NULL AS BIGINT) AS c{i}_unique"
                for i, c in enumerate(plan.present)]
        row = stored.where(F.col("dataset") == name).select(batch_of(None).alias("batch"), *map(F.expr, [*shown[name], *keys]))
        out[name] = _shape(row, sets[name][1], plan.present, plan.kinds, plan.good, plan.bad, True)
    return out


def _as_text(value: Column, kind: T.DataType) -> Column:
    """A text that equals another one just where the values are equal."""
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def _with_distinct(scan: DataFrame, df: DataFrame, present: list[ColumnSpec], batch: Batch,
                   distinct: str, columnar: bool) -> DataFrame:
    """Bring both results to one row per batch by a union and a grouping: no join, no broadcast."""
    chosen = {} if distinct == "none" else {
        i: c.name for i, c in enumerate(present) if distinct != "keys" or c.primary_key}
    unknown = [f"CAST(NULL AS BIGINT) AS c{i}_unique" for i in range(len(present)) if i not in chosen]
    if not chosen:
        return scan.selectExpr("*", *unknown)
    names = list(chosen.values())
    counted = (
        approx_distinct_counts(df, names, batch) if distinct == "approx" else distinct_counts(df, names, batch, columnar))
    wide = scan.select("batch", F.struct(*[c for c in scan.columns if c != "batch"]).alias("scan"))
    merged = wide.unionByName(counted, allowMissingColumns=True).groupBy("batch").agg(
        F.any_value("scan", F.lit(True)).alias("scan"),
        *[
            F.expr(f"COALESCE(MAX(unique_count) FILTER (WHERE column_name = {literal(c)}), 0L)").alias(f"c{i}_unique")
            for i, c in chosen.items()
        ],
    )
    return merged.selectExpr("batch", "scan.*", *[f"c{i}_unique" for i in chosen], *unknown)


def _named(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{literal(k)}, {v}" for k, v in fields.items()) + ")"


def _array(items: list[str], element: str) -> str:
    return f"CAST(array({', '.join(items)}) AS array<{element}>)"


CHECK_COUNT = "struct<name:string,severity:string,sql:string,violation_count:bigint,error:string>"
METRIC = "struct<metric_name:string,metric_value:double>"
CONSTRAINT = "struct<type:string,severity:string,message:string,expected:bigint,actual:bigint>"


_REPORT = {
    "column_name": "string", "null_count": "bigint", "null_rate": "double", "unique_count": "bigint", "uniqueness_rate": "double",
    **dict.fromkeys(("min_value", "max_value", "mean_value"), "double"),
    **dict.fromkeys(("not_null_violations", "duplicate_count", "below_min", "above_max", "pattern_mismatches", "disallowed", "violation_count"), "bigint"),
    "quality_score": "double"}
NO_REPORTS = f"CAST(array() AS array<struct<{','.join(f'{k}:{v}' for k, v in _REPORT.items())}>>)"


def _shape(row: DataFrame, contract: Contract, present: list[ColumnSpec], kinds: dict, good: list[Check],
           bad: dict[str, str], metrics: bool) -> DataFrame:
    have = set(row.columns)
    known = {c.name: i for i, c in enumerate(present)}

    def opt(name: str, kind: str) -> str:
        return f"CAST({name if name in have else 'NULL'} AS {kind})"

    stats = {
        c.name: _named({
            "filled": f"c{i}_filled", "unique_count": f"c{i}_unique",
            **{f"{s}_value": opt(f"c{i}_{s}", "DOUBLE") for s in ("min", "max", "mean")},
            **{k: f"c{i}_{k}" if f"c{i}_{k}" in have else "0L" for k in ("below", "above", "pattern", "allowed")},
        })
        for c, i in ((c, known[c.name]) for c in present)
    }
    counts = {c.name: f"k{j}" for j, c in enumerate(good)}
    checks = [
        _named({"name": literal(c.name), "severity": literal(c.severity), "sql": literal(c.condition),
                "violation_count": counts.get(c.name, "CAST(NULL AS BIGINT)"),
                "error": f"CAST({literal(bad.get(c.name))} AS STRING)"})
        for c in contract.checks if c.name in counts or c.name in bad
    ]
    measured = [_named({"metric_name": "'row_count'", "metric_value": "CAST(total_rows AS DOUBLE)"})]
    for m, (name, kind) in enumerate(kinds.items() if metrics else ()):
        filled = f"c{known[name]}_filled" if name in known else f"m{m}_filled"
        measured.append(_named({"metric_name": literal(f"null_rate_{name}"),
                                "metric_value": f"try_divide(total_rows - {filled}, total_rows)"}))
        mean = f"m{m}_mean" if f"m{m}_mean" in have else f"c{known.get(name)}_mean"
        if mean in have and is_numeric(kind):
            measured.append(_named({"metric_name": literal(f"mean_{name}"), "metric_value": mean}))
    return row.selectExpr(
        "batch", "total_rows", f"{len(kinds)} AS total_columns",
        f"{_named(stats) if stats else 'CAST(NULL AS INT)'} AS stats",
        f"{_array(checks, CHECK_COUNT)} AS check_counts",
        f"{_array(measured, METRIC)} AS metrics",
    )


def _column_report(spec: ColumnSpec) -> str:
    s = f"stats.{quoted(spec.name)}"
    nulls = f"(total_rows - {s}.filled)"
    not_null = "0L" if spec.nullable else nulls
    duplicates = f"COALESCE(total_rows - {s}.unique_count, 0L)" if spec.primary_key else "0L"
    hits = f"({not_null} + {duplicates} + {s}.below + {s}.above + {s}.pattern + {s}.allowed)"
    return _named({
        "column_name": literal(spec.name),
        "null_count": nulls,
        "null_rate": f"COALESCE(try_divide({nulls}, total_rows), 0D)",
        "unique_count": f"{s}.unique_count",
        "uniqueness_rate": f"CASE WHEN total_rows = 0 THEN 0D ELSE {s}.unique_count / total_rows END",
        "min_value": f"{s}.min_value", "max_value": f"{s}.max_value", "mean_value": f"{s}.mean_value",
        "not_null_violations": not_null,
        "duplicate_count": duplicates,
        "below_min": f"{s}.below", "above_max": f"{s}.above",
        "pattern_mismatches": f"{s}.pattern", "disallowed": f"{s}.allowed",
        "violation_count": hits,
        "quality_score": f"COALESCE(GREATEST(0D, try_divide(total_rows - {hits}, total_rows) * 100), 0D)",
    })


def _constraint(kind: str, hit: str, key: str, bound: int) -> str:
    found = _named({
        "type": literal(kind), "severity": "'error'",
        "message": f"format_string({literal(fv.MSG[key])}, total_rows, {int(bound)}L)",
        "expected": f"{int(bound)}L", "actual": "total_rows",
    })
    return f"CASE WHEN total_rows {hit} {int(bound)} THEN {found} END"


def profile(summary: DataFrame, contract: Contract, carry: Sequence[str] = ()) -> DataFrame:
    """Column reports, row-count constraints, check results and the overall score, one row per batch.

    A pure projection of ``summarise``: nothing is scanned or shuffled again. ``carry`` names columns of the summary to keep.
    """
    if contract.error is not None:
        broken = _named({"type": "'CONTRACT_ERROR'", "severity": "'error'",
                         "message": literal(fv.MSG["contract_error"] % contract.path),
                         "expected": "NULL", "actual": "NULL"})
        return summary.selectExpr("batch", "total_rows", "total_columns", *carry, f"{NO_REPORTS} AS columns",
                                  f"{_array([broken], CONSTRAINT)} AS constraints", "100D AS overall_score")
    held = summary.schema["stats"].dataType
    present = set(held.names) if isinstance(held, T.StructType) else set()
    reports = [_column_report(c) for c in contract.columns if c.name in present]
    constraints = [
        _constraint(kind, hit, key, bound)
        for kind, hit, key, bound in (
            ("ROW_COUNT_BELOW_MIN", "<", "row_count_below", contract.min_rows),
            ("ROW_COUNT_ABOVE_MAX", ">", "row_count_above", contract.max_rows),
        )
        if bound is not None
    ]
    result = _named({
        "name": "k.name", "severity": "k.severity",
        "passed": "k.error IS NULL AND k.violation_count = 0",
        "violation_count": "k.violation_count", "total_rows": "total_rows",
        "violation_rate": "ROUND(COALESCE(try_divide(k.violation_count, total_rows), 0D), 4)",
        "sql": "k.sql", "error": "k.error",
    })
    out = summary.selectExpr(
        "batch", "total_rows", "total_columns", *carry,
        f"{'array(' + ', '.join(reports) + ')' if reports else NO_REPORTS} AS columns",
        f"array_compact({_array(constraints, CONSTRAINT)}) AS constraints",
        f"transform(check_counts, k -> {result}) AS checks",
    )
    if not reports:
        return out.selectExpr("*", "100D AS overall_score")
    score = (
        f"aggregate(columns, 0D, (acc, c) -> acc + c.quality_score) / {len(reports)} "
        f"- ({fv.CONSTRAINT_PENALTY}D * size(constraints) "
        f"+ {fv.FAILED_CHECK_PENALTY}D * size(filter(checks, k -> NOT k.passed)))"
    )
    return out.selectExpr("*", f"GREATEST(0D, {score}) AS overall_score")


def _violation_texts(spec: ColumnSpec, samples: str) -> str:
    """The violations of one column report in words."""

    def text(key: str, count: str, *args: str) -> str:
        return f"CASE WHEN {count} > 0 THEN format_string({', '.join([literal(fv.MSG[key]), count, *args])}) END"

    def rate(count: str) -> str:
        return f"COALESCE(try_divide(100D * {count}, total_rows), 0D)"

    return "array_compact(array(" + ", ".join([
        text("not_null", "not_null_violations", rate("not_null_violations")),
        text("primary_key", "duplicate_count", "uniqueness_rate * 100"),
        text("below_min", "below_min", literal(str(spec.min_value)), "CAST(min_value AS STRING)"),
        text("above_max", "above_max", literal(str(spec.max_value)), "CAST(max_value AS STRING)"),
        text("pattern", "pattern_mismatches", literal(spec.pattern or ""), rate("pattern_mismatches")),
        text("allowed_values", "disallowed", literal(str(list(spec.allowed_values))), samples),
    ]) + "))"


def column_profiles(profiles: DataFrame, digits: int = 4) -> DataFrame:
    """The report in long form, one row per batch and column, rates rounded."""
    flat = profiles.select("batch", "total_rows", F.inline("columns"))
    rounded = {c: F.round(c, digits) for c in ("null_rate", "uniqueness_rate", "mean_value")}
    return flat.withColumns({**rounded, "quality_score": F.round("quality_score", 2)})


def check_results(profiles: DataFrame) -> DataFrame:
    """One row per batch and custom check, with the message of a failed one."""
    message = F.when(~F.col("passed"), F.format_string(fv.MSG["consistency"], "name", "violation_count"))
    return profiles.select("batch", F.inline("checks")).withColumn("message", message)


def constraint_results(profiles: DataFrame) -> DataFrame:
    return profiles.select("batch", F.inline("constraints"))


def sample_offenders(df: DataFrame, contract: Contract, batch: Batch = None,
                     n: int = fv.SAMPLE_OFFENDERS) -> DataFrame:
    """The first ``n`` distinct values outside the allowed list, in value order.

    Offenders are made distinct before they are ranked and each task keeps only its
    own first ``n``, so the list never grows with the data.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    marks = {c.name: rules.not_allowed(c, quoted(c.name), kinds[c.name]) for c in contract.columns if c.name in kinds}
    held = F.array(*[
        F.when(F.expr(mark), F.struct(F.lit(name).alias("column_name"), ref(name).cast("string").alias("value")))
        for name, mark in marks.items() if mark is not None])
    if not any(marks.values()):
        return small_frame(df.sparkSession, [], "batch string, column_name string, samples array<string>")
    found = df.select(batch_of(batch).alias("batch"), F.inline(F.array_compact(held))).distinct()
    order = Window.partitionBy("batch", "column_name").orderBy("value")
    return (
        found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
        .groupBy("batch", "column_name").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    )


def violations(profiles: DataFrame, contract: Contract, samples: DataFrame | None = None) -> DataFrame:
    """Violation messages, one row per batch, column and violated rule."""
    if samples is not None:
        by_batch = samples.groupBy("batch").agg(
            F.map_from_entries(F.collect_list(F.struct("column_name", "samples"))).alias("_samples")
        )
        profiles = profiles.join(by_batch, "batch", "left")
    held = profiles.select("batch", "total_rows", *([] if samples is None else ["_samples"]), F.inline("columns"))
    branches = [
        f"WHEN {literal(c.name)} THEN " + _violation_texts(
            c, "'[]'" if samples is None else f"concat('[', COALESCE(array_join(_samples[{literal(c.name)}], ', '), ''), ']')")
        for c in contract.columns
    ]
    return held.selectExpr("batch", "column_name", f"explode(CASE column_name {' '.join(branches)} END) AS message")


def metric_rows(summary: DataFrame) -> DataFrame:
    """Row count, null rates and means in long form; a mean over no values is left out."""
    return summary.select("batch", F.inline("metrics")).where("metric_value is not null")


def rule_outcomes(profiles: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Every typed rule of the contract with what was measured for it, per batch.

    Freshness needs the data's latest timestamp and is evaluated by ``freshness_outcomes``.
    """
    def found(rule: str, column: str, check: str, count: str, sql: str = "CAST(NULL AS STRING)") -> str:
        return _named({"rule": literal(rule), "column_name": column, "check_name": check, "condition": sql, "violation_count": count})

    text = "CAST(NULL AS STRING)"
    per_column = [found("notNull", "c.column_name", text, "c.null_count"),
                  found("range", "c.column_name", text, "c.below_min + c.above_max")]
    measured = profiles.selectExpr("batch", f"""inline(concat(
        flatten(transform(columns, c -> array({', '.join(per_column)}))),
        array({found('rowCount', text, text, 'CAST(size(constraints) AS BIGINT)')}),
        transform(checks, k -> {found('sql', text, 'k.name', 'k.violation_count', 'k.sql')})))""")
    m, r = measured.alias("m"), rule_rows.alias("r")
    same = (
        (F.col("m.rule") == F.col("r.rule"))
        & F.col("m.column_name").eqNullSafe(F.col("r.column_name"))
        & F.col("m.condition").eqNullSafe(F.col("r.condition"))
        & (F.col("m.check_name").eqNullSafe(F.col("r.check_name")) | (F.col("m.check_name") == fv.PROFILE_CHECK[0]))
    )
    return m.join(r, same).select(
        "r.dataset", "m.batch", "r.scope", "m.column_name", "m.rule", "r.check_name", "m.violation_count",
        (F.coalesce(F.col("m.violation_count"), F.lit(1)) == 0).alias("passed"),
    )


def freshness_outcomes(df: DataFrame, contract: Contract, as_of: datetime,
                       batch: Batch = None) -> DataFrame:
    """Latest value of each declared timestamp column against the allowed age."""
    fresh = [c.name for c in contract.columns if c.data_type == "timestamp" and c.name in df.columns]
    if not fresh:
        return small_frame(
            df.sparkSession, [], "batch string, column_name string, latest timestamp, age_minutes bigint, passed boolean")
    newest = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.max(ref(c)).cast("timestamp").alias("latest")) for c in fresh])
    latest = by_batch(df, batch, [newest.alias("l")]).select("batch", F.inline("l"))
    now = moment(as_of)
    return latest.withColumns({
        "age_minutes": F.timestamp_diff("MINUTE", F.col("latest"), now),
        "passed": F.coalesce(
            F.col("latest") >= now - F.expr(f"INTERVAL {fv.FRESHNESS_HOURS} HOURS"), F.lit(False)),
    })
