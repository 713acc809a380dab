"""Data contracts: the declared columns and rules of a dataset.

A contract is configuration and lives on the driver; ``rule_table`` and
``declared_columns`` turn many contracts into frames for joins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from sluicework import fixed_values as fv
from sluicework.session import small_frame

try:
    import yaml
except ImportError:  # JSON contracts still load
    yaml = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: str = "varchar"
    nullable: bool = True
    primary_key: bool = False
    min_value: float | None = None
    max_value: float | None = None
    pattern: str | None = None
    allowed_values: tuple = ()
    description: str | None = None

    @property
    def declared(self) -> str:
        return self.data_type.lower().split("(")[0].strip()


@dataclass(frozen=True)
class Check:
    name: str
    condition: str
    severity: str = "warning"
    error: str | None = None  # set when the condition is known to fail at run time
    rule_name: str | None = None  # in the rule table, whose defaults are its own
    rule_severity: str | None = None


@dataclass(frozen=True)
class Contract:
    dataset: str
    columns: tuple[ColumnSpec, ...] = ()
    min_rows: int | None = None
    max_rows: int | None = None
    checks: tuple[Check, ...] = ()
    thresholds: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)
    path: str = ""
    error: str | None = None

    @property
    def primary_key(self) -> str | None:
        return next((c.name for c in self.columns if c.primary_key), None)

    @property
    def z_warning(self) -> float:
        return float(self.thresholds.get("z_score_warning", fv.Z_SCORE_WARNING))

    @property
    def z_critical(self) -> float:
        return float(self.thresholds.get("z_score_critical", fv.Z_SCORE_CRITICAL))

    @property
    def quality_warn(self) -> float:
        return float(self.thresholds.get("quality_score_warn", fv.QUALITY_SCORE_WARN))

    @property
    def quality_block(self) -> float:
        return float(self.thresholds.get("quality_score_block", fv.QUALITY_SCORE_BLOCK))

    @classmethod
    def from_dict(cls, raw: dict[str, Any], dataset: str, path: str = "") -> "Contract":
        quality = raw.get("quality") or {}
        columns = tuple(
            ColumnSpec(
                name=str(c.get("name", "?")),
                data_type=str(c.get("data_type", "varchar")),
                nullable=c.get("nullable", True) is not False,
                primary_key=c.get("isPrimaryKey") is True,
                min_value=c.get("min_value"),
                max_value=c.get("max_value"),
                pattern=c.get("pattern"),
                allowed_values=tuple(c.get("allowed_values") or ()),
                description=c.get("description"),
            )
            for c in raw.get("columns") or []
        )
        checks = tuple(
            Check(c.get("name", fv.PROFILE_CHECK[0]), c.get("sql_condition") or "", c.get("severity", fv.PROFILE_CHECK[1]),
                  rule_name=c.get("name", fv.RULE_CHECK[0]), rule_severity=c.get("severity", fv.RULE_CHECK[1]))
            for c in quality.get("custom_checks") or []
        )
        return cls(
            dataset=dataset,
            columns=columns,
            min_rows=quality.get("min_rows"),
            max_rows=quality.get("max_rows"),
            checks=checks,
            thresholds=dict(quality.get("anomaly_thresholds") or {}),
            info=dict(raw.get("info") or {}),
            path=path,
        )


def _parse(text: str, suffix: str) -> Any:
    if suffix == ".json":
        return json.loads(text)
    if yaml is None:
        raise RuntimeError("YAML contracts need PyYAML; use JSON")
    return yaml.safe_load(text)


def read_config(path: str | Path) -> dict[str, Any]:
    """A YAML or JSON configuration file as a dict; an absent file counts as empty."""
    path = Path(path)
    if not path.exists():
        return {}
    return _parse(path.read_text(), path.suffix) or {}


def load_contract(path: str | Path, dataset: str | None = None) -> Contract:
    """Read one contract. A missing or broken file gives a contract carrying ``error``."""
    path = Path(path)
    dataset = dataset or path.stem
    try:
        raw = _parse(path.read_text(), path.suffix) or {}
        if not isinstance(raw, dict):
            raise ValueError("contract is not a mapping")
        return Contract.from_dict(raw, dataset, str(path))
    except Exception as exc:
        return Contract(dataset=dataset, path=str(path), error=str(exc))


def discover(folder: str | Path) -> list[Contract]:
    """All contracts of a folder in name order, backups left out."""
    files = [p for p in sorted(Path(folder).iterdir()) if p.suffix in (".yaml", ".yml", ".json")]
    return [load_contract(p) for p in files if ".backup_" not in p.name]


def declared_columns(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    """One row per declared column of every contract."""
    rows = [
        (k.dataset, position, c.name, c.declared, c.nullable, c.primary_key)
        for k in contracts
        for position, c in enumerate(k.columns)
    ]
    return small_frame(
        spark, rows,
        "dataset string, position int, column_name string, declared_type string, "
        "nullable boolean, primary_key boolean",
    )


def threshold_table(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    """Thresholds of every contract, one row per dataset."""
    rows = [(k.dataset, k.z_warning, k.z_critical, k.quality_warn, k.quality_block) for k in contracts]
    return small_frame(
        spark, rows, "dataset string, z_warning double, z_critical double, quality_warn double, quality_block double"
    )


RULE_SCHEMA = (
    "dataset string, scope string, column_name string, rule string, low double, high double, "
    "max_age_hours int, check_name string, condition string, severity string"
)


def _bounds(low: Any, high: Any) -> dict:
    """A range whose missing ends are open."""
    return {"low": float("-inf") if low is None else float(low), "high": float("inf") if high is None else float(high)}


#: Each kind of rule: its scope, and the rules of that kind that a contract implies.
RULE_KINDS: dict[str, tuple[str, Callable[[Contract], Iterable[dict]]]] = {
    "rowCount": ("dataset", lambda k: [_bounds(k.min_rows, k.max_rows)] if k.min_rows is not None else []),
    "notNull": ("column", lambda k: [{"column_name": c.name} for c in k.columns if not c.nullable]),
    "range": ("column", lambda k: [{"column_name": c.name, **_bounds(c.min_value, c.max_value)}
                                   for c in k.columns if (c.min_value, c.max_value) != (None, None)]),
    "freshness": ("column", lambda k: [{"column_name": c.name, "max_age_hours": fv.FRESHNESS_HOURS}
                                       for c in k.columns if c.data_type == "timestamp"]),
    "sql": ("dataset", lambda k: [{"check_name": c.rule_name or c.name, "condition": c.condition, "severity": c.rule_severity or c.severity}
                                  for c in k.checks]),
}


def rule_rows(contract: Contract) -> list[tuple]:
    """The typed rules a contract implies, kind by kind, in the layout of the rule table."""
    names = [f.split()[0] for f in RULE_SCHEMA.split(", ")]
    found = ({"dataset": contract.dataset, "scope": scope, "rule": kind, **rule}
             for kind, (scope, rules_of) in RULE_KINDS.items() for rule in rules_of(contract))
    return [tuple(rule.get(n) for n in names) for rule in found]


def rule_table(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    """The typed rules of many contracts, one row each."""
    return small_frame(spark, [r for k in contracts for r in rule_rows(k)], RULE_SCHEMA)
