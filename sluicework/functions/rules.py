"""Contract rules as SQL conditions that mark an offending value.

Conditions are text rather than Column objects: a wide contract gives hundreds of
expressions, and each is then one call into the JVM.
"""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from sluicework.contracts import ColumnSpec
from sluicework.fixed_values import NUMERIC_DECLARED
from sluicework.functions.types import is_numeric


def quoted(name: str) -> str:
    """A column name as SQL, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """A top-level column by its exact name."""
    return F.col(quoted(name))


def literal(value: Any) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"DOUBLE('{value!r}')"
    if isinstance(value, int):
        return f"{value}L"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_number(value: str, kind: T.DataType) -> str:
    cast = "TRY_CAST" if isinstance(kind, T.StringType) else "CAST"
    return f"{cast}({value} AS DOUBLE)"


def has_range(spec: ColumnSpec, kind: T.DataType) -> bool:
    """Range statistics apply to columns declared or stored as numbers."""
    return is_numeric(kind) or isinstance(kind, T.BooleanType) or (
        spec.declared in NUMERIC_DECLARED and isinstance(kind, T.StringType)
    )


def below_min(spec: ColumnSpec, value: str, kind: T.DataType) -> str | None:
    if spec.min_value is None or not has_range(spec, kind):
        return None
    return f"{as_number(value, kind)} < {literal(float(spec.min_value))}"


def above_max(spec: ColumnSpec, value: str, kind: T.DataType) -> str | None:
    if spec.max_value is None or not has_range(spec, kind):
        return None
    return f"{as_number(value, kind)} > {literal(float(spec.max_value))}"


def breaks_pattern(spec: ColumnSpec, value: str, kind: T.DataType) -> str | None:
    """Anchored at the start only; character classes follow Unicode."""
    if not spec.pattern or not isinstance(kind, T.StringType):
        return None
    return f"NOT ({value} RLIKE {literal(f'(?U)^(?:{spec.pattern})')})"


def not_allowed(spec: ColumnSpec, value: str, kind: T.DataType) -> str | None:
    if not spec.allowed_values:
        return None
    textual = isinstance(kind, T.StringType)
    comparable = [literal(v) for v in spec.allowed_values if isinstance(v, str) == textual]
    if not comparable:
        return f"{value} IS NOT NULL"
    return f"{value} NOT IN ({', '.join(comparable)})"


def moment(at: datetime | Column) -> Column:
    """A point in time; one without a zone is meant in the session's zone, like SQL literals are."""
    return at if isinstance(at, Column) else F.lit(at.isoformat(sep=" ")).cast("timestamp")


#: Clock functions of a condition; texts and quoted names are matched first, so that they stay as they are.
_CLOCKS = re.compile(
    r"""(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|(?P<day>\bcurrent_date\b(?:\s*\(\s*\))?)"""
    r"|\bnow\s*\(\s*\)|\bcurrent_timestamp\b(?:\s*\(\s*\))?", re.I)


def at_time(condition: str, as_of: datetime | None) -> str:
    """Pin the clock functions of a SQL condition, so that a rerun gives the same answer."""
    if as_of is None:
        return condition
    stamp = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")

    def pin(m: re.Match) -> str:
        if m["text"]:
            return m["text"]
        return f"DATE '{stamp[:10]}'" if m["day"] else f"TIMESTAMP '{stamp}'"

    return _CLOCKS.sub(pin, condition)
