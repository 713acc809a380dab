"""Names of Spark types in the declared vocabulary, and which declarations accept them."""

from __future__ import annotations

from pyspark.sql import types as T

from sluicework.fixed_values import TYPE_FAMILIES

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL = (T.FloatType, T.DoubleType)


def families(kind: T.DataType) -> list[str]:
    """Type families an observed Spark type belongs to, the name shown in reports first."""
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return ["integer"]
    if isinstance(kind, T.DecimalType):
        return ["decimal", "hugeint"] if (kind.precision, kind.scale) == (38, 0) else ["decimal"]
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return ["varchar", "time", "json"]  # Spark has no type of its own for the other two
    names = {
        T.ByteType: "tinyint", T.ShortType: "smallint", T.FloatType: "float", T.DoubleType: "double",
        T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamp",
        T.TimestampNTZType: "timestamp", T.DayTimeIntervalType: "interval",
        T.YearMonthIntervalType: "interval", T.BinaryType: "blob", T.VariantType: "json",
        T.ArrayType: "list", T.StructType: "struct",
    }
    return [names.get(type(kind), kind.typeName())]


def shown(kind: T.DataType) -> str:
    """The name of an observed type in reports."""
    return "bigint" if isinstance(kind, T.LongType) else families(kind)[0]


def accepted(kind: T.DataType) -> list[str]:
    """Every declared type name that matches an observed Spark type."""
    return sorted({d for f in families(kind) for d in TYPE_FAMILIES.get(f, [f])})


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)
