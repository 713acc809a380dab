"""Distinct counts that can be merged: a sketch for each batch is kept, and longer spans are unions of sketches."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluicework.functions.rules import ref
from sluicework.operators.profile import Batch, by_batch

#: Base-two logarithm of the buckets of a sketch: 2 ** 12 of them give a standard error of 1.04 / 64, or 1.6 %.
BUCKETS = 12
#: Five standard errors: an estimate farther off than this share of the exact count is not to be expected.
ERROR_BOUND = 5 * 1.04 / 2 ** (BUCKETS / 2)


def _countable(df: DataFrame, column: str) -> Column:
    """Sketches take integers, texts and bytes; other values count by their text."""
    kind = df.schema[column].dataType
    return ref(column) if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else ref(column).cast("string")


def distinct_sketches(df: DataFrame, columns: Sequence[str], batch: Batch = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per batch and column with a sketch of its non-null values, from one scan.

    Tasks shuffle one sketch of a few kilobytes for each batch and column, never values.
    """
    made = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.count(ref(c)).alias("filled"), F.hll_sketch_agg(_countable(df, c), buckets).alias("sketch")) for c in columns])
    return by_batch(df, batch, [made.alias("s")]).select("batch", F.inline("s"))


def merged(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """Sketches of longer spans: their estimate and the number of values, without reading a value again."""
    return sketches.groupBy(*keys, "column_name").agg(
        F.sum("filled").alias("filled"), F.hll_union_agg("sketch").alias("sketch")).withColumn(
        "unique_estimate", F.hll_sketch_estimate("sketch"))
