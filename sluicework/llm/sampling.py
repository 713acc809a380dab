"""Bounded samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def bounded(rows: DataFrame, label: str, key: str, most: int | dict) -> DataFrame:
    """At most `most` rows (one bound, or one for each value) for each value of `label`: those with the least hash of the key.

    One narrow count gives each label's size; rows beyond three times the bound are left out in the
    scan by their hash, so that the ranking sees few rows however large the table is.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30))
    limits = most if isinstance(most, dict) else dict.fromkeys(sizes, most)
    likely = F.lit(False)
    for value, n in sizes.items():
        likely = likely | ((F.col(label) == F.lit(value)) & (place < int((1 << 30) * min(1.0, 3 * limits[value] / n))))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(place, key))
    limit = F.lit(0)
    for value, k in limits.items():
        limit = F.when(F.col(label) == F.lit(value), k).otherwise(limit)
    return rows.where(likely).withColumn("_rank", rank).where(
        (F.col("_rank") <= max(limits.values(), default=0)) & (F.col("_rank") <= limit)).drop("_rank")


def learns(key: str, folds: int, held: int):
    """Whether a row is not in the held-out fold: crc32 of the key as text, modulo `folds`, is not `held`."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds != held, F.lit(False))
