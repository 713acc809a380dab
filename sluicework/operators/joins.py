"""Joins of a large side with a keyed side."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F


def lookup_join(big: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join of ``big`` with a side holding at most one row per key.

    No size is assumed: adaptive execution broadcasts the side where it measured it to be small, and
    otherwise cuts the partition of a hot key into pieces by size.
    """
    b, c = big.alias("b"), side.alias("c")
    condition = F.lit(True)
    for k in on:
        condition = condition & F.col(f"b.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
    kept = [F.col(f"b.`{n}`") for n in big.columns] + [F.col(f"c.`{n}`") for n in side.columns if n not in on]
    return b.join(c, condition, how).select(*kept)
