"""Running and trailing statistics over ordered series, split so that no task holds a whole series.

A window over one key would sort that key's rows in a single task. Here each
series is cut by time into slots: slot totals (one row per slot) are carried
forward, and ordered windows only ever run inside a slot or a block of fixed length.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluicework.functions.stats import steady_mean, steady_std
from sluicework.session import durable, fresh_folder

SLOT_SECONDS = 86400
BLOCK_ROWS = 8192
#: Rows of a series in one slot beyond which the slot is cut, and the most pieces it is cut into.
SLOT_ROWS, CUTS = 65_536, 256


def slot(order: str, seconds: int) -> Column:
    """Number of the stretch of time a row falls in."""
    return F.floor(F.unix_micros(F.col(order).cast("timestamp")) / F.lit(seconds * 1_000_000))


def slotted(df: DataFrame, keys: Sequence[str], order: str, seconds: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``_slot``: the stretch of time a row falls in, or a piece of it where a series has very many points there.

    A busy stretch is cut at measured quantiles of its times. The cuts are estimates, which may differ
    each time they are made, so they are stored; any cuts give the same statistics. Rows of one instant stay together.
    """
    rows = df.withColumn("_slot", slot(order, seconds))
    busy = rows.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slot_rows).select(*keys, "_slot")
    if busy.isEmpty():
        return rows.withColumn("_slot", F.col("_slot") * CUTS)
    at = F.unix_micros(F.col(order).cast("timestamp"))
    shares = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    cuts = rows.join(busy, [*keys, "_slot"], "left_semi").groupBy(*keys, "_slot").agg(F.approx_percentile(at, shares, 10 * CUTS).alias("_cuts"))
    stored = durable(cuts, fresh_folder(df.sparkSession))
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= at)), F.lit(0))
    placed_in = rows.join(stored, [*keys, "_slot"], "left")
    return placed_in.withColumn("_slot", F.col("_slot") * CUTS + F.when(F.col("_cuts").isNull(), 0).otherwise(piece)).drop("_cuts")


def _carried(totals: DataFrame, keys: Sequence[str], season: str) -> DataFrame:
    """Per slot: rows of the series before it, and count, sums and range of its season before it.

    Sums are of distances from a centre of the season, which keeps the variance
    accurate for large values.
    """
    same = Window.partitionBy(*keys, season)
    earlier = same.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_slot").rangeBetween(Window.unboundedPreceding, -1)
    centred = totals.withColumns({
        "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
        "_c": F.try_divide(F.sum(F.col("_n") * F.col("_m")).over(same), F.sum("_n").over(same)),
    }).withColumns({"_s": F.expr("_n * (_m - _c)"), "_q": F.expr("_n * (_v + (_m - _c) * (_m - _c))")})
    return centred.select(
        *keys, season, "_slot", "_c", "_before",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_q").over(earlier), F.lit(0.0)).alias("_q0"),
        F.min("_lo").over(earlier).alias("_lo0"),
        F.max("_hi").over(earlier).alias("_hi0"),
    )


def placed(df: DataFrame, keys: Sequence[str], season: str, order: Sequence[str], value: str,
           slot_seconds: int = SLOT_SECONDS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add each row's ``_position`` in its series and ``seasonal_n, seasonal_mean, seasonal_std`` of its
    season's earlier rows.

    ``order[0]`` is the timestamp, the rest break ties; keys, season and value must not be null.
    Rows are shuffled twice by (series, slot), never by series alone.
    """
    keys = list(keys)
    rows = slotted(df, keys, order[0], slot_seconds, slot_rows).select(*df.columns, "_slot")
    totals = rows.groupBy(*keys, season, "_slot").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_n"), F.avg(value).alias("_m"),
        F.var_pop(value).alias("_v"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order)
    ranked = rows.withColumn("_in_slot", F.row_number().over(inside))
    joined = ranked.join(_carried(totals, keys, season), [*keys, season, "_slot"])
    earlier = Window.partitionBy(*keys, season, "_slot").orderBy("_in_slot").rowsBetween(Window.unboundedPreceding, -1)
    d = F.col(value) - F.col("_c")
    summed = joined.withColumns({
        "_position": F.col("_before") + F.col("_in_slot"),
        "_n1": F.col("_n0") + F.count(value).over(earlier),
        "_s1": F.col("_s0") + F.coalesce(F.sum(d).over(earlier), F.lit(0.0)),
        "_q1": F.col("_q0") + F.coalesce(F.sum(d * d).over(earlier), F.lit(0.0)),
        "_lo1": F.least(F.col("_lo0"), F.min(value).over(earlier)),
        "_hi1": F.greatest(F.col("_hi0"), F.max(value).over(earlier)),
    })
    std = "sqrt(try_divide(greatest(0D, _q1 - try_divide(_s1 * _s1, _n1)), _n1 - 1))"
    return summed.selectExpr(
        *df.columns, "_position", "_n1 AS seasonal_n",
        f"{steady_mean('_c + try_divide(_s1, _n1)', '_lo1', '_hi1')} AS seasonal_mean",
        f"CASE WHEN _n1 > 0 THEN {steady_std(std, '_lo1', '_hi1')} END AS seasonal_std",
    )


def trailing(placed_rows: DataFrame, keys: Sequence[str], value: str, size: int,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Replace ``_position`` by ``global_n, global_mean, global_std`` of the ``size`` rows just before each row.

    Positions are cut into blocks of fixed length; the last ``size`` rows of a block
    are handed to the next one as context, so every frame is complete inside its block.
    """
    if block_rows < size:
        raise ValueError("a block must hold a whole frame")
    home = f"(_position - 1) DIV {block_rows}"
    lends = f"(_position - 1) % {block_rows} >= {block_rows - size}"
    copies = placed_rows.withColumns({
        "_home": F.expr(home),
        "_block": F.expr(f"explode(CASE WHEN {lends} THEN array({home}, {home} + 1) ELSE array({home}) END)"),
    })
    block = Window.partitionBy(*keys, "_block").orderBy("_position")
    frame = block.rowsBetween(-size, -1)
    framed = copies.withColumns({
        "_mean": F.avg(value).over(frame), "_std": F.stddev_samp(value).over(frame), "_last": F.lag(value).over(block),
    }).where("_block = _home")
    kept = [c for c in placed_rows.columns if c != "_position"]
    # The running deviation is exactly zero only for equal values, whose mean is then any one of them.
    return framed.selectExpr(
        *kept, f"least(_position - 1, {size}L) AS global_n",
        "CASE WHEN _std = 0 THEN _last ELSE _mean END AS global_mean",
        "CASE WHEN _position > 1 THEN COALESCE(_std, 0D) END AS global_std",
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str = "_rank") -> DataFrame:
    """The last ``n`` rows per key. Each task drops all but its own last ``n`` before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank, F.row_number().over(newest)).where(F.col(rank) <= n)
