"""Demand-series operators: dense calendars and means over the days that sold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import BLOCK_ROWS, in_blocks


#: Rows of a dense table that one partition holds, about.
PART_ROWS = 1 << 19


def dense_parts(seen: DataFrame, keys: Sequence[str], day: str, rows: int = PART_ROWS) -> tuple[int | None, int | None, int]:
    """The first and last day of a table as day numbers, and how many partitions of some ``rows`` rows its dense form fills."""
    span = seen.agg(F.min(F.unix_date(F.to_date(day))).alias("low"), F.max(F.unix_date(F.to_date(day))).alias("high"), F.approx_count_distinct(F.xxhash64(*keys)).alias("n")).first()
    if span["low"] is None:
        return None, None, 1
    return span["low"], span["high"], -(-span["n"] * (span["high"] - span["low"] + 1) // rows)


def densify(df: DataFrame, keys: Sequence[str], day: str, value: str, fill: float = 0.0, rows: int = PART_ROWS, bounds: DataFrame | None = None) -> DataFrame:
    """Every key on every day between the first and the last day of the table; ``fill`` where there was no row.

    Each key's rows are brought together in order of day and each row makes the days up
    to the next one, so only the sparse rows travel, and groupings and windows by the
    keys find the dense ones where they lie. There are as many partitions as keep each at
    some ``rows`` dense rows. ``bounds`` may be a table with the same keys and days that
    is cheaper to read. A null key gets a calendar of fills.
    """
    if df.schema[day].dataType.simpleString() != "date":
        return _densify_by_join(df, keys, day, value, fill)
    low, high, parts = dense_parts(df if bounds is None else bounds, keys, day, rows)
    if low is None:
        return _densify_by_join(df, keys, day, value, fill)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, parts)
    full = F.lit(True)
    for k in keys:
        full &= F.col(k).isNotNull()
    # rows without a day or a full key only say that the key is there: they stand before the first day
    sparse = df.select(*keys, F.coalesce(F.when(full, F.unix_date(day)), F.lit(low - 1)).alias("_at"), F.col(value).alias("_v")).repartition(parts, *keys)
    by = Window.partitionBy(*keys).orderBy("_at")
    until = F.coalesce(F.lead("_at").over(by), F.lit(high + 1)) - 1
    begun = sparse.withColumns({"_until": until, "_from": F.when(F.row_number().over(by) == 1, F.lit(low)).otherwise(F.greatest("_at", F.lit(low)))})
    last = F.when(F.col("_at") >= low, F.greatest("_until", "_at")).otherwise(F.col("_until"))
    each = begun.select(*keys, "_at", "_v", F.explode(F.when(F.col("_from") <= last, F.sequence("_from", last))).alias("_day"))
    own = F.when(F.col("_day") == F.col("_at"), F.col("_v"))
    return each.select(*keys, F.date_from_unix_date("_day").alias(day), F.coalesce(own, F.lit(fill)).alias(value))


def _densify_by_join(df: DataFrame, keys: Sequence[str], day: str, value: str, fill: float) -> DataFrame:
    """densify for days that are no dates: the calendar of each key, joined to the rows."""
    span = df.agg(F.min(day).alias("_from"), F.max(day).alias("_to"))
    calendar = df.select(*keys).distinct().join(F.broadcast(span)).select(*keys, F.explode(F.sequence("_from", "_to", F.expr("interval 1 day"))).alias(day))
    return calendar.join(df.select(*keys, day, value), [*keys, day], "left").select(*keys, day, F.coalesce(value, F.lit(fill)).alias(value))


def nz_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of the values above zero per key (null if there are none) and how many they are."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("nz_mean"), F.count(v).alias("n_nz"))


def trailing_nz_mean(df: DataFrame, keys: Sequence[str], day: str, value: str, n: int, out: str = "trailing_nz_mean", rows: int = BLOCK_ROWS, longest: int | None = None) -> DataFrame:
    """Mean of the values above zero over the ``n`` rows before the current one; series of more than ``rows`` rows are windowed in blocks.

    ``longest``, a bound of a series' rows where one is known, saves counting them.
    """
    v = F.avg(F.when(F.col(value) > 0, F.col(value)))
    if longest is not None and longest <= max(rows, n):
        return df.withColumn(out, v.over(Window.partitionBy(*keys).orderBy(day).rowsBetween(-n, -1)))
    by = Window.partitionBy(*keys, "_block").orderBy(day).rowsBetween(-n, -1)
    found = in_blocks(df, keys, [day], n, 0, rows).withColumn(out, v.over(by))
    return found.where(~F.col("_guest")).drop("_block", "_guest")


def blend_nz_mean(df: DataFrame, group: str, p: str, nz: str, weights: DataFrame, out: str = "blend") -> DataFrame:
    """(1 - w) * p + w * nz with each group's weight w (column w of ``weights``); whichever of the two exists if one is null."""
    p_, nz_ = F.col(p), F.col(nz)
    w = F.coalesce(F.col("w"), F.lit(0.0))
    return df.join(weights.select(group, "w"), group, "left").withColumn(out, F.coalesce((1 - w) * p_ + w * nz_, p_, nz_)).drop("w")


def lagged(value: Column, days: int, keys: Sequence[str], day: str) -> Column:
    return F.lag(value, days).over(Window.partitionBy(*keys).orderBy(day))
