"""Long series without long tasks: positions by sorted ranges, and blocks of a series with the rows around them as guests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ranged, with_part

#: Rows of a series that are windowed together; longer series are cut into blocks of so many.
BLOCK_ROWS = 1 << 20


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add column ``out``: each row's 0-based place within its keys by ``order``, without a task per key.

    Rows are sorted into ranges; each range numbers its own rows of a key and takes over
    how many the ranges before it have. Rows alike in keys and order get consecutive
    places in no set order.
    """
    parts = ranged(df, *map(F.col, [*keys, *order]))
    key = F.struct(*keys) if keys else F.lit(0)
    parts = parts.withColumn("_key", key)
    across = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    carried = counts.select(F.col("_key").alias("_group"), F.col("_part").alias("__part"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    own = parts.withColumn("_own", F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order)))
    return with_part(own, carried, "_key").select(*df.columns, (F.col("_before") + F.col("_own") - 1).cast("long").alias(out))


def longest_series(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """df with columns _block and _guest, to be windowed by (keys, _block) and then freed of its guests.

    A series of at most ``rows`` rows is one block. Are there longer ones, series are cut
    into blocks of ``rows``, and each block also gets, as guests, the ``before`` rows in
    front of it and the ``after`` rows behind it: so frames of that reach find all their
    rows, and one series may spread over any number of tasks.
    """
    rows = max(rows, before, after, 1)
    if longest_series(df, keys) <= rows:
        return df.withColumns({"_block": F.lit(0).cast("long"), "_guest": F.lit(False)})
    at, own = F.col("_at"), F.expr(f"_at div {rows}")
    places = [F.struct(own.alias("block"), F.lit(False).alias("guest"))]
    if before:
        places.append(F.when(at % rows >= rows - before, F.struct((own + 1).alias("block"), F.lit(True).alias("guest"))))
    if after:
        places.append(F.when((at % rows < after) & (own > 0), F.struct((own - 1).alias("block"), F.lit(True).alias("guest"))))
    spread = positions(df, keys, order, "_at").withColumn("_place", F.explode(F.array_compact(F.array(*places))))
    return spread.withColumns({"_block": F.col("_place.block"), "_guest": F.col("_place.guest")}).drop("_place", "_at")
