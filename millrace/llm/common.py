"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that hold at least this share of a table's rows are joined by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 512


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only where no such folder is set and the master is local (tests) a temporary one is
    made and set; on a cluster a missing folder is an error, as executors would not see
    each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts lineage so that losing an executor later never recomputes what stands
    above, and, unlike checkpoint(), it runs the plan only once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner learns of them only when the driver collects garbage, which a driver with
    little to do may put off until the executors' disks are full of finished shuffles.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def same_keys(keys: Sequence[str], prefix: str = "_") -> Column:
    """Null-safe equality of each key with the column of that name after ``prefix``."""
    found = F.lit(True)
    for k in keys:
        found &= F.col(k).eqNullSafe(F.col(prefix + k))
    return found


def join_common(rows: DataFrame, table: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, which has one row per key and in column ``n`` how many of ``rows`` have the key.

    Keys with HOT_SHARE of all rows or more (so at most 1 / HOT_SHARE of them, whatever
    the size) are joined by broadcast where their rows lie; the rest by an ordinary
    join, in which no key is large. ``how`` is inner or left. Null keys have no partner.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    least = max(1024, math.ceil(total * HOT_SHARE))
    often = table.where(F.col(n) >= least)
    if often.isEmpty():
        return rows.join(table, key, how)
    keys = F.broadcast(often.select(key))
    large = rows.join(keys, key, "left_semi").join(F.broadcast(often), key)
    small = rows.join(keys, key, "left_anti").join(table.where(F.col(n) < least), key, how)
    return small.union(large.select(small.columns))


def salted_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, part_rows: int = 1 << 16) -> DataFrame:
    """Add column ``name``: a 0-based rank of each row within its ``by`` group, without one task per group.

    Rows of a group are dealt by a hash of ``order`` into as many parts as give the
    largest group about ``part_rows`` rows a part; each part is numbered by itself and
    shifted by the number of rows in the parts before it. Ranks are gapless and depend
    only on the rows' values; rows alike in ``by`` and ``order`` are interchangeable.
    """
    keys = list(by)
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 1
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(-(-largest // part_rows))))
    parts = dealt.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_salt").alias("__salt"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = dealt.withColumn("_rank", F.row_number().over(own) - 1)
    return numbered.join(shift, same_keys([*keys, "_salt"])).select(*df.columns, (F.col("_rank") + F.col("_shift")).cast("long").alias(name))


def split_groups(df: DataFrame, key: str, most: int, within: Column) -> DataFrame:
    """Add column ``split``, 0 but for values of ``key`` with over ``most`` rows: their rows are dealt by a hash ``within`` into parts of about ``most``.

    Grouping by (key, split) then keeps every group small.
    """
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(F.col(key).alias("_key"), F.ceil(F.col("_n") / most).alias("_parts"))
    return df.join(large, df[key] == large["_key"], "left").withColumn("split", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(within, F.col("_parts"))).cast("int")).drop("_key", "_parts")


def quantile_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 rising values of the long column ``key`` that cut its rows into near-equal ranges."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"]
    return sorted(set(found or []))


def bucket_of(key: str, bounds: list[int]):
    """Column expression: how many of the rising ``bounds`` lie below ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    padded = F.lit(bounds + [(1 << 63) - 1] * ((1 << steps) - 1 - len(bounds))).cast("array<long>")
    powers = F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)])
    return F.aggregate(powers, F.lit(0), lambda lo, p: lo + F.when(F.element_at(padded, lo + p) < F.col(key), p).otherwise(0))
