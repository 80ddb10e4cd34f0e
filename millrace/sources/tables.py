"""Tables in and out: fixed-schema reads, caches, submissions, prediction sets and score ledgers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; a temporary one only where unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Read with a given schema, never an inferred one; a malformed CSV row fails the read."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("mode", "FAILFAST").csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_cache(df: DataFrame, path: str, partition_by: Sequence[str] = (), file_rows: int = 1 << 20, only_own_partitions: bool = False) -> None:
    """Write Parquet, one directory per partition value.

    Rows of a value are gathered first so files stay few: into one task for every
    ``file_rows`` rows or so of the commonest value, so no value is a task of its own size.
    With ``only_own_partitions`` a cache that exists keeps the partitions of which df has
    no row; else it is replaced.
    """
    if partition_by:
        largest = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(-(-largest // file_rows)))
        df = df.withColumn("_salt", salt).repartition(*partition_by, "_salt").drop("_salt")
    mode = "dynamic" if only_own_partitions else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64, path: str | None = None) -> DataFrame:
    """Save df as a catalog table in ``buckets`` files by a hash of its keys, each sorted by keys and ``order``, and return the table.

    Joins, groupings and windows by the keys then need no exchange, between any tables
    of as many buckets. A key is in one file, so keys that hold a large share of the rows
    want further columns beside them. ``path`` keeps the files outside the warehouse.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def make_submission(keys: DataFrame, preds: DataFrame, key: Sequence[str], fill: float = 0.0) -> DataFrame:
    """The required keys in order, each with its prediction or ``fill``; written once, as the sort reads its rows twice."""
    filled = keys.join(preds.select(*key, "pred"), list(key), "left").select(*key, F.coalesce("pred", F.lit(fill)).alias("pred"))
    return stored(filled, "filled").orderBy(*key)


def write_submission(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def stack_columns(wide: DataFrame, models: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Long table (key..., model, pred) of a wide one with a column per model, in one pass over it."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models]))
    return wide.select(*key, each.alias("_m")).select(*key, "_m.model", "_m.pred")


def stack_predictions(sets: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Long table (key..., model, pred) of separately stored prediction sets; see stack_columns for columns of one table."""
    out = None
    for name, df in sets.items():
        part = df.select(*key, F.lit(name).alias("model"), F.col("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def diff_submissions(a: DataFrame, b: DataFrame, key: Sequence[str], tol: float) -> DataFrame:
    """How many keys are missing from a, extra in a, changed by more than ``tol``, or the same."""
    left, right = a.select(*key, F.col("pred").alias("_a"), F.lit(1).alias("_in_a")), b.select(*key, F.col("pred").alias("_b"), F.lit(1).alias("_in_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    same = gap.isNotNull() & (gap <= tol) | F.col("_a").isNull() & F.col("_b").isNull()
    kind = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_b").isNull(), "extra").when(same, "same").otherwise("changed")
    return left.join(right, list(key), "full").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_gap"))


def diff_by_fingerprint(a: DataFrame, b: DataFrame, key: Sequence[str], tol: float, parts: int = 4096) -> DataFrame:
    """The rows of diff_submissions for two stored submissions that are mostly alike, without shuffling what is.

    Keys fall into ``parts`` parts by hash. Each side gives, per part, how many rows it
    has and two order-free sums of row hashes; parts that agree in these are the same
    rows. Only rows of the other parts are joined. A part's numbers and the list of
    differing parts, at most ``parts`` small rows, are all that is exchanged for the
    rest. Keys must be unique on each side; a null key matches nothing.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("_part")
    cols = [*key, F.col("pred").cast("double").alias("pred")]
    sides = [df.select(*cols, part) for df in (a, b)]
    # + 0.0 makes -0.0 and 0.0 one value
    of_row = [F.xxhash64(*key, F.col("pred") + 0.0, F.lit(seed)).cast("decimal(20,0)") for seed in (1, 2)]
    full = F.lit(True)
    for k in key:
        full &= F.col(k).isNotNull()
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(of_row)], F.count("pred").alias("n_pred"), F.min(full).alias("full")]
    prints = [df.groupBy("_part").agg(*sums) for df in sides]
    agreed = prints[0].join(prints[1], ["_part", "n", "h0", "h1", "n_pred", "full"]).where("full")
    agreed = stored(agreed.select("_part", "n", "n_pred"), "agreed")
    rest = [df.join(F.broadcast(agreed.select("_part")), "_part", "left_anti").select(*key, "pred") for df in sides]
    alike = agreed.agg(F.sum("n").alias("n"), F.max(F.when(F.col("n_pred") > 0, 0.0)).alias("max_gap")).where("n > 0").select(F.lit("same").alias("kind"), "n", "max_gap")
    return diff_submissions(*rest, key, tol).unionByName(alike).groupBy("kind").agg(F.sum("n").alias("n"), F.max("max_gap").alias("max_gap"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df in ranges of about equal size by ``order``, numbered upwards in _part; stored, as Spark samples the rows for the ranges' bounds."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def with_part(df: DataFrame, of_parts: DataFrame, group: str) -> DataFrame:
    """df with the columns of of_parts (_group, __part, ...), which has one row for each range of a group."""
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("__part"))
    return df.join(of_parts, same).drop("_group", "__part", "_part")


def score_ledger(df: DataFrame, group: str, order: Sequence[str], score: str, higher_is_better: bool) -> DataFrame:
    """Best so far, gain on the best before, and gain on the first entry.

    A group's entries are windowed range by range; each range takes over the best of the
    ranges before it. Null scores count for nothing but stay, as does a null group; a
    group whose first entry has no score has null gains on it.
    """
    sign, of, pick = (1, F.max, F.greatest) if higher_is_better else (-1, F.min, F.least)
    parts = ranged(df, F.col(group), *map(F.col, order))
    ends = parts.groupBy(group, "_part").agg(of(score).alias("best"), F.min_by(F.struct(score), F.struct(*order)).alias("first"))
    across = Window.partitionBy(group).orderBy("_part")
    carried = ends.select(F.col(group).alias("_group"), F.col("_part").alias("__part"), of("best").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"), F.first("first").over(across).alias("_first"))
    by = Window.partitionBy(group, "_part").orderBy(*order)
    own = parts.withColumn("_best", of(score).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", of(score).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    best, before = pick("_best", "_carry"), pick("_before", "_carry")
    first = F.col("_first").getField(score)
    return with_part(own, carried, group).select(*df.columns, best.alias("best"), (sign * (F.col(score) - before)).alias("gain_on_best"), (sign * (F.col(score) - first)).alias("gain_on_first"))


def leaderboard(df: DataFrame, competition: str, entrant: str, score: str, higher_is_better: bool) -> DataFrame:
    """Each entrant's best score, its rank in the competition and the share of entrants ranked no better.

    Ranks are sums over the distinct scores, windowed range by range, so neither a large
    competition nor a score that many share is one task. Entrants without any score
    share the last rank if higher is better, else the first.
    """
    best = stored(df.groupBy(competition, entrant).agg((F.max if higher_is_better else F.min)(score).alias("best")), "best")
    order = F.desc("best") if higher_is_better else F.asc("best")
    parts = ranged(best.groupBy(competition, "best").agg(F.count(F.lit(1)).alias("_n")), F.col(competition), order)
    all_before = Window.unboundedPreceding, -1
    of_competition = Window.partitionBy(competition)
    sums = parts.groupBy(competition, "_part").agg(F.sum("_n").alias("n"))
    carried = sums.select(F.col(competition).alias("_group"), F.col("_part").alias("__part"), F.sum("n").over(of_competition.orderBy("_part").rowsBetween(*all_before)).alias("_carry"), F.sum("n").over(of_competition).alias("_all"))
    own = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy(competition, "_part").orderBy(order).rowsBetween(*all_before)))
    rank = 1 + F.coalesce("_before", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    ranks = with_part(own, carried, competition).select(F.col(competition).alias("_group"), F.col("best").alias("_best"), rank.cast("long").alias("rank"), "_all")
    placed = best.join(ranks, F.col(competition).eqNullSafe(F.col("_group")) & F.col("best").eqNullSafe(F.col("_best")))
    return placed.select(competition, entrant, "best", "rank", F.try_divide(100.0 * F.col("rank"), F.col("_all")).alias("top_percent"))
