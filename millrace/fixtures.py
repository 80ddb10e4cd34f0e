"""Logical tables of the forecasting queries, derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.demand import dense_parts, densify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of 21 positions: traj_id, label, t, x, y, z."""
    at = lambda k: F.element_at("embedding", (3 * F.col("t") + k).cast("int")).cast("double")
    steps = table(spark, sf_dir, "embeddings").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))))
    return steps.select(F.col("vec_id").alias("traj_id"), "label", "t", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("store"), F.to_date("l_shipdate").alias("day"), "l_quantity")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per store and day of sale."""
    return sales(spark, sf_dir).groupBy("store", "day").agg(F.sum("l_quantity").alias("qty"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily for every store and day, 0 where nothing was sold."""
    return densify(daily(spark, sf_dir), ["store"], "day", "qty", bounds=sales(spark, sf_dir))


def demand_days(spark: SparkSession, sf_dir: str) -> int:
    """How many days demand's calendar has: the rows of each store."""
    return (sales(spark, sf_dir).agg(F.datediff(F.max("day"), F.min("day"))).first()[0] or 0) + 1


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four simple forecasts of demand beside the actual y, where all four exist."""
    by = Window.partitionBy("store").orderBy("day")
    v = F.col("qty")
    out = demand(spark, sf_dir).select(
        "store",
        "day",
        v.alias("y"),
        F.lag(v, 1).over(by).alias("p_lag1"),
        F.lag(v, 7).over(by).alias("p_lag7"),
        F.avg(F.when(v > 0, v)).over(by.rowsBetween(-28, -1)).alias("p_nz28"),
        F.avg(v).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("p_mean"),
    )
    return out.dropna()


MODELS = ["p_lag1", "p_lag7", "p_nz28", "p_mean"]


#: Dense days of which arrays are made at once, so that they stay in a core's cache.
CELLS = 1 << 14


def ungrouped_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of preds for work that needs no store's rows together, many times cheaper than windows over dense rows.

    The sparse rows of each store are sorted where densify brings them; a store's dense days
    and forecasts are arrays of the calendar's length within a task. Sums run in order of
    day as in the windows, so results are the same to the last bit.
    """
    rows = daily(spark, sf_dir)
    low, high, parts = dense_parts(sales(spark, sf_dir), ["store"], "day")
    if low is None:
        return preds(spark, sf_dir)
    days = high - low + 1
    at = F.when(F.col("store").isNotNull(), F.unix_date("day"))
    dealt = rows.select("store", at.alias("at"), "qty").repartition(max(spark.sparkContext.defaultParallelism, parts), "store").sortWithinPartitions("store")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # the last store of a batch may go on in the next
            last = batch.column(0).slice(batch.num_rows - 1).to_pylist()[0] if batch.num_rows else None
            first = batch.column(0).slice(0, 1).to_pylist()[0] if batch.num_rows else None
            held.append(batch)
            if first != last:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.flatnonzero(_runs(table.column(0)))[-1])
                yield from forecasts(table.slice(0, cut), low, days)
                held = table.slice(cut).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from forecasts(pa.Table.from_batches(held), low, days)

    return dealt.mapInArrow(run, "store long, day date, y double, " + ", ".join(f"{m} double" for m in MODELS))


def _runs(stores: pa.ChunkedArray) -> np.ndarray:
    """Where a store differs from the one before it; nulls count as one store."""
    none, value = stores.is_null().to_numpy(), stores.fill_null(0).to_numpy()
    return np.concatenate([[True], (value[1:] != value[:-1]) | (none[1:] != none[:-1])])


def forecasts(sparse: pa.Table, low: int, days: int) -> Iterator[pa.RecordBatch]:
    """The rows of preds of whole stores, given their sparse rows (store, at, qty) store by store; CELLS dense ones or so at once."""
    new = _runs(sparse.column(0))
    nth, first = np.cumsum(new) - 1, np.flatnonzero(new)
    at, qty = sparse.column(1).fill_null(low - 1).to_numpy() - low, sparse.column(2).cast(pa.float64())
    some = (at >= 0) & qty.is_valid().to_numpy()
    qty = qty.fill_null(0.0).to_numpy()
    step = max(1, CELLS // days)
    for lo in range(0, len(first), step):
        stores = sparse.column(0).take(pa.array(first[lo : lo + step])).combine_chunks()
        own = some & (nth >= lo) & (nth < lo + step)
        v = np.zeros((len(stores), days))
        v[nth[own] - lo, at[own]] = qty[own]
        sold = (v > 0) | np.isnan(v)
        counts = np.zeros((len(stores), days + 28))
        np.cumsum(sold[:, :-1], axis=1, out=counts[:, 29:])
        n, amounts, total = counts[:, 28:] - counts[:, :days], np.where(sold, v, 0.0), np.zeros_like(v)
        with np.errstate(invalid="ignore", divide="ignore"):
            for back in range(min(28, days - 1), 0, -1):
                total[:, back:] += amounts[:, :-back]
            sums = np.cumsum(v, axis=1)
            week = max(0, days - 7)
            of = [v[:, 7:], v[:, 6 : 6 + week], v[:, :week], total[:, 7:] / n[:, 7:], sums[:, 6 : 6 + week] / np.arange(7, 7 + week)]
        # a week must have passed and the last 28 days have a sale; as in preds, rows with a NaN go
        there = (n[:, 7:] > 0) & ~np.any([np.isnan(c) for c in of], axis=0)
        row, day = np.nonzero(there)
        yield pa.RecordBatch.from_arrays([stores.take(pa.array(row)).cast(pa.int64()), pa.array((day + 7 + low).astype(np.int32)).cast(pa.date32()), *[pa.array(c[there]) for c in of]], ["store", "day", "y", *MODELS])


def delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipment, 0 at least."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.greatest(F.datediff("l_shipdate", "o_orderdate"), F.lit(0)).cast("double")
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate", days.alias("delay"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("cell"), F.expr("n_nationkey div 5").cast("double").alias("gy"), (n % 5).cast("double").alias("gx"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), (k * 37 % 400 / 100.0).alias("sy"), (k * 53 % 400 / 100.0).alias("sx"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattered stations, a reading of one segment each: cell, gy, gx, seg, u."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("cell"), (k * 7919 % 10007 / 100.0).alias("gy"), (k * 104729 % 10009 / 100.0).alias("gx"), F.col("c_mktsegment").alias("seg"), (F.col("c_acctbal") / 7).alias("u"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites among the stations."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), (k * 3571 % 10007 / 100.0).alias("sy"), (k * 2731 % 10009 / 100.0).alias("sx"))


def wxfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources' wind per cell and day: src, cell, valid_day, u, v."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    src = F.when(F.col("event_type") == "view", "A").otherwise("B")
    out = e.groupBy(src.alias("src"), (F.col("user_id") % 25).cast("int").alias("cell"), F.to_date("ts").alias("valid_day"))
    return out.agg(F.avg(F.col("value") / 50).alias("u"), F.avg(F.col("event_id") % 20 / 2 - 5).alias("v"))


def gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power per site and day, the site's capacity and the day before's power as forecast."""
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("site"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("power"))
    by = Window.partitionBy("site")
    return d.withColumn("capacity", F.max("power").over(by)).withColumn("forecast", F.lag("power").over(by.orderBy("day")))


#: The same tables in DuckDB SQL; later ones may use earlier ones.
SQL = {
    "traj": """SELECT vec_id AS traj_id, label, CAST(i AS BIGINT) AS t, CAST(embedding[3*i+1] AS DOUBLE) AS x,
        CAST(embedding[3*i+2] AS DOUBLE) AS y, CAST(embedding[3*i+3] AS DOUBLE) AS z FROM embeddings, range(0, 21) r(i)""",
    "daily": "SELECT l_suppkey AS store, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2",
    "demand": """SELECT s.store, c.day, coalesce(d.qty, 0.0) AS qty FROM (SELECT DISTINCT store FROM daily) s
        CROSS JOIN (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily) c
        LEFT JOIN daily d ON d.store = s.store AND d.day = c.day""",
    "preds": """SELECT * FROM (SELECT store, day, qty AS y, lag(qty, 1) OVER w AS p_lag1, lag(qty, 7) OVER w AS p_lag7,
        avg(CASE WHEN qty > 0 THEN qty END) OVER (PARTITION BY store ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS p_nz28,
        avg(qty) OVER (PARTITION BY store ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_mean
        FROM demand WINDOW w AS (PARTITION BY store ORDER BY day))
        WHERE p_lag1 IS NOT NULL AND p_lag7 IS NOT NULL AND p_nz28 IS NOT NULL AND p_mean IS NOT NULL""",
    "delay": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate,
        CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0) AS DOUBLE) AS delay
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "grid": "SELECT n_nationkey AS cell, CAST(n_nationkey // 5 AS DOUBLE) AS gy, CAST(n_nationkey % 5 AS DOUBLE) AS gx FROM nation",
    "sites": "SELECT s_suppkey AS site, (s_suppkey * 37 % 400) / 100.0::DOUBLE AS sy, (s_suppkey * 53 % 400) / 100.0::DOUBLE AS sx FROM supplier",
    "stations": "SELECT c_custkey AS cell, (c_custkey * 7919 % 10007) / 100.0::DOUBLE AS gy, (c_custkey * 104729 % 10009) / 100.0::DOUBLE AS gx, c_mktsegment AS seg, c_acctbal / 7 AS u FROM customer",
    "places": "SELECT s_suppkey AS site, (s_suppkey * 3571 % 10007) / 100.0::DOUBLE AS sy, (s_suppkey * 2731 % 10009) / 100.0::DOUBLE AS sx FROM supplier",
    "wxfield": """SELECT CASE WHEN event_type = 'view' THEN 'A' ELSE 'B' END AS src, CAST(user_id % 25 AS INTEGER) AS cell, CAST(ts AS DATE) AS valid_day,
        avg(value / 50) AS u, avg((event_id % 20) / 2 - 5) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3""",
    "gen": """SELECT *, max(power) OVER (PARTITION BY site) AS capacity, lag(power) OVER (PARTITION BY site ORDER BY day) AS forecast
        FROM (SELECT user_id AS site, CAST(ts AS DATE) AS day, round(sum(value), 6) AS power FROM events GROUP BY 1, 2)""",
}
NEEDS = {"demand": ["daily"], "preds": ["daily", "demand"]}


def with_sql(names: str, body: str) -> str:
    """A DuckDB statement over the named logical tables."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + ("" if body.lstrip().startswith(",") else " ") + body
