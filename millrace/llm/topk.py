"""Exact top-k search by inner product, block at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 64


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, dims, v): floor(scale * x) of every component; vectors null, empty or with a null or non-finite component drop out."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.col(vec_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dims"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def block_bounds(m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the blocks of m, and per query the most that each block's rows can score.

    The bound is the sum over components of what their largest or smallest value adds at most.
    """
    edges = np.arange(0, len(m), BLOCK)
    high, low = np.maximum.reduceat(m, edges, axis=0), np.minimum.reduceat(m, edges, axis=0)
    return edges, np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def best_of_blocks(ids: np.ndarray, m: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray, most_blocks: int | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best rows of m, ties to the lesser id, that score its floor or more.

    Rows lie in id order, in blocks of BLOCK. Blocks are scored by falling bound until
    it is below the k-th score or the floor, or ``most_blocks`` are done.
    """
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    edges, bounds = block_bounds(m, q)
    out = []
    for query, x, bound, floor in zip(query_ids.tolist(), q, bounds, floors.tolist()):
        visit = np.argsort(-bound, kind="stable")[:most_blocks]
        visit = visit[bound[visit] >= floor]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, m.dtype)
        at, step = 0, 1
        while at < len(visit):
            now = visit[at : at + step]
            if len(best) == k:
                now = now[bound[now] >= best[-1]]
                if not len(now):
                    break
            rows = (edges[now][:, None] + np.arange(BLOCK)).ravel()
            rows = rows[rows < len(ids)]
            rows = rows[ids[rows] != query]
            best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, m[rows] @ x])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            at, step = at + step, min(2 * step, 16)
        out += [(query, i, int(s)) for i, s in zip(best_ids.tolist(), best.tolist()) if s >= floor]
    return out


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", range_rows: int = 4096, query_rows: int = 2048) -> DataFrame:
    """Each query's k highest integer inner products over all other vectors: query_id, rank, vec_id, score.

    Candidates are dealt into ranges of about range_rows rows by id, queries into parts;
    a task holds one range and one part whatever the table. First each query scores the
    block of the highest bound in every range; the k-th best of these scores is its
    floor. Then every (range, part) meets once more and scores only blocks whose bounds
    reach the floor and the range's own k-th score, so pruning works across ranges.

    Ties go to the lesser vec_id. Vectors null, empty or with null or non-finite
    components, and null ids, take no part. Candidates are all rows but those with the
    query's id: a row given twice ranks twice. Queries alike in id and vector count
    once; unlike ones that share an id share one ranking. Vectors of different lengths
    never meet. Fewer than k candidates give fewer rows, an empty table none; other
    columns are not read.
    """
    sound = quantized(vectors, id_col, vec_col, scale)
    n = sound.count()
    ranged = sound.repartitionByRange(max(1, -(-n // range_rows)), "vec_id", F.xxhash64("v")).withColumn("range", F.spark_partition_id())
    all_ = materialize(ranged, "vectors")
    queries = all_.where(is_query).select("vec_id", "dims", "v").distinct()
    n_parts = max(1, -(-queries.count() // query_rows))
    queries = materialize(queries.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_parts)).cast("int")), "queries")
    n_ranges = (all_.agg(F.max("range")).first()[0] or 0) + 1
    left = all_.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    keys = ["dims", "range", "part"]

    def dense(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        return t.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(len(t), -1)

    def meet(floors: DataFrame, most_blocks: int | None) -> DataFrame:
        right = floors.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(n_ranges - 1))))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            rows = []
            if len(a) and len(b):
                (ids, m), (query_ids, q) = dense(a), dense(b)
                # float64 products and sums are exact below 2 ** 53
                if float(np.abs(m).max()) * float(np.abs(q).max()) * m.shape[1] < 2.0**53:
                    m, q = m.astype(np.float64), q.astype(np.float64)
                rows = best_of_blocks(ids, m, query_ids, q, k, b.column("floor").to_numpy(), most_blocks)
            cols = list(zip(*rows)) or [[], [], []]
            return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")

    lowest = F.lit(-(1 << 63)).cast("long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = meet(queries.withColumn("floor", lowest), 1).withColumn("rank", F.row_number().over(by))
    reached = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    floors = queries.join(reached, queries["vec_id"] == reached["query_id"], "left").select("vec_id", "dims", "v", "part", F.coalesce("reached", lowest).alias("floor"))
    found = meet(materialize(floors, "floors"), None)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
