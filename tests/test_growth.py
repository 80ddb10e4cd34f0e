"""Forms whose tasks, exchanges and passes must not grow faster than the input."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from millrace import fixtures as fx
from millrace.operators import blend as B
from millrace.operators import demand as D
from millrace.operators import tiles as S
from millrace.operators import weather as W
from millrace.plans import queries as Q
from millrace.sources import tables as A


def plan(df):
    return df._jdf.queryExecution().toString()


def test_densify_moves_only_the_sparse_rows(spark):
    at = lambda i: None if i is None else datetime.date(2024, 1, 1) + datetime.timedelta(i)
    rows = [(1, 0, 2.0), (1, 0, 3.0), (1, 4, None), (2, 2, 5.0), (2, None, 6.0), (3, None, 1.0), (3, None, 2.0), (None, 1, 4.0), (None, 3, 4.0), (4, 6, 7.0), (4, None, 7.0), (4, None, 8.0)]
    df = spark.createDataFrame([(k, at(i), v) for k, i, v in rows], "k int, day date, v double")
    dense = D.densify(df, ["k"], "day", "v", 0.5)
    as_list = lambda d: sorted(map(str, d.collect()))
    assert as_list(dense) == as_list(D._densify_by_join(df, ["k"], "day", "v", 0.5)) and "Join" not in plan(dense)
    many = df.select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("k"), "day", "v")
    assert D.densify(many, ["k"], "day", "v", rows=7).rdd.getNumPartitions() > 40
    assert D.densify(df.limit(0), ["k"], "day", "v").count() == 0 and D.densify(df.where("k = 3"), ["k"], "day", "v").count() == 0


def test_windows_and_groupings_of_dense_rows_need_no_exchange(spark, sf_dir):
    n = plan(fx.demand(spark, sf_dir)).split("== Physical Plan ==")[1].count("Exchange")
    for of in (fx.preds(spark, sf_dir), B.pivot_predictions(Q.long_preds(spark, sf_dir), ["store", "day"], fx.MODELS), Q.trailing_nz_mean(spark, sf_dir), Q.best_alpha(spark, sf_dir)):
        assert plan(of).split("== Physical Plan ==")[1].count("Exchange") == n


def test_pivot_groups_once(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "b", 3.0), (2, "c", 9.0), (3, "c", 1.0)], "k int, model string, pred double")
    wide = B.pivot_predictions(long, ["k"], ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, 2.0, None), (2, None, 3.0), (3, None, None)] and "pivotfirst" not in plan(wide).lower()


def test_best_alpha_of_small_groups_is_that_of_large(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g) if g else None, *map(float, rng.integers(0, 6, 3))) for g in rng.integers(0, 8, 600)] + [(99, 1.0, 1.0, 4.0), (98, 2.0, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, b double, n double, y double")
    for low, high in ((0.0, 1.0), (None, None)):
        got = [sorted((str(r.g), r.alpha, round(r.mae, 9), r.n_scored) for r in B.best_alpha(df, "b", "n", "y", ["g"], low, high, **o).collect()) for o in ({}, {"task_rows": 3}, {"largest": 200})]
        assert got[0] == got[1] == got[2] and len(got[0]) == 9


def test_searches_share_their_passes():
    rng = np.random.default_rng(3)
    x, calls = rng.normal(size=(5, 500)), []

    def losses(trials):
        calls.append(len(trials))
        return B._totals(x, "absolute", trials) / 500

    steps = (0.01, 0.2)
    w, best = B._pair_swaps(losses, np.vstack([np.full(4, 0.25), np.eye(4)]), steps, 60)
    again = losses(np.vstack([w, B._moves(w, steps)]))
    assert abs(again[0] - best) < 1e-9 and again.min() > best - 1e-9
    assert calls[0] == 6 and max(calls[1:-1]) > 12 * len(steps)


def test_rounded_is_round(spark):
    rng = np.random.default_rng(1)
    xs = [*(rng.normal(size=3000) * 10.0 ** rng.integers(-9, 13, 3000)), *(rng.integers(-(10**9), 10**9, 2000) / 2e6), np.nan, np.inf, -np.inf, 0.0, -0.0, 5e-7, -5e-7, None]
    df = spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double")
    both = Q.rounded(df.select("x", F.round("x", 6).cast("string").alias("s")))
    assert both.where("not (s <=> cast(x as string))").count() == 0


def test_submission_is_joined_once_for_its_sort(spark):
    keys = spark.createDataFrame([(2,), (1,), (3,)], "k int")
    filled = A.make_submission(keys, spark.createDataFrame([(1, 5.0), (3, None)], "k int, pred double"), ["k"], -1.0)
    assert list(map(tuple, filled.collect())) == [(1, 5.0), (2, -1.0), (3, -1.0)] and "Join" not in plan(filled)


def test_circles_are_summed_where_their_cells_are(spark):
    rng = np.random.default_rng(11)
    cells, sites = rng.integers(0, 200, (2500, 2)) / 10.0, rng.integers(0, 200, (150, 2)) / 10.0
    values = [(i, k, None if rng.random() < 0.2 else float(rng.normal())) for i in range(len(cells)) for k in ("a", "b", None)[: i % 4]]
    values[40] = (values[40][0], values[40][1], float("nan"))
    grid = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(cells)], "cell int, gy double, gx double")
    at = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(sites)], "site int, sy double, sx double")
    field = spark.createDataFrame(values, "cell int, k string, u double")
    for radius, of in ((6.0, {"leaf": 4, "block_sites": 40, "group_points": 9}), (0.1, {})):
        stats = W.field_stats(at, grid, field, radius, "u", ["k"], **of)
        got = {(r.site, r.k): r for r in stats.collect()}
        assert "CoGroup" in plan(stats)
        near = np.sqrt(((sites[:, None] - cells[None]) ** 2).sum(2)) <= radius
        want = {}
        for c, k, v in values:
            for s in np.flatnonzero(near[:, c]):
                want.setdefault((int(s), k), []).append((v, *cells[c]))
        assert set(got) == set(want)
        for key, rows in want.items():
            v, y, x = np.array([r for r in rows if r[0] is not None] or np.empty((0, 3))).T
            r = got[key]
            if not len(v):
                assert r.mean is None and r.spread is None and r.least is None and r.slope_y is None
            elif np.isnan(v).any():
                assert np.isnan(r.mean) and np.isnan(r.greatest)
            else:
                assert abs(r.mean - v.mean()) < 1e-9 and abs(r.spread - v.std()) < 1e-9 and (r.least, r.greatest) == (v.min(), v.max())
                for slope, c in ((r.slope_y, y), (r.slope_x, x)):
                    assert (slope is None) == (c.min() == c.max())
                    assert slope is None or abs(slope - ((c - c.mean()) * (v - v.mean())).sum() / ((c - c.mean()) ** 2).sum()) < 1e-7


def test_sites_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_SITES", 10)
    place = lambda n, name, y, x: spark.range(n).select(F.col("id").alias(name), (F.col("id") * 37 % 101 / 10.0).alias(y), (F.col("id") * 53 % 103 / 10.0).alias(x))
    w = W.cell_weights(place(400, "site", "sy", "sx"), place(300, "cell", "gy", "gx"), 3, 2.0)
    sizes = [r["n"] for r in w.select("site", F.spark_partition_id().alias("p")).distinct().groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) < 40


def test_weights_meet_the_predictions_where_they_lie(spark, sf_dir):
    n = plan(fx.demand(spark, sf_dir)).split("== Physical Plan ==")[1].count("Exchange")
    assert plan(Q.weighted_blend(spark, sf_dir)).split("== Physical Plan ==")[1].replace("BroadcastExchange", "").count("Exchange") == n


def test_submissions_of_a_diff_are_made_once(spark, sf_dir):
    assert "Window" not in plan(Q.diff_submissions(spark, sf_dir))


def test_array_forecasts_are_those_of_the_windows(spark, sf_dir, tmp_path):
    as_rows = lambda df: sorted(map(tuple, df.select("store", "day", "y", *fx.MODELS).collect()), key=str)
    assert "Window" not in plan(fx.ungrouped_preds(spark, sf_dir))
    rng = np.random.default_rng(12)
    day = lambda i: None if i is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(int(i))
    rows = [(int(k), day(d), float(q) / 3) for k, d, q in zip(rng.integers(0, 9, 120), rng.integers(0, 70, 120), rng.integers(-2, 9, 120))]
    rows += [(None, day(3), 2.0), (20, None, 1.0), (21, day(5), None), (22, day(9), float("nan")), (22, day(12), 5.0), (23, day(9), float("inf")), (24, day(30), -0.0)]
    for name, kept in (("odd", rows), ("week", [(1, day(i), 1.0) for i in (0, 3, 6)]), ("one", [(1, day(0), 1.0)]), ("none", [])):
        spark.createDataFrame(kept, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        assert as_rows(fx.ungrouped_preds(spark, f"{tmp_path}/{name}")) == as_rows(fx.preds(spark, f"{tmp_path}/{name}")), name
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert as_rows(fx.ungrouped_preds(spark, f"{tmp_path}/odd")) == as_rows(fx.preds(spark, f"{tmp_path}/odd"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert as_rows(fx.ungrouped_preds(spark, sf_dir)) == as_rows(fx.preds(spark, sf_dir))
