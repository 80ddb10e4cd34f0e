"""Hand-computed rows, invariants, properties and leakage of the forecasting operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import metrics as M
from millrace.operators import blend as B
from millrace.operators import demand as D
from millrace.operators import model as G
from millrace.operators import trajectory as T
from millrace.operators import weather as W
from millrace.plans import queries as Q
from millrace.sources import tables as A


def one(df):
    (row,) = df.collect()
    return row


def test_csv_reads_fail_on_what_does_not_fit(spark, tmp_path):
    schema = spark.createDataFrame([], "a int, b double").schema
    (tmp_path / "good.csv").write_text("a,b\n1,2.5\n2,\n")
    assert [tuple(r) for r in A.read_table(spark, str(tmp_path / "good.csv"), schema, "csv").collect()] == [(1, 2.5), (2, None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2.5\nx,3\n")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|NumberFormat"):
        A.read_table(spark, str(tmp_path / "bad.csv"), schema, "csv").collect()
    spark.createDataFrame([("x",)], "a string").write.parquet(str(tmp_path / "odd"))
    with pytest.raises(Exception):
        A.read_table(spark, str(tmp_path / "odd"), schema).collect()


def test_submission_written_and_compared(spark, tmp_path):
    keys = spark.createDataFrame([(2,), (1,), (3,), (4,)], "k int")
    preds = spark.createDataFrame([(1, 0.5), (3, None), (4, 2.0), (9, 1.0)], "k int, pred double")
    out = A.make_submission(keys, preds, ["k"], -1.0)
    assert [tuple(r) for r in out.collect()] == [(1, 0.5), (2, -1.0), (3, -1.0), (4, 2.0)]
    A.write_submission(out, str(tmp_path / "s"))
    back = A.read_table(spark, str(tmp_path / "s"), out.schema, "csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, out.collect()))
    recorded = spark.createDataFrame([(1, 0.6), (2, -1.0), (3, -1.21), (7, 0.0)], "k int, pred double")
    got = {r.kind: r.n for r in A.diff_submissions(out, recorded, ["k"], 0.2).collect()}
    assert got == {"same": 2, "changed": 1, "missing": 1, "extra": 1}


def test_cache_is_pruned_and_common_values_are_split(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 4 == 0).cast("int").alias("p"), "id")
    A.write_cache(df, str(tmp_path / "c"), ["p"], file_rows=1000)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 4000 and "PartitionFilters: [isnotnull(p" in back.where("p = 1")._jdf.queryExecution().toString()


def test_ledger_and_board_with_ties_and_either_direction(spark):
    df = spark.createDataFrame([("c", "a", 1, 5.0), ("c", "b", 2, 4.0), ("c", "a", 3, 4.0), ("c", "d", 4, 7.0)], "g string, who string, ts int, s double")
    low = {r.ts: (r.best, r.gain_on_best, r.gain_on_first) for r in A.score_ledger(df, "g", ["ts"], "s", False).collect()}
    assert low == {1: (5.0, None, 0.0), 2: (4.0, 1.0, 1.0), 3: (4.0, 0.0, 1.0), 4: (4.0, -3.0, -2.0)}
    board = {r.who: (r.best, r["rank"]) for r in A.leaderboard(df, "g", "who", "s", False).collect()}
    assert board == {"a": (4.0, 1), "b": (4.0, 1), "d": (7.0, 3)}


def test_metrics_on_bounds_nulls_and_zeros(spark):
    hit = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0000001), (0.0, None)], "y double, p double")
    assert one(M.hit_rate(hit, ["p"], ["y"], 1.0)).hit_rate == pytest.approx(1 / 3)
    s = spark.createDataFrame([(0.0, 5.0), (2.0, 0.0), (2.0, 2.0), (4.0, None)], "y double, p double")
    got = one(M.smape_nz(s, "y", "p"))
    assert got.smape == pytest.approx(1.0) and got.n_scored == 2
    g = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 0.0)], "g string, y double, p double")
    w = spark.createDataFrame([("a", 9.0), ("b", 0.0), ("c", 2.0)], "g string, w double")
    assert one(M.weighted_smape(g, "y", "p", "g", w)).weighted_smape == pytest.approx(2.0)
    c = spark.createDataFrame([(10.0, 9.0, 20.0), (10.0, 8.0, 20.0), (10.0, 5.0, 20.0), (1.0, 1.0, 0.0)], "y double, p double, cap double")
    assert one(M.nmae(c, "y", "p", "cap")).nmae == pytest.approx((0.05 + 0.1 + 0.25) / 3)
    assert one(M.ficr(c, "y", "p", "cap", [(0.05, 1.0), (0.10, 0.5)])).ficr == pytest.approx(0.5)


def test_curves(spark):
    n, r = 12, 2.0
    circle = [(1, i, r * math.cos(i / 9), r * math.sin(i / 9), 0.0) for i in range(n)]
    line = [(2, i, float(i), 2.0 * i, 0.0) for i in range(n)]
    still = [(3, i, 1.0, 1.0, 1.0) for i in range(4)]
    df = spark.createDataFrame(circle + line + still, "id int, t int, x double, y double, z double")
    f = T.frenet_features(df, "id", "t", "x", "y", "z").collect()
    for row in (x for x in f if x.id == 1 and x.curvature is not None):
        assert row.curvature == pytest.approx(1 / r, rel=0.02)
        t, nrm, b = ([row[f"{v}{a}"] for a in "xyz"] for v in "tnb")
        assert np.allclose(np.array([t, nrm, b]) @ np.array([t, nrm, b]).T, np.eye(3), atol=1e-9)
    assert all(x.curvature in (None, 0.0) for x in f if x.id != 1)
    got = {(x.id, x.t): (x.next_x, x.next_y) for x in T.rotation_extrapolate(df, "id", "t", "x", "y", "z").collect()}
    assert got[1, 5] == pytest.approx((r * math.cos(6 / 9), r * math.sin(6 / 9))) and got[2, 5] == pytest.approx((6.0, 12.0)) and got[3, 3] == pytest.approx((1.0, 1.0))
    s = T.sequence_windows(df, "id", "t", ["x"], 5, 2)
    assert s.where("id = 3").count() == 0 and s.where("id = 2").count() == n - 4 - 2


def test_kalman_matches_a_matrix_filter_and_passes_nulls(spark):
    rng = np.random.default_rng(3)
    data = {i: [(t, float(v)) for t, v in enumerate(np.cumsum(rng.normal(size=15)))] for i in range(4)}
    data[1][6], data[2][0], data[3] = (6, None), (0, None), [(t, None) for t in range(3)]
    df = spark.createDataFrame([(i, t, x) for i, rows in data.items() for t, x in rows], "id int, t int, x double")
    q, r = 0.01, 0.1
    final = {k.id: k for k in T.kalman_residual(df, "id", "t", ["x"], q, r).collect()}
    steps = {(k.id, k.t): k for k in T.kalman_steps(df, "id", "t", ["x"], q, r).collect()}
    a, h = np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]])
    for i, rows in data.items():
        x, p, e = None, np.eye(2), None
        for t, o in rows:
            e = None
            if x is None:
                x = None if o is None else np.array([o, 0.0])
            else:
                x, p = a @ x, a @ p @ a.T
                if o is not None:
                    e = o - x[0]
                    k = (p @ h.T / (h @ p @ h.T + r))[:, 0]
                    x, p = x + k * e, (np.eye(2) - np.outer(k, h)) @ p
                p = p + np.diag([0, q])
            s = steps[i, t]
            assert (s.x_state is None) == (x is None) and (s.x_innovation is None) == (e is None)
            if x is not None:
                assert (s.x_state, s.x_velocity) == pytest.approx(tuple(x))
        f = final[i]
        assert f.x_state == (None if x is None else pytest.approx(x[0])) and f.x_innovation == (None if e is None else pytest.approx(e))


def test_demand_reads_only_the_past(spark):
    rows = [(1, d, float(v)) for d, v in enumerate([0, 4, 0, 2, 0, 9])] + [(2, d, 0.0) for d in range(3)]
    df = spark.createDataFrame(rows, "store int, day int, qty double")
    before = {(r.store, r.day): r.trailing_nz_mean for r in D.trailing_nz_mean(df, ["store"], "day", "qty", 3).collect()}
    assert [before[1, d] for d in range(6)] == [None, None, 4.0, 4.0, 3.0, 2.0] and before[2, 2] is None
    later = df.withColumn("qty", F.when((F.col("store") == 1) & (F.col("day") >= 4), 100.0).otherwise(F.col("qty")))
    after = {(r.store, r.day): r.trailing_nz_mean for r in D.trailing_nz_mean(later, ["store"], "day", "qty", 3).collect()}
    assert all(after[1, d] == before[1, d] for d in range(5))
    assert {r.store: r.nz_mean for r in D.nz_mean(df, ["store"], "qty").collect()} == {1: 5.0, 2: None}
    p = spark.createDataFrame([(1, None, 2.0), (1, 4.0, None), (1, None, None), (1, 4.0, 2.0)], "store int, p double, nz double")
    w = spark.createDataFrame([(1, 0.25)], "store int, w double")
    assert [r.blend for r in D.blend_nz_mean(p, "store", "p", "nz", w).collect()] == [2.0, 4.0, None, 3.5]


def test_forecasts_issued_with_or_after_the_target(spark):
    t = spark.createDataFrame([(1, 5, 10), (1, 2, 11), (2, 5, 12)], "k int, ts int, event_id int")
    f = spark.createDataFrame([(1, 3, 1, 1.0), (1, 5, 2, 2.0), (1, 6, 3, 3.0)], "k int, issue int, event_id int, value double")
    got = {r.event_id: r.issued_value for r in W.asof_issue(t, f, "k", "ts", "issue", "value", "event_id").collect()}
    assert got == {10: 2.0, 11: None, 12: None}


def test_grid_on_a_cell_and_with_cells_missing(spark):
    grid = spark.createDataFrame([(i, float(i // 2), float(i % 2)) for i in range(4)], "cell int, gy double, gx double")
    sites = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.5)], "site int, sy double, sx double")
    field = spark.createDataFrame([(0, 1.0), (3, 5.0)], "cell int, u double").withColumn("src", F.lit("A"))
    got = {r.site: (r.u, r.n_cells) for r in W.grid_to_site(sites, grid, field, 4, 2.0, ["u"], ["src"]).collect()}
    assert got[1] == (5.0, 1) and got[2] == (pytest.approx(3.0), 2)


def test_blend_properties(spark):
    wide = spark.createDataFrame([(1, 1.0, 3.0, 2.0), (2, None, 4.0, 1.0)], "k int, a double, b double, y double")
    assert [r.p for r in B.inject(wide, "a", "b", 0.0, "p").collect()] == [1.0, None] and [r.p for r in B.inject(wide, "a", "b", 1.0, "p").collect()][0] == 3.0
    long = A.stack_columns(wide, ["a", "b"], ["k"])
    alone = {r.k: r.blend for r in B.weighted_blend(long, ["k"], spark.createDataFrame([("b", 1.0)], "model string, w double")).collect()}
    assert alone == {1: 3.0, 2: 4.0}
    same = spark.createDataFrame([(1.0, 1.0, 2.0, 3.0), (2.0, 2.0, 2.0, 5.0), (4.0, 4.0, 2.0, 6.0)], "a double, b double, c double, y double")
    corr = {(r.a, r.b): r["corr"] for r in B.prediction_correlation(same, ["a", "b", "c"]).collect()}
    assert corr["a", "b"] == pytest.approx(1.0) and (corr["a", "c"] is None or math.isnan(corr["a", "c"]))
    assert {r.model: r.alpha for r in B.complement_screen(same, "a", ["b"], "y").collect()} == {"b": None}


@pytest.mark.parametrize("loss", ["absolute", "squared"])
def test_blend_weights(spark, loss):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 3))
    y = base @ [0.6, 0.4, 0.0]
    df = spark.createDataFrame([(int(i % 2), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(base, y))] + [(0, None, 1.0, 1.0, 1.0)], "g int, a double, b double, c double, y double")
    got = {r.model: r for r in B.fit_blend_weights(df, ["a", "b", "c"], "y", loss).collect()}
    w = np.array([got[m].w for m in "abc"])
    assert (w >= 0).all() and w.sum() == pytest.approx(1) and w == pytest.approx([0.6, 0.4, 0.0], abs=0.01)
    gaps = np.abs(base - y[:, None]) if loss == "absolute" else (base - y[:, None]) ** 2
    assert got["a"].loss <= gaps.mean(0).min() + 1e-9
    groups = B.fit_blend_weights(df, ["a", "b", "c"], "y", loss, by=["g"]).collect()
    assert len(groups) == 6 and {r.g for r in groups} == {0, 1} and all(r.w == pytest.approx({"a": 0.6, "b": 0.4, "c": 0.0}[r.model], abs=0.02) for r in groups)
    assert [r.w for r in B.fit_blend_weights(df, ["a"], "y", loss).collect()] == [1.0]
    assert B.fit_blend_weights(df.limit(0), ["a", "b"], "y", loss).count() == 0


def test_trees_beat_the_mean_and_reload(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 7), float(rng.normal()), 3.0 * (i % 7) + float(rng.normal()) / 10, f"2024-01-{1 + i % 28:02d}") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, f double, g double, y double, d string").withColumn("d", F.to_date("d"))
    split = G.time_split(df, "d", "2024-01-20", "2024-02-01", 2)
    train, valid = split.where("split = 'train'"), split.where("split = 'valid'")
    assert train.agg(F.max("d")).first()[0] < valid.agg(F.min("d")).first()[0]
    fitted = G.fit_gbt(train, ["f", "g"], "y", "squared", depth=3, iters=4).transform(valid)
    mean = train.agg(F.avg("y")).first()[0]
    assert fitted.agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0] < 0.5 * valid.agg(F.avg(F.abs(F.col("y") - mean))).first()[0]
    G.fit_and_save(train, str(tmp_path / "m"), ["f", "g"], "y", loss="squared", depth=3, iters=4)
    a, b = ({r.i: r.pred for r in x.collect()} for x in (fitted, G.score_model(valid, str(tmp_path / "m"))))
    assert a == b
    folds = G.rolling_origin(df, "d", ["2024-01-10", "2024-01-20", "2024-01-29"])
    for fold in (0, 1):
        own = folds.where(F.col("fold") == fold)
        assert own.where("split = 'train'").agg(F.max("d")).first()[0] < own.where("split = 'valid'").agg(F.min("d")).first()[0]
    out = G.oof_predictions(folds, [0, 1], lambda t: G.fit_gbt(t, ["f", "g"], "y", "squared", depth=2, iters=2))
    assert out.count() == folds.where("split = 'valid'").count() and out.where("pred is null").count() == 0


def test_row_order_changes_nothing(spark, sf_dir):
    df = Q.fx.preds(spark, sf_dir)
    a = M.smape_nz(df, "y", "p_lag7", ["store"])
    b = M.smape_nz(df.orderBy(F.rand(1)), "y", "p_lag7", ["store"])
    assert {r.store: round(r.smape, 9) for r in a.collect()} == {r.store: round(r.smape, 9) for r in b.collect()}


def test_ledger_and_board_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 3 else int(g), i, int(w), None if v < 2 else float(v)) for i, (g, w, v) in enumerate(zip(rng.choice(4, 3000, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 400, 3000), rng.integers(0, 60, 3000)))]
    df = spark.createDataFrame(rows, "g int, t int, who int, s double")
    for high in (True, False):
        better = max if high else min
        best, first, want = {}, {}, {}
        for g, t, _, s in rows:
            first.setdefault(g, s)
            before = best.get(g)
            if s is not None:
                best[g] = s if before is None else better(before, s)
            gain = lambda x: None if s is None or x is None else (s - x if high else x - s)  # noqa: B023, E731
            want[t] = (best.get(g), gain(before), gain(first[g]))
        got = A.score_ledger(df, "g", ["t"], "s", high)
        assert got.columns == ["g", "t", "who", "s", "best", "gain_on_best", "gain_on_first"]
        assert {r.t: (r.best, r.gain_on_best, r.gain_on_first) for r in got.collect()} == want
        tops = {}
        for g, _, who, s in rows:
            old = tops.get((g, who))
            tops[g, who] = s if old is None else old if s is None else better(old, s)
        board = A.leaderboard(df, "g", "who", "s", high).collect()
        assert len(board) == len(tops)
        worst = -math.inf  # null comes last from high to low and first from low to high
        level = {k: worst if v is None else v for k, v in tops.items()}
        for r in board:
            own = [v for (g, _), v in level.items() if g == r.g]
            at = level[r.g, r.who]
            rank = 1 + sum(v > at if high else v < at for v in own)
            assert (r.best, r["rank"]) == (tops[r.g, r.who], rank) and math.isclose(r.top_percent, 100 * rank / len(own))
    assert A.leaderboard(df.limit(0), "g", "who", "s", True).count() == 0
    assert A.score_ledger(df.limit(0), "g", ["t"], "s", True).count() == 0
