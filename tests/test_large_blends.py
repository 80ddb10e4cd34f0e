"""Blending, submissions, caches and folds in their large forms: equal to brute force and to the plain forms."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import blend as B
from millrace.operators import model as G
from millrace.sources import tables as A


def plan(df):
    return df._jdf.queryExecution().toString()


def test_best_alpha_is_the_least_over_all_kinks(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in (0, 1, 2, None):
        for _ in range(400 if g == 0 else 37):
            base, new = float(rng.integers(0, 6)), float(rng.integers(0, 6))
            rows.append((g, base, new, float(rng.integers(-2, 9))))
    rows += [(3, 1.0, 1.0, 4.0), (3, 2.0, 2.0, 2.0), (4, None, 1.0, 1.0), (0, 1.0, None, 1.0), (1, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "g int, b double, n double, y double")
    for low, high in ((0.0, 1.0), (None, None), (-0.5, 0.25)):
        got = {r.g: r for r in B.best_alpha(df, "b", "n", "y", ["g"], low, high).collect()}
        assert set(got) == {0, 1, 2, None, 3}
        for g in (0, 1, 2, None):
            own = np.array([r[1:] for r in rows if r[0] == g and None not in r[1:]])
            loss = lambda a: np.abs(own[:, 2] - ((1 - a) * own[:, 0] + a * own[:, 1])).mean()  # noqa: B023, E731
            moved = own[own[:, 0] != own[:, 1]]
            kinks = np.unique((moved[:, 2] - moved[:, 0]) / (moved[:, 1] - moved[:, 0]))
            bounds = [x for x in (low, high) if x is not None]
            tried = np.unique(np.concatenate([kinks if low is None else np.clip(kinks, low, high), bounds]))
            losses = np.array([loss(a) for a in tried])
            least = tried[losses <= losses.min() + 1e-12].min()
            assert got[g].mae == pytest.approx(losses.min(), abs=1e-12) and got[g].n_scored == len(own)
            assert got[g].alpha == pytest.approx(least, abs=1e-12)
        assert got[3].alpha is None and got[3].mae == pytest.approx(1.5)
    whole = B.best_alpha(df.where("g = 0"), "b", "n", "y").collect()
    assert len(whole) == 1 and B.best_alpha(df.limit(0), "b", "n", "y").count() == 0


def test_correlations_of_nineteen_models(spark):
    rng = np.random.default_rng(2)
    x = 1e9 + rng.normal(size=(2000, 19)) @ rng.normal(size=(19, 19))
    x[:, 3], x[:, 5] = 0.1, x[:, 4]
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = np.nan
    names = [f"m{i}" for i in range(19)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(7)
    found = B.prediction_correlation(df, names)
    got = {(r.a, r.b): r["corr"] for r in found.collect()}
    assert len(got) == 171 and plan(found).count("MapInArrow") > 0
    for i in range(19):
        for j in range(i + 1, 19):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if not both.any() or 3 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                a, b = (x[both, k] - x[both, k].mean() for k in (i, j))
                assert got[names[i], names[j]] == pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), abs=1e-9)
    assert B.prediction_correlation(df.limit(0), names[:2]).collect()[0]["corr"] is None


def test_packed_blocks_are_small(spark):
    """Spark reads thousands of blocks at once, so a block holds few rows however many a task has."""
    rng = np.random.default_rng(8)
    for rows, columns in ((30_000, 3), (500, 700)):
        x = rng.normal(size=(rows, columns))
        df = spark.createDataFrame(x).coalesce(1)
        packed = B._packed(df)
        most, n = packed.agg(F.max(F.octet_length("x")), F.sum("n")).first()
        assert most <= max(4096, 8 * columns) and n == rows
        total, n = B._summed(packed, lambda t: t[:3].sum(1), 3)
        assert n == rows and total == pytest.approx(x[:, :3].sum(0))


@pytest.mark.parametrize("loss", ["absolute", "squared"])
def test_weights_of_a_group_no_task_holds(spark, loss):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 3))
    g = np.where(np.arange(900) < 600, 0, np.where(np.arange(900) < 850, 1, 2))
    true = np.array([[0.6, 0.4, 0.0], [0.0, 0.3, 0.7], [1.0, 0.0, 0.0]])
    y = (base * true[g]).sum(1) + rng.normal(size=900) * 0.01
    df = spark.createDataFrame([(None if k == 1 else int(k), *map(float, r), float(v)) for k, r, v in zip(g, base, y)], "g int, a double, b double, c double, y double").repartition(5)
    options = dict(loss=loss, by=["g"], steps=(0.05, 0.2), rounds=12)
    small = {(r.g, r.model): (r.w, r.loss) for r in B.fit_blend_weights(df, ["a", "b", "c"], "y", **options).collect()}
    large = {(r.g, r.model): (r.w, r.loss) for r in B.fit_blend_weights(df, ["a", "b", "c"], "y", task_rows=100, **options).collect()}
    assert set(small) == set(large) and len(small) == 9
    for k, (w, value) in small.items():
        assert large[k] == (pytest.approx(w, abs=1e-9), pytest.approx(value, abs=1e-9))


def test_blend_keeps_keys_without_a_weighted_model(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "z", 5.0), (2, "z", 1.0), (3, "a", None)], "k int, model string, pred double")
    got = {r.k: (r.blend, r.n_models) for r in B.weighted_blend(long, ["k"], spark.createDataFrame([("a", 0.5)], "model string, w double")).collect()}
    assert got == {1: (1.0, 1), 2: (None, 0), 3: (None, 0)}


@pytest.mark.parametrize("renorm", [True, False])
def test_wide_blends_equal_long_ones(spark, renorm):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4))
    x[rng.random(x.shape) < 0.4] = np.nan
    wide = spark.createDataFrame([(i, *[None if v != v else float(v) for v in r]) for i, r in enumerate(x)], "k int, a double, b double, c double, d double")
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 1.0), ("z", 3.0), ("d", None)], "model string, w double")
    key = lambda df: {r.k: (None if r.blend is None else round(r.blend, 9), r.n_models) for r in df.collect()}
    got = B.blend_columns(wide, list("abcd"), weights, renorm)
    assert key(got) == key(B.weighted_blend(A.stack_columns(wide, list("abcd"), ["k"]), ["k"], weights, renorm))
    assert "Exchange" not in plan(got) and got.columns == ["k", "a", "b", "c", "d", "blend", "n_models"]


def test_fingerprints_find_every_difference(spark):
    rng = np.random.default_rng(4)
    base = {i: float(rng.integers(0, 50)) for i in range(3000)}
    rebuilt = {k: v + 1.0 if k % 701 == 3 else v for k, v in base.items() if k % 997 != 5} | {9000: 1.0}
    base[7], rebuilt[7], rebuilt[11] = None, None, None
    base[13], rebuilt[13] = 0.0, -0.0
    sides = [spark.createDataFrame(list(d.items()), "k int, pred double") for d in (base, rebuilt)]
    sides.append(sides[0].unionByName(spark.createDataFrame([(None, 2.0)], "k int, pred double")))
    for a, b in ((0, 1), (1, 0), (0, 0), (2, 1), (2, 2)):
        for tol in (0.0, 2.0):
            key = lambda rows: sorted((r.kind, r.n, r.max_gap) for r in rows.collect())
            assert key(A.diff_by_fingerprint(sides[a], sides[b], ["k"], tol, parts=64)) == key(A.diff_submissions(sides[a], sides[b], ["k"], tol)), (a, b, tol)
    assert A.diff_by_fingerprint(sides[0].limit(0), sides[0].limit(0), ["k"], 0.0).count() == 0


def test_buckets_need_no_exchange(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 97).alias("store"), F.col("id").alias("day"), (F.col("id") * 2).alias("v"))
    a = A.write_bucketed(df, "bucketed_a", ["store"], ["day"], 8, str(tmp_path / "a"))
    b = A.write_bucketed(df.withColumnRenamed("v", "w"), "bucketed_b", ["store"], ["day"], 8, str(tmp_path / "b"))
    totals = b.groupBy("store").agg(F.sum("w").alias("total"))
    both = a.join(totals.hint("merge"), "store").withColumn("s", F.sum("v").over(Window.partitionBy("store").orderBy("day")))
    assert both.count() == 4000 and both.where("day >= 4000 - 97 and s <> total").count() == 0
    shown = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "SortMergeJoin" in shown


def test_a_rewritten_partition_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "c")
    A.write_cache(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "p int, v int"), path, ["p"])
    A.write_cache(spark.createDataFrame([(2, 20), (2, 21)], "p int, v int"), path, ["p"], only_own_partitions=True)
    assert sorted((r.p, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 20), (2, 21), (3, 3)]
    A.write_cache(spark.createDataFrame([(4, 4)], "p int, v int"), path, ["p"])
    assert [(r.p, r.v) for r in spark.read.parquet(path).collect()] == [(4, 4)]


def test_folds_at_once_predict_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(i % 7), 3.0 * (i % 7) + float(rng.normal()), f"2024-{1 + i % 12:02d}-01") for i in range(1200)]
    df = spark.createDataFrame(rows, "i int, f double, y double, d string").withColumn("d", F.to_date("d"))
    folds = G.rolling_origin(df, "d", [f"2024-{m:02d}-01" for m in (4, 6, 8, 10, 12)])
    fit = lambda t: G.fit_gbt(t, ["f"], "y", "squared", depth=3, iters=3)
    found = {}
    for at_once in (1, 4):
        found[at_once] = G.oof_predictions(folds, [0, 1, 2, 3], fit, at_once).orderBy("fold", "i").collect()
    assert len(found[1]) == len(found[4]) == folds.where("split = 'valid'").count()
    for a, b in zip(found[1], found[4]):
        assert (a.fold, a.i) == (b.fold, b.i) and a.pred == pytest.approx(b.pred, rel=1e-9)  # sums may round in another order
