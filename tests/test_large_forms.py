"""Operators on data that no single task or broadcast holds: equal to brute force, to the plain form, and planned as stated."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import demand as D
from millrace.operators import ranges as R
from millrace.operators import tiles as S
from millrace.operators import trajectory as T
from millrace.operators import weather as W


def plan(df):
    return df._jdf.queryExecution().toString()


def scattered(rng, n):
    """Evenly spread points, a dense cluster, a line, and many points on one spot."""
    even = rng.uniform(0, 100, (n // 2, 2))
    cluster = rng.normal(50, 1e-3, (n // 4, 2))
    line = np.column_stack([np.full(n // 8, 7.0), rng.uniform(0, 100, n // 8)])
    spot = np.tile([3.0, 4.0], (n - len(even) - len(cluster) - len(line), 1))
    return np.concatenate([even, cluster, line, spot])


@pytest.fixture(scope="module")
def geometry(spark):
    rng = np.random.default_rng(7)
    cells = scattered(rng, 100_000)
    sites = np.concatenate([rng.uniform(-20, 120, (60, 2)), cells[rng.integers(0, len(cells), 30)], [[3.0, 4.0], [1e6, -1e6], [50.0, 50.0]]])
    grid = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(cells)] + [(-1, None, 1.0), (-2, float("nan"), 2.0)], "cell int, gy double, gx double").cache()
    at = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(sites)] + [(-1, None, 0.0), (0, float(sites[0][0]), float(sites[0][1]))], "site int, sy double, sx double")
    d = np.sqrt((sites[:, None, 0] - cells[None, :, 0]) ** 2 + (sites[:, None, 1] - cells[None, :, 1]) ** 2)
    return grid, at, cells, d


def test_nearest_cells_of_a_large_grid(geometry):
    grid, sites, cells, d = geometry
    tree = S.tile_tree(grid, "cell", "gy", "gx")
    assert len(tree.levels) == 4 and tree.levels[0].agg(F.max("n")).first()[0] <= 64
    found = S.nearest_points(sites, tree, 6, "site", "sy", "sx", "cell", "gy", "gx")
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    got = {}
    for r in found.collect():
        got.setdefault(r.site, []).append((r.d, r.cell))
    assert set(got) == set(range(len(d)))
    for i, row in enumerate(d):
        assert sorted(got[i]) == sorted(zip(row, range(len(row))))[:6]


def test_few_tiles_meet_a_site(geometry, spark):
    grid, sites, _, _ = geometry
    tree = S.tile_tree(grid, "cell", "gy", "gx")
    assert tree.sizes == [level.count() for level in tree.levels] and tree.sizes[-1] == 1
    met, below = S._at_the_top(sites, tree, "site", "sy", "sx")
    assert met.count() == 93 * tree.sizes[-2] and [size for _, size in below] == tree.sizes[-3::-1]
    few = S.nearest_points(sites, S.tile_tree(grid.limit(3), "cell", "gy", "gx"), 6, "site", "sy", "sx", "cell", "gy", "gx")
    assert few.groupBy("site").count().agg(F.max("count")).first()[0] == 3
    assert S.nearest_points(sites, S.tile_tree(grid.limit(0), "cell", "gy", "gx"), 6, "site", "sy", "sx", "cell", "gy", "gx").count() == 0


@pytest.mark.parametrize("radius", [0.0, 0.0015, 2.5, 1e7])
def test_field_statistics_within_a_radius_of_a_large_grid(geometry, spark, radius):
    grid, sites, cells, d = geometry
    rng = np.random.default_rng(2)
    values = 1e9 + rng.normal(0, 1, len(cells))
    values[::17] = np.nan
    field = spark.createDataFrame([(i, None if v != v else float(v)) for i, v in enumerate(values)], "cell int, u double").withColumn("src", F.lit("A"))
    got = {r.site: r for r in W.field_stats(sites, grid, field, radius, "u", ["src"]).collect()}
    for i, row in enumerate(d):
        near = row <= radius
        if not near.any():
            assert i not in got
            continue
        own = near & ~np.isnan(values)
        r, v = got[i], values[own]
        if not own.any():
            assert r.mean is None and r.spread is None and r.slope_y is None
            continue
        assert r.mean == pytest.approx(v.mean(), rel=1e-12) and (r.least, r.greatest) == (v.min(), v.max())
        assert r.spread == pytest.approx(v.std(), abs=2e-6, rel=1e-6)
        for name, c in (("slope_y", cells[own, 0]), ("slope_x", cells[own, 1])):
            if c.min() == c.max():
                assert r[name] is None
            else:
                off = c - c.mean()
                assert r[name] == pytest.approx((off * (v - v.mean())).sum() / (off * off).sum(), rel=1e-4, abs=1e-5 * max(1, v.std() / c.std()))


def test_moments_merge_like_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(p), None if rng.random() < 0.1 else float(1e6 + v), float(y), float(x)) for g, p, v, y, x in zip(rng.integers(0, 3, 900), rng.integers(0, 20, 900), rng.normal(size=900), rng.normal(size=900), rng.normal(size=900))]
    df = spark.createDataFrame(rows + [(7, 0, None, 1.0, 1.0)], "g int, p int, v double, y double, x double")
    whole = {r.g: r.asDict() for r in S.moments_of(df, ["g"], "v", "y", "x").collect()}
    parts = S.merged_moments(S.moments_of(df, ["g", "p"], "v", "y", "x"), ["g"])
    for r in parts.collect():
        for k, v in whole[r.g].items():
            assert (r[k] is None and v is None) or (v is None and r[k] == 0) or r[k] == pytest.approx(v, rel=1e-9, abs=1e-7), (k, r[k], v)


def test_asof_with_one_key_over_many_ranges(spark):
    rng = np.random.default_rng(4)
    t = [(None if k == 2 else int(k), int(ts), i) for i, (k, ts) in enumerate(zip(rng.choice(4, 3000, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 900, 3000)))] + [(0, None, 9999)]
    # long stretches of key 0 without a forecast, and forecasts at the targets' own instants
    f = [(None if k == 2 else int(k), int(ts), i, float(i)) for i, (k, ts) in enumerate(zip(rng.choice(4, 200, p=[0.7, 0.1, 0.1, 0.1]), rng.choice([5, 6, 7, 300, 301, 899], 200)))] + [(0, None, 5, 1.0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.tie: (r.issued, r.issued_value) for r in W.asof_issue(spark.createDataFrame(t, "k int, ts int, tie int"), spark.createDataFrame(f, "k int, issue int, tie int, v double"), "k", "ts", "issue", "v", "tie").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, ts, tie in t:
        own = [] if k is None or ts is None else [x for x in f if x[0] == k and x[1] is not None and x[1] <= ts]
        want = max(own, key=lambda x: (x[1], x[2], x[3])) if own else (None, None, None, None)
        assert got[tie] == (want[1], want[3]), (k, ts, tie)


def test_positions_and_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 2 else int(g), int(i), int(v)) for i, (g, v) in enumerate(zip(rng.choice(3, 4000, p=[0.8, 0.15, 0.05]), rng.integers(0, 50, 4000)))]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    want = {}
    for g in (0, 1, None):
        want |= {i: n for n, (_, i) in enumerate(sorted((v, i) for h, i, v in rows if h == g))}
    assert {r.i: r["n"] for r in R.positions(df, ["g"], ["v", "i"], "n").collect()} == want
    blocks = R.in_blocks(df, ["g"], ["v", "i"], 3, 2, rows=100)
    sizes = blocks.groupBy("g", "_block").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] == 105 and sizes[1] > 40
    assert blocks.where("not _guest").count() == 4000


def series(spark, rng, n=3000, nulls=0.05):
    sizes = {1: n, 2: 40, 3: 3, None: 130}
    return spark.createDataFrame([(i, t, *[None if rng.random() < nulls else float(x) for x in rng.normal(size=3)]) for i, m in sizes.items() for t in range(m)], "id int, t int, x double, y double, z double")


def rows_of(df):
    def plain(v):
        return "null" if v is None else tuple(map(plain, v)) if isinstance(v, list) else round(v, 7) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(map(plain, r)) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [1, 7, 64, 1000])
def test_blocks_change_nothing(spark, rows):
    df = series(spark, np.random.default_rng(6), 900, 0.02)
    shapes = {
        "frenet": lambda r: T.frenet_features(df, "id", "t", "x", "y", "z", rows=r),
        "rotation": lambda r: T.rotation_extrapolate(df, "id", "t", "x", "y", "z", 2, rows=r),
        "windows": lambda r: T.sequence_windows(df, "id", "t", ["x", "y"], 5, 2, rows=r),
        "trailing": lambda r: D.trailing_nz_mean(df, ["id"], "t", "x", 9, rows=r),
    }
    for name, of in shapes.items():
        assert rows_of(of(rows)) == rows_of(of(1 << 20)), name


@pytest.mark.parametrize("rows", [1, 5, 33])
def test_kalman_scan_equals_the_fold(spark, rows):
    rng = np.random.default_rng(8)
    df = series(spark, rng, 500, 0.3).withColumn("x", F.when((F.col("id") == 1) & (F.col("t") < 120), None).otherwise(F.col("x"))).withColumn("z", F.when(F.col("id") == 1, None).otherwise(F.col("z")))
    whole = {(r.id, r.t): r for r in T.kalman_steps(df, "id", "t", ["x", "y", "z"], 0.01, 0.1).collect()}
    for r in T.kalman_steps(df, "id", "t", ["x", "y", "z"], 0.01, 0.1, rows=rows).collect():
        for a, b in zip(r[2:], whole[r.id, r.t][2:]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9))
    final = {r.id: r for r in T.kalman_residual(df, "id", "t", ["x", "y", "z"], 0.01, 0.1).collect()}
    for r in T.kalman_residual(df, "id", "t", ["x", "y", "z"], 0.01, 0.1, rows=rows).collect():
        assert r.n_obs == final[r.id].n_obs
        assert [v is None or v == pytest.approx(w, rel=1e-9, abs=1e-9) for v, w in zip(r[2:], final[r.id][2:])] == [True] * 9
    with pytest.raises(ValueError):
        T.kalman_steps(df, "id", "t", ["x"], 0.01, 0.0)


def test_kalman_scan_on_a_million_steps(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("id"), F.col("id").alias("t"), F.when(F.col("id") % 11 != 0, F.sin(F.col("id") / 500.0) * 10 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"))
    steps = T.kalman_steps(df, "id", "t", ["x"], 0.01, 0.1)
    assert "applyInPandas" not in plan(steps) or "_block" in plan(steps)
    got = steps.where(F.col("t") % 99991 == 7).orderBy("t").select("t", "x_state", "x_velocity", "x_innovation").collect()
    readings = [r.x for r in df.orderBy("t").select("x").collect()]
    x, v, a, b, d, want = None, 0.0, 1.0, 0.0, 1.0, {}
    for t, o in enumerate(readings):
        e = None
        if x is None:
            x = o
        else:
            x, a, b = x + v, a + 2 * b + d, b + d
            if o is not None:
                e, k0, k1 = o - x, a / (a + 0.1), b / (a + 0.1)
                x, v, a, b, d = x + k0 * e, v + k1 * e, (1 - k0) * a, (1 - k0) * b, d - k1 * b
            d += 0.01
        want[t] = (x, v, e)
    assert len(got) >= 10
    for r in got:
        for p, q in zip(r[1:], want[r.t]):
            assert (p is None) == (q is None) and (p is None or math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9))
