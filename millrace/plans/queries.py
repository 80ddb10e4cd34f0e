"""One query per operator on the logical tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import metrics as M
from ..operators import blend as B
from ..operators import demand as D
from ..operators import model as G
from ..operators import trajectory as T
from ..operators import weather as W
from ..sources import tables as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TIERS = [(0.05, 1.0), (0.10, 0.5)]
MODEL_SQL = " UNION ALL ".join(f"SELECT store, day, y, '{m}' AS model, {m} AS pred FROM preds" for m in fx.MODELS)


def query(tables: str = "", sql: str | None = None):
    """Register a query under its name, with its twin over the logical tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = fx.with_sql(tables, sql).replace("WITH", "WITH RECURSIVE", 1) if tables else sql
        return f

    return add


def _round(c: str, digits: int) -> Column:
    """F.round of a double by plain arithmetic, which takes a fraction of the time; near ties and for large or odd values by F.round itself."""
    x, scale = F.col(c), 10.0**digits
    off = F.abs(x * scale - F.floor(x * scale) - 0.5)
    return F.when((F.abs(x) < 2.0**52 / scale / 1024) & (off > 1e-2), F.floor(x * scale + 0.5) / scale).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Computed doubles to a fixed number of digits, as both engines can agree on."""
    return df.select(*[_round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def long_preds(spark, sf):
    return A.stack_columns(fx.preds(spark, sf), fx.MODELS, ["store", "day", "y"])


# --- demand ---


@query("demand", "SELECT store, day, qty FROM demand")
def densify(spark, sf):
    return fx.demand(spark, sf)


@query("daily", "SELECT store, round(avg(CASE WHEN qty > 0 THEN qty END), 6) AS nz_mean, count(CASE WHEN qty > 0 THEN qty END) AS n_nz FROM daily GROUP BY store")
def nz_mean(spark, sf):
    return rounded(D.nz_mean(fx.daily(spark, sf), ["store"], "qty"))


@query("demand", "SELECT store, day, qty, round(avg(CASE WHEN qty > 0 THEN qty END) OVER (PARTITION BY store ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS trailing_nz_mean FROM demand")
def trailing_nz_mean(spark, sf):
    return rounded(D.trailing_nz_mean(fx.demand(spark, sf), ["store"], "day", "qty", 28, longest=fx.demand_days(spark, sf)))


@query("preds", """, w AS (SELECT store, (store % 5) / 4.0::DOUBLE AS w FROM preds GROUP BY store)
    SELECT store, day, y, round(coalesce((1 - w) * p_mean + w * p_nz28, p_mean, p_nz28), 6) AS blend FROM preds JOIN w USING (store)""")
def blend_nz_mean(spark, sf):
    p = fx.preds(spark, sf)
    # all stores, as reading those of p would build p twice
    weights = fx.daily(spark, sf).select("store").distinct().withColumn("w", F.col("store") % 5 / F.lit(4.0))
    return rounded(D.blend_nz_mean(p, "store", "p_mean", "p_nz28", weights).select("store", "day", "y", "blend"))


# --- metrics ---


@query("traj", """, n AS (SELECT traj_id, label, x, y, z, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM traj WINDOW w AS (PARTITION BY traj_id ORDER BY t))
    SELECT label, round(avg(CASE WHEN sqrt((px-x)*(px-x)+(py-y)*(py-y)+(pz-z)*(pz-z)) <= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM n GROUP BY label""")
def hit_rate(spark, sf):
    last = lambda c: D.lagged(F.col(c), 1, ["traj_id"], "t")
    t = fx.traj(spark, sf).select("label", "x", "y", "z", last("x").alias("px"), last("y").alias("py"), last("z").alias("pz"))
    return rounded(M.hit_rate(t, ["px", "py", "pz"], ["x", "y", "z"], 0.25, ["label"]))


@query("preds", "SELECT store, round(avg(abs(y - p_nz28)), 6) AS mae FROM preds GROUP BY store")
def mae(spark, sf):
    return rounded(M.mae(fx.preds(spark, sf), "y", "p_nz28", ["store"]))


SMAPE_SQL = "avg(CASE WHEN y <> 0 THEN 2.0 * abs(y - {p}) / nullif(abs(y) + abs({p}), 0) END)"


@query("preds", f"SELECT store, round({SMAPE_SQL.format(p='p_lag7')}, 6) AS smape, count(CASE WHEN y <> 0 AND p_lag7 IS NOT NULL THEN 1 END) AS n_scored FROM preds GROUP BY store")
def smape_nz(spark, sf):
    return rounded(M.smape_nz(fx.preds(spark, sf), "y", "p_lag7", ["store"]))


NZ_SQL = """, f AS (SELECT store, day, qty AS y, avg(CASE WHEN qty > 0 THEN qty END) OVER (PARTITION BY store ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS p FROM demand),
    s AS (SELECT store, avg(CASE WHEN y <> 0 THEN 2.0 * abs(y - p) / nullif(abs(y) + abs(p), 0) END) AS smape, count(CASE WHEN y <> 0 AND p IS NOT NULL THEN 1 END) AS n, sum(y) AS w FROM f GROUP BY store)
    SELECT round(sum(w * smape) / sum(w), 6) AS weighted_smape, CAST(sum(n) AS BIGINT) AS n_scored FROM s WHERE smape IS NOT NULL"""


@query("demand", NZ_SQL)
def weighted_smape(spark, sf):
    f = D.trailing_nz_mean(fx.demand(spark, sf), ["store"], "day", "qty", 28, longest=fx.demand_days(spark, sf))
    return rounded(M.weighted_smape(f, "qty", "trailing_nz_mean", "store", f.groupBy("store").agg(F.sum("qty").alias("w"))))


@query("gen", "SELECT site, round(avg(CASE WHEN power >= 0.1 * capacity THEN abs(power - forecast) / nullif(capacity, 0) END), 6) AS nmae FROM gen GROUP BY site")
def nmae(spark, sf):
    return rounded(M.nmae(fx.gen(spark, sf), "power", "forecast", "capacity", 0.1, ["site"]))


FICR_SQL = """, e AS (SELECT *, abs(power - forecast) / nullif(capacity, 0) AS err FROM gen),
    r AS (SELECT *, CASE WHEN err <= 0.05 THEN 1.0 WHEN err <= 0.10 THEN 0.5 ELSE 0.0 END AS rate FROM e)"""
FICR_OF = "sum(CASE WHEN err IS NOT NULL THEN rate * power END) / nullif(sum(CASE WHEN err IS NOT NULL THEN 1.0 * power END), 0)"


@query("gen", f"{FICR_SQL} SELECT site, round({FICR_OF}, 6) AS ficr FROM r GROUP BY site")
def ficr(spark, sf):
    return rounded(M.ficr(fx.gen(spark, sf), "power", "forecast", "capacity", TIERS, ["site"]))


@query("gen", f"{FICR_SQL}, s AS (SELECT avg(err) AS nmae, {FICR_OF} AS ficr FROM r) SELECT round(nmae, 6) AS nmae, round(ficr, 6) AS ficr, round(0.5 * (1 - nmae) + 0.5 * ficr, 6) AS score FROM s")
def composite_score(spark, sf):
    return rounded(M.composite_score(fx.gen(spark, sf), "power", "forecast", "capacity", TIERS))


@query("preds", """SELECT store, CAST(month(day) AS INTEGER) AS month, CAST(grouping_id(store, month(day)) AS BIGINT) AS level, round(avg(abs(y - p_mean)), 6) AS mae
    FROM preds GROUP BY ROLLUP (store, month(day))""")
def metric_rollup(spark, sf):
    return rounded(M.metric_rollup(fx.preds(spark, sf).withColumn("month", F.month("day")), ["store", "month"], mae=M.mae_of("y", "p_mean")))


@query("preds", f""", l AS ({MODEL_SQL}), s AS (SELECT model, {SMAPE_SQL.format(p='pred')} AS score FROM l GROUP BY model)
    SELECT model, round(score, 6) AS score, rank() OVER (ORDER BY score) AS rank, round((SELECT score FROM s WHERE model = 'p_lag7') - score, 6) AS gain FROM s""")
def compare_models(spark, sf):
    return rounded(M.compare_models(long_preds(spark, sf), M.smape_nz_of, "p_lag7"))


# --- prediction sets ---


@query("preds", f"SELECT store, day, y, model, round(pred, 6) AS pred FROM ({MODEL_SQL})")
def stack_predictions(spark, sf):
    path = A.scratch(spark, "preds")
    fx.ungrouped_preds(spark, sf).write.parquet(path)
    stored = {m: spark.read.parquet(path).select("store", "day", "y", F.col(m).alias("pred")) for m in fx.MODELS}
    return rounded(A.stack_predictions(stored, ["store", "day", "y"]))


@query("preds", "SELECT store, day, round(p_lag1, 6) AS p_lag1, round(p_lag7, 6) AS p_lag7, round(p_nz28, 6) AS p_nz28, round(p_mean, 6) AS p_mean FROM preds")
def pivot_predictions(spark, sf):
    return rounded(B.pivot_predictions(long_preds(spark, sf), ["store", "day"], fx.MODELS))


WEIGHTS = [("p_lag1", 0.1), ("p_lag7", 0.2), ("p_nz28", 0.3), ("p_mean", 0.4)]


@query("preds", "SELECT store, day, round((0.1 * p_lag1 + 0.2 * p_lag7 + 0.3 * p_nz28 + 0.4 * p_mean) / (0.1::DOUBLE + 0.2 + 0.3 + 0.4), 6) AS blend, CAST(4 AS BIGINT) AS n_models FROM preds")
def weighted_blend(spark, sf):
    return rounded(B.weighted_blend(long_preds(spark, sf), ["store", "day"], spark.createDataFrame(WEIGHTS, "model string, w double")))


@query("preds", "SELECT store, day, round((0.1 * p_lag1 + 0.2 * p_lag7 + 0.3 * p_nz28) / (0.1::DOUBLE + 0.2 + 0.3), 6) AS blend, CAST(3 AS BIGINT) AS n_models FROM preds")
def blend_columns(spark, sf):
    return rounded(B.blend_columns(fx.ungrouped_preds(spark, sf), fx.MODELS, spark.createDataFrame(WEIGHTS[:3], "model string, w double")).select("store", "day", "blend", "n_models"))


@query("preds", "SELECT store, day, round(0.7 * p_mean + 0.3 * p_nz28, 6) AS pred FROM preds")
def inject(spark, sf):
    return rounded(B.inject(fx.ungrouped_preds(spark, sf), "p_mean", "p_nz28", 0.3, "pred").select("store", "day", "pred"))


ALPHAS = [i / 10 for i in range(11)]


@query("preds", """, a AS (SELECT i / 10.0::DOUBLE AS alpha FROM range(0, 11) r(i)), s AS (SELECT alpha, round(avg(abs(y - ((1 - alpha) * p_mean + alpha * p_nz28))), 6) AS score FROM preds, a GROUP BY alpha)
    SELECT alpha, score, row_number() OVER (ORDER BY score, alpha) = 1 AS best FROM s""")
def alpha_sweep(spark, sf):
    return B.alpha_sweep(fx.ungrouped_preds(spark, sf), "p_mean", "p_nz28", "y", ALPHAS, lambda y, p: F.avg(F.abs(y - p)))


@query("preds", """, k AS (SELECT store, (y - p_mean) / (p_nz28 - p_mean) AS a, abs(p_nz28 - p_mean) AS w FROM preds WHERE p_nz28 <> p_mean),
    c AS (SELECT store, a, sum(w) OVER (PARTITION BY store ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(w) OVER (PARTITION BY store) AS total FROM k),
    m AS (SELECT store, least(greatest(min(a), 0.0), 1.0) AS alpha FROM c WHERE 2 * run >= total GROUP BY store)
    SELECT store, round(any_value(alpha), 6) AS alpha, round(avg(abs(y - ((1 - alpha) * p_mean + alpha * p_nz28))), 6) AS mae, count(*) AS n_scored FROM preds JOIN m USING (store) GROUP BY store""")
def best_alpha(spark, sf):
    return rounded(B.best_alpha(fx.preds(spark, sf), "p_mean", "p_nz28", "y", ["store"], largest=fx.demand_days(spark, sf)))


@query("preds", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a} - y, {b} - y), 6) AS corr FROM preds" for i, a in enumerate(fx.MODELS) for b in fx.MODELS[i + 1 :]))
def prediction_correlation(spark, sf):
    return rounded(B.prediction_correlation(fx.ungrouped_preds(spark, sf), fx.MODELS, "y"))


@query("preds", " UNION ALL ".join(f"SELECT '{c}' AS model, round(corr({c} - p_mean, y - p_mean), 6) AS corr, round(sum(({c} - p_mean) * (y - p_mean)) / nullif(sum(({c} - p_mean) * ({c} - p_mean)), 0), 6) AS alpha FROM preds" for c in fx.MODELS[:3]))
def complement_screen(spark, sf):
    return rounded(B.complement_screen(fx.ungrouped_preds(spark, sf), "p_mean", fx.MODELS[:3], "y"))


@query()
def fit_blend_weights(spark, sf):
    return rounded(B.fit_blend_weights(fx.ungrouped_preds(spark, sf), fx.MODELS, "y"))


@query("preds", "SELECT 'absolute' AS loss, CAST(4 AS BIGINT) AS n_models, true AS sums_to_one, true AS none_negative, true AS no_model_beats_it FROM preds GROUP BY 1")
def blend_weight_facts(spark, sf):
    """What holds of any fitted weights: they are shares, and no single model does better."""
    p = A.stored(fx.ungrouped_preds(spark, sf), "preds")
    alone = p.agg(F.least(*[F.avg(F.abs(F.col("y") - F.col(m))) for m in fx.MODELS]).alias("best"))
    w = B.fit_blend_weights(p, fx.MODELS, "y").agg(F.count(F.lit(1)).alias("n_models"), (F.abs(F.sum("w") - 1) < 1e-9).alias("sums_to_one"), (F.min("w") >= 0).alias("none_negative"), F.max("loss").alias("_loss"))
    return w.join(F.broadcast(alone)).select(F.lit("absolute").alias("loss"), "n_models", "sums_to_one", "none_negative", (F.col("_loss") <= F.col("best") + 1e-9).alias("no_model_beats_it"))


@query("preds", "SELECT store, day, round(y - p_mean, 6) AS residual, round(p_mean + 0.5 * (y - p_mean), 6) AS pred FROM preds")
def residual_stack(spark, sf):
    r = B.residual_target(fx.preds(spark, sf), "y", "p_mean").withColumn("half", 0.5 * F.col("residual"))
    return rounded(B.recompose(r, ["p_mean", "half"]).select("store", "day", "residual", "pred"))


# --- trajectories ---


def _kalman_sql(q=0.01, r=0.1):
    """The filter as a recursive table, one step of t a round; the covariances are the same on all axes."""
    axes, p = "xyz", f"(a + 2 * b + d)"
    k0, k1 = f"({p} / ({p} + {r}))", f"((b + d) / ({p} + {r}))"
    first = ", ".join(f"{c} AS s{c}, 0.0::DOUBLE AS v{c}, NULL::DOUBLE AS e{c}" for c in axes)
    gap = {c: f"(n.{c} - (s{c} + v{c}))" for c in axes}
    step = ", ".join(f"s{c} + v{c} + {k0} * {gap[c]}, v{c} + {k1} * {gap[c]}, {gap[c]}" for c in axes)
    shown = ", ".join(f"round(s{c}, 6) AS {c}_state, round(v{c}, 6) AS {c}_velocity, round(e{c}, 6) AS {c}_innovation" for c in axes)
    return f""", k AS (SELECT traj_id, t, {first}, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d FROM traj WHERE t = 0
      UNION ALL SELECT k.traj_id, n.t, {step}, (1 - {k0}) * {p}, (1 - {k0}) * (b + d), d - {k1} * (b + d) + {q} FROM k JOIN traj n ON n.traj_id = k.traj_id AND n.t = k.t + 1)
    SELECT traj_id, (SELECT count(*) FROM traj o WHERE o.traj_id = k.traj_id) AS n_obs, {shown} FROM k WHERE t = 20"""


@query("traj", _kalman_sql())
def kalman_residual(spark, sf):
    return rounded(T.kalman_residual(fx.traj(spark, sf), "traj_id", "t", ["x", "y", "z"], 0.01, 0.1))


FRENET_SQL = """, a AS (SELECT traj_id, t, x, y, z, lag(x) OVER w lx, lead(x) OVER w rx, lag(y) OVER w ly, lead(y) OVER w ry, lag(z) OVER w lz, lead(z) OVER w rz FROM traj WINDOW w AS (PARTITION BY traj_id ORDER BY t)),
    b AS (SELECT traj_id, t, (rx-lx)/2 vx, (ry-ly)/2 vy, (rz-lz)/2 vz, rx-2*x+lx ax, ry-2*y+ly ay, rz-2*z+lz az FROM a),
    c AS (SELECT *, lead(ax) OVER w - ax jx, lead(ay) OVER w - ay jy, lead(az) OVER w - az jz, vy*az-vz*ay wx, vz*ax-vx*az wy, vx*ay-vy*ax wz, sqrt(vx*vx+vy*vy+vz*vz) speed FROM b WINDOW w AS (PARTITION BY traj_id ORDER BY t)),
    d AS (SELECT *, sqrt(wx*wx+wy*wy+wz*wz) wn FROM c)
    SELECT traj_id, t, round(speed, 6) AS speed, round(vx/nullif(speed,0), 6) AS tx, round(wz/nullif(wn,0), 6) AS bz,
      round((wy/nullif(wn,0))*(vz/nullif(speed,0)) - (wz/nullif(wn,0))*(vy/nullif(speed,0)), 6) AS nx,
      CAST(floor(4 * ln(wn/nullif(speed*speed*speed,0))) AS BIGINT) AS curvature_bucket, CAST(sign((wx*jx+wy*jy+wz*jz)/nullif(wn*wn,0)) AS INTEGER) AS torsion_sign
    FROM d WHERE speed > 0.05 AND wn > 0.0001"""


@query("traj", FRENET_SQL)
def frenet_features(spark, sf):
    f = T.frenet_features(fx.traj(spark, sf), "traj_id", "t", "x", "y", "z").where((F.col("speed") > 0.05) & (F.col("curvature") * F.col("speed") ** 3 > 0.0001))
    return rounded(f.select("traj_id", "t", "speed", "tx", "bz", "nx", F.floor(4 * F.log("curvature")).alias("curvature_bucket"), F.signum("torsion").cast("int").alias("torsion_sign")))


ROTATION_SQL = """, a AS (SELECT traj_id, t, x, y, z, lag(x,1) OVER w - lag(x,2) OVER w dx, lag(y,1) OVER w - lag(y,2) OVER w dy, lag(z,1) OVER w - lag(z,2) OVER w dz,
      x - lag(x,1) OVER w ex, y - lag(y,1) OVER w ey, z - lag(z,1) OVER w ez FROM traj WINDOW w AS (PARTITION BY traj_id ORDER BY t)),
    b AS (SELECT *, dy*ez-dz*ey nx, dz*ex-dx*ez ny, dx*ey-dy*ex nz FROM a), c AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) n FROM b),
    d AS (SELECT *, atan2(n, dx*ex+dy*ey+dz*ez) th FROM c)
    SELECT traj_id, t, round(x + CASE WHEN n > 1e-12 THEN ex*cos(th) + (ny*ez-nz*ey)/n*sin(th) ELSE ex END, 6) AS next_x,
      round(y + CASE WHEN n > 1e-12 THEN ey*cos(th) + (nz*ex-nx*ez)/n*sin(th) ELSE ey END, 6) AS next_y,
      round(z + CASE WHEN n > 1e-12 THEN ez*cos(th) + (nx*ey-ny*ex)/n*sin(th) ELSE ez END, 6) AS next_z FROM d"""


@query("traj", ROTATION_SQL)
def rotation_extrapolate(spark, sf):
    return rounded(T.rotation_extrapolate(fx.traj(spark, sf), "traj_id", "t", "x", "y", "z"))


@query("traj", """, a AS (SELECT traj_id, t, list(x) OVER f AS h, lead(x, 2) OVER (PARTITION BY traj_id ORDER BY t) AS l FROM traj WINDOW f AS (PARTITION BY traj_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT traj_id, t, h[1] AS oldest, h[5] AS newest, l AS x_label FROM a WHERE len(h) = 5 AND l IS NOT NULL""")
def sequence_windows(spark, sf):
    s = T.sequence_windows(fx.traj(spark, sf), "traj_id", "t", ["x"], 5, 2)
    return s.select("traj_id", "t", F.element_at("x_history", 1).alias("oldest"), F.element_at("x_history", 5).alias("newest"), "x_label")


# --- weather ---


@query(sql="""SELECT t.user_id, t.event_id, CAST(t.ts AS TIMESTAMP) AS ts, i.value AS issued_value FROM (SELECT * FROM events WHERE event_type = 'view') t
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') i ON t.user_id = i.user_id AND t.ts >= i.ts""")
def asof_issue(spark, sf):
    e = fx.table(spark, sf, "events")
    views, bought = e.where("event_type = 'view'"), e.where("event_type = 'purchase'").withColumn("issue", F.col("ts"))
    return W.asof_issue(views, bought, "user_id", "ts", "issue", "value", "event_id").select("user_id", "event_id", "ts", "issued_value")


@query("wxfield", """, w AS (SELECT cell, valid_day, max(CASE WHEN src='A' THEN u END) AS "u_A", max(CASE WHEN src='A' THEN v END) AS "v_A", max(CASE WHEN src='B' THEN u END) AS "u_B", max(CASE WHEN src='B' THEN v END) AS "v_B" FROM wxfield GROUP BY 1, 2)
    SELECT cell, valid_day, round("u_A",6) AS "u_A", round("v_A",6) AS "v_A", round("u_B",6) AS "u_B", round("v_B",6) AS "v_B", round("u_B"-"u_A",6) AS "u_B_diff", round("v_B"-"v_A",6) AS "v_B_diff" FROM w""")
def align_sources(spark, sf):
    return rounded(W.align_sources(fx.wxfield(spark, sf), "cell", "valid_day", ["A", "B"], ["u", "v"]))


GRID_SQL = """, d AS (SELECT site, cell, sqrt((sy-gy)*(sy-gy)+(sx-gx)*(sx-gx)) AS d FROM sites, grid), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, cell) AS n FROM d),
    m AS (SELECT *, min(d) OVER (PARTITION BY site) AS m FROM k WHERE n <= 4), w AS (SELECT site, cell, CASE WHEN m = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / (d * d) END AS weight FROM m)
    SELECT site, src, valid_day, round(sum(weight*u)/sum(weight), 6) AS u, round(sum(weight*v)/sum(weight), 6) AS v, count(*) AS n_cells FROM wxfield JOIN w USING (cell) WHERE weight > 0 GROUP BY 1, 2, 3"""


@query("sites grid wxfield", GRID_SQL)
def grid_to_site(spark, sf):
    return rounded(W.grid_to_site(fx.sites(spark, sf), fx.grid(spark, sf), fx.wxfield(spark, sf), 4, 2.0, ["u", "v"], ["src", "valid_day"]))


@query("sites grid wxfield", """, n AS (SELECT site, cell, gy, gx FROM sites, grid WHERE sqrt((sy-gy)*(sy-gy)+(sx-gx)*(sx-gx)) <= 1.5)
    SELECT site, src, round(avg(u),6) AS mean, round(stddev_pop(u),6) AS spread, round(min(u),6) AS least, round(max(u),6) AS greatest, round(regr_slope(u, gy),6) AS slope_y, round(regr_slope(u, gx),6) AS slope_x
    FROM wxfield JOIN n USING (cell) GROUP BY 1, 2""")
def field_stats(spark, sf):
    return rounded(W.field_stats(fx.sites(spark, sf), fx.grid(spark, sf), fx.wxfield(spark, sf), 1.5, "u", ["src"]))


@query("places stations", """, d AS (SELECT site, cell, sqrt((sy-gy)*(sy-gy)+(sx-gx)*(sx-gx)) AS d FROM places, stations), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, cell) AS n FROM d)
    SELECT site, cell, round(CASE WHEN m = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / (d * d) END, 6) AS weight FROM (SELECT *, min(d) OVER (PARTITION BY site) AS m FROM k WHERE n <= 5) WHERE m > 0 OR d = 0""")
def nearest_stations(spark, sf):
    return rounded(W.cell_weights(fx.places(spark, sf), fx.stations(spark, sf), 5, 2.0))


@query("places stations", """, n AS (SELECT site, seg, u, gy, gx FROM places, stations WHERE sqrt((sy-gy)*(sy-gy)+(sx-gx)*(sx-gx)) <= 30)
    SELECT site, seg, round(avg(u),6) AS mean, round(stddev_pop(u),6) AS spread, round(min(u),6) AS least, round(max(u),6) AS greatest, round(regr_slope(u, gy),6) AS slope_y, round(regr_slope(u, gx),6) AS slope_x FROM n GROUP BY 1, 2""")
def station_stats(spark, sf):
    s = fx.stations(spark, sf)
    return rounded(W.field_stats(fx.places(spark, sf), s, s.select("cell", "seg", "u"), 30.0, "u", ["seg"]))


@query("wxfield", """, s AS (SELECT *, sqrt(u*u+v*v) AS speed FROM wxfield)
    SELECT src, cell, valid_day, round(speed,6) AS speed, round(v/nullif(speed,0),6) AS dir_sin, round(u/nullif(speed,0),6) AS dir_cos, round(speed*speed*speed,6) AS speed3,
      round(speed*pow(10.0::DOUBLE, 0.143),6) AS speed_hub, round(0.5*(101325.0/(287.05*(288.15+v)))*speed*speed*speed,6) AS power_density FROM s""")
def wind_physics(spark, sf):
    f = fx.wxfield(spark, sf).withColumn("temp", 288.15 + F.col("v")).withColumn("pressure", F.lit(101325.0))
    return rounded(W.wind_physics(f, "u", "v", "temp", "pressure").drop("u", "v", "temp", "pressure"))


# --- validation and models ---


@query("delay", """, s AS (SELECT delay, CASE WHEN CAST(l_shipdate AS DATE) < DATE '1998-12-25' THEN 'train' WHEN CAST(l_shipdate AS DATE) >= DATE '1999-01-01' AND CAST(l_shipdate AS DATE) < DATE '2000-01-01' THEN 'valid' END AS split FROM delay)
    SELECT split, count(*) AS n, round(avg(delay), 6) AS mean FROM s GROUP BY split""")
def time_split(spark, sf):
    return rounded(G.time_split(fx.delay(spark, sf), "l_shipdate", "1999-01-01", "2000-01-01", 7).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("delay").alias("mean")))


FOLDS = ["1998-01-01", "1999-01-01", "2000-01-01"]


@query("delay", """, f AS (SELECT * FROM (VALUES (0, DATE '1998-01-01', DATE '1999-01-01'), (1, DATE '1999-01-01', DATE '2000-01-01')) v(fold, a, b))
    SELECT fold, CASE WHEN CAST(l_shipdate AS DATE) < a THEN 'train' ELSE 'valid' END AS split, count(*) AS n, round(avg(delay), 6) AS mean FROM delay JOIN f ON CAST(l_shipdate AS DATE) < b GROUP BY 1, 2""")
def rolling_origin(spark, sf):
    return rounded(G.rolling_origin(fx.delay(spark, sf), "l_shipdate", FOLDS).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("delay").alias("mean")))


def _features(spark, sf):
    return fx.delay(spark, sf).withColumn("month", F.month("l_shipdate")).withColumn("year", F.year("l_shipdate"))


FEATURES = ["month", "year", "l_quantity"]


def _trees(df):
    return G.fit_gbt(df, FEATURES, "delay", "absolute", depth=3, iters=3)


@query()
def fit_gbt(spark, sf):
    split = G.time_split(_features(spark, sf), "l_shipdate", "1999-01-01", "2000-01-01")
    return _trees(split.where("split = 'train'")).transform(split.where("split = 'valid'")).select("l_orderkey", "l_linenumber", "delay", F.round("pred", 6).alias("pred"))


def _mean_trees(df):
    return G.fit_gbt(df, FEATURES, "delay", "squared", depth=3, iters=3)


VALID = "CAST(l_shipdate AS DATE) >= DATE '1999-01-01' AND CAST(l_shipdate AS DATE) < DATE '2000-01-01'"


def _facts(scored, train, keys=()):
    """Rows, predictions, and whether their mean squared error is below that of the training rows' mean (no group is without training rows)."""
    mean = train.groupBy(*keys).agg(F.avg("delay").alias("_mean")) if keys else train.agg(F.avg("delay").alias("_mean"))
    both = scored.join(F.broadcast(mean), list(keys)) if keys else scored.withColumn("_mean", F.lit(mean.first()[0]))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("n_pred"), (F.avg((F.col("delay") - F.col("pred")) ** 2) < F.avg((F.col("delay") - F.col("_mean")) ** 2)).alias("beats_mean"))


@query("delay", f"SELECT count(*) AS n, count(*) AS n_pred, true AS beats_mean FROM delay WHERE {VALID}")
def fit_gbt_facts(spark, sf):
    split = A.stored(G.time_split(_features(spark, sf), "l_shipdate", "1999-01-01", "2000-01-01"), "split")
    train = split.where("split = 'train'")
    return _facts(_mean_trees(train).transform(split.where("split = 'valid'")), train)


@query("delay", f"SELECT count(*) AS n, count(*) AS n_pred, true AS beats_mean, true AS as_before_saving FROM delay WHERE {VALID}")
def score_model_facts(spark, sf):
    split = A.stored(G.time_split(_features(spark, sf), "l_shipdate", "1999-01-01", "2000-01-01"), "split")
    train, valid, path = split.where("split = 'train'"), split.where("split = 'valid'"), A.scratch(spark, "model")
    fitted = G.fit_and_save(train, path, FEATURES, "delay", loss="squared", depth=3, iters=3)
    both = G.score_model(fitted.transform(valid).drop("_features").withColumnRenamed("pred", "_was"), path)
    return _facts(both, train).join(both.agg(F.min(F.col("pred") == F.col("_was")).alias("as_before_saving")))


@query("delay", """, f AS (SELECT * FROM (VALUES (0, DATE '1998-01-01', DATE '1999-01-01'), (1, DATE '1999-01-01', DATE '2000-01-01')) v(fold, a, b))
    SELECT fold, count(*) AS n, count(*) AS n_pred, true AS beats_mean FROM delay JOIN f ON CAST(l_shipdate AS DATE) >= a AND CAST(l_shipdate AS DATE) < b GROUP BY fold""")
def oof_facts(spark, sf):
    folds = A.stored(G.rolling_origin(_features(spark, sf), "l_shipdate", FOLDS), "folds")
    return _facts(G.oof_predictions(folds, [0, 1], _mean_trees), folds.where("split = 'train'"), ["fold"])


@query()
def oof_predictions(spark, sf):
    folds = G.rolling_origin(_features(spark, sf), "l_shipdate", FOLDS)
    return G.oof_predictions(folds, [0, 1], _trees).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(M.mae_of("delay", "pred"), 6).alias("mae"))


# --- tables ---


@query(sql="SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def read_table(spark, sf):
    path = f"{sf}/supplier.parquet"
    return A.read_table(spark, path, spark.read.parquet(path).schema)


@query("demand", """, f AS (SELECT store, day, lag(qty, 1) OVER w AS a, lag(qty, 7) OVER w AS b, avg(qty) OVER (PARTITION BY store ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c,
      avg(CASE WHEN qty > 0 THEN qty END) OVER (PARTITION BY store ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS p FROM demand WINDOW w AS (PARTITION BY store ORDER BY day))
    SELECT store, day, round(CASE WHEN a IS NULL OR b IS NULL OR c IS NULL OR p IS NULL THEN -1.0 ELSE p END, 6) AS pred FROM f""")
def make_submission(spark, sf):
    # preds lacks each store's first days by itself
    p = fx.preds(spark, sf).select("store", "day", F.col("p_nz28").alias("pred"))
    return rounded(A.make_submission(fx.demand(spark, sf).select("store", "day"), p, ["store", "day"], -1.0))


@query("preds", """, a AS (SELECT store, day, p_mean AS pred FROM preds WHERE p_lag1 > 0), b AS (SELECT store, day, p_nz28 AS pred FROM preds WHERE p_lag7 > 0),
    j AS (SELECT a.pred AS pa, b.pred AS pb, a.store AS sa, b.store AS sb FROM a FULL JOIN b ON a.store = b.store AND a.day = b.day)
    SELECT CASE WHEN sa IS NULL THEN 'missing' WHEN sb IS NULL THEN 'extra' WHEN abs(pa - pb) <= 5 THEN 'same' ELSE 'changed' END AS kind, count(*) AS n, round(max(abs(pa - pb)), 6) AS max_gap FROM j GROUP BY 1""")
def diff_submissions(spark, sf):
    # written once, as both submissions read it
    p = A.stored(fx.preds(spark, sf).where("p_lag1 > 0 or p_lag7 > 0").select("store", "day", "p_lag1", "p_lag7", "p_mean", "p_nz28"), "preds")
    # two models that each answer only after a day with demand
    a, b = p.where("p_lag1 > 0").withColumn("pred", F.col("p_mean")), p.where("p_lag7 > 0").withColumn("pred", F.col("p_nz28"))
    return rounded(A.diff_submissions(a, b, ["store", "day"], 5.0))


@query(sql="""SELECT event_type, event_id, value, max(value) OVER w AS best, round(value - max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS gain_on_best,
    round(value - first_value(value) OVER w, 6) AS gain_on_first FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def score_ledger(spark, sf):
    e = fx.table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    return A.score_ledger(e, "event_type", ["ts", "event_id"], "value", True).select("event_type", "event_id", "value", "best", F.round("gain_on_best", 6).alias("gain_on_best"), F.round("gain_on_first", 6).alias("gain_on_first"))


@query(sql="""SELECT event_type, user_id, best, rank() OVER (PARTITION BY event_type ORDER BY best DESC) AS rank, round(100.0 * rank() OVER (PARTITION BY event_type ORDER BY best DESC) / count(*) OVER (PARTITION BY event_type), 6) AS top_percent
    FROM (SELECT event_type, user_id, max(value) AS best FROM events GROUP BY 1, 2)""")
def leaderboard(spark, sf):
    return rounded(A.leaderboard(fx.table(spark, sf, "events"), "event_type", "user_id", "value", True))


@query("demand", "SELECT store, day, qty FROM demand")
def write_cache(spark, sf):
    path = A.scratch(spark, "demand")
    A.write_cache(fx.demand(spark, sf).withColumn("part", F.col("store") % 10), path, ["part"])
    return spark.read.parquet(path).select("store", "day", "qty")


@query("demand", "SELECT d.store, d.day, d.qty, t.total, round(avg(d.qty) OVER (PARTITION BY d.store ORDER BY d.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS week FROM demand d JOIN (SELECT store, sum(qty) AS total FROM daily GROUP BY store) t ON t.store = d.store")
def bucketed_cache(spark, sf):
    """Two tables in the same buckets: a grouping, their join and a window by store find the rows where they lie."""
    name = lambda what: f"millrace_{what}_{A.scratch(spark, what)[-32:]}"
    # a bucket is a task, so there are the more of them the more rows
    buckets = max(16, D.dense_parts(fx.sales(spark, sf), ["store"], "day")[2])
    dense = A.write_bucketed(fx.demand(spark, sf), name("demand"), ["store"], ["day"], buckets, A.scratch(spark, "demand"))
    sold = A.write_bucketed(fx.daily(spark, sf), name("daily"), ["store"], ["day"], buckets, A.scratch(spark, "daily"))
    both = dense.join(sold.groupBy("store").agg(F.sum("qty").alias("total")).hint("merge"), "store")
    return rounded(both.withColumn("week", F.avg("qty").over(Window.partitionBy("store").orderBy("day").rowsBetween(-6, 0))))


@query("preds", """, a AS (SELECT store, day, round(p_nz28, 6) AS pred FROM preds), b AS (SELECT store, day, CASE WHEN store % 50 = 7 THEN pred + 0.5 ELSE pred END AS pred FROM a WHERE NOT (store % 50 = 9 AND pred > 26)),
    j AS (SELECT a.pred AS pa, b.pred AS pb, b.store AS sb FROM a LEFT JOIN b ON a.store = b.store AND a.day = b.day)
    SELECT CASE WHEN sb IS NULL THEN 'extra' WHEN abs(pa - pb) <= 0.1 THEN 'same' ELSE 'changed' END AS kind, CAST(count(*) AS BIGINT) AS n, round(max(abs(pa - pb)), 6) AS max_gap FROM j GROUP BY 1""")
def diff_by_fingerprint(spark, sf):
    """A stored submission against one rebuilt with a few stores changed and a few rows lost."""
    a = A.stored(fx.preds(spark, sf).select("store", "day", F.round("p_nz28", 6).alias("pred")), "recorded")
    changed = a.where("not (store % 50 = 9 and pred > 26)").withColumn("pred", F.when(F.col("store") % 50 == 7, F.col("pred") + 0.5).otherwise(F.col("pred")))
    return rounded(A.diff_by_fingerprint(a, A.stored(changed, "rebuilt"), ["store", "day"], 0.1))


@query()
def score_model(spark, sf):
    split = G.time_split(_features(spark, sf), "l_shipdate", "1999-01-01", "2000-01-01")
    path = A.scratch(spark, "model")
    G.fit_and_save(split.where("split = 'train'"), path, FEATURES, "delay", loss="squared", depth=3, iters=3)
    return G.score_model(split.where("split = 'valid'"), path).select("l_orderkey", "l_linenumber", "delay", F.round("pred", 6).alias("pred"))
