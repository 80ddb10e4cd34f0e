"""Trajectory operators: Kalman residuals, Frenet frames, rotation steps and sequence windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ranges import BLOCK_ROWS, in_blocks, longest_series

#: Steps of a trajectory that one task filters in turn.
STEP_ROWS = 1 << 16

Vector = tuple[Column, Column, Column]


def _cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def kalman_residual(df: DataFrame, id_: str, t: str, cols: Sequence[str], q: float, r: float, rows: int = STEP_ROWS) -> DataFrame:
    """Final state (x, v) and last innovation of a constant-velocity Kalman filter per axis and trajectory.

    The state starts at the first observation with no velocity and unit covariance;
    each further observation predicts, updates, then adds q to the velocity's
    variance. A null reading predicts only (its innovation is null); an axis without any
    reading stays null. A trajectory of up to ``rows`` rows is folded as one array; of
    longer ones the last of kalman_steps is taken.
    """
    names = [f"{c}_{x}" for c in cols for x in ("state", "velocity", "innovation")]
    if longest_series(df, [id_]) <= rows:
        return _folded(df, id_, t, cols, q, r)
    size = df.groupBy(F.col(id_).alias("_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    same = F.col(id_).eqNullSafe(F.col("_id"))
    last = F.max_by(F.struct(*names), F.col(t)).alias("_last")
    long = kalman_steps(df.join(size, same, "left_semi"), id_, t, cols, q, r, rows).groupBy(id_).agg(F.count(F.lit(1)).alias("n_obs"), last)
    return _folded(df.join(size, same, "left_anti"), id_, t, cols, q, r).unionByName(long.select(id_, "n_obs", *[F.col(f"_last.{n}").alias(n) for n in names]))


def _folded(df: DataFrame, id_: str, t: str, cols: Sequence[str], q: float, r: float) -> DataFrame:
    seq = F.sort_array(F.collect_list(F.struct(F.col(t), *[F.col(c).cast("double").alias(c) for c in cols])))
    grouped = df.groupBy(id_).agg(seq.alias("_seq"), F.count(F.lit(1)).alias("n_obs"))
    out = [id_, "n_obs"]
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("x"), F.lit(0.0).alias("v"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("d"), none.alias("e"))

    def reading(c: str):
        def step(s, o):
            x, a, b, d = s["x"] + s["v"], s["a"] + 2 * s["b"] + s["d"], s["b"] + s["d"], s["d"]
            e, total = o[c] - x, a + r
            k0, k1 = a / total, b / total
            first = F.struct(o[c].alias("x"), s["v"].alias("v"), s["a"].alias("a"), s["b"].alias("b"), s["d"].alias("d"), none.alias("e"))
            predicted = F.struct(x.alias("x"), s["v"].alias("v"), a.alias("a"), b.alias("b"), (d + q).alias("d"), none.alias("e"))
            updated = F.struct((x + k0 * e).alias("x"), (s["v"] + k1 * e).alias("v"), ((1 - k0) * a).alias("a"), ((1 - k0) * b).alias("b"), (d - k1 * b + q).alias("d"), e.alias("e"))
            return F.when(s["x"].isNull(), first).when(o[c].isNull(), predicted).otherwise(updated)

        return step

    for c in cols:
        grouped = grouped.withColumn(f"_{c}", F.aggregate("_seq", start, reading(c)))
        out += [F.col(f"_{c}")["x"].alias(f"{c}_state"), F.col(f"_{c}")["v"].alias(f"{c}_velocity"), F.col(f"_{c}")["e"].alias(f"{c}_innovation")]
    return grouped.select(*out)


#: A stretch of filter steps as a function of the state before it: A, b, C of the state after it, eta, J of what its readings say of the one before.
Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _steps(readings: np.ndarray, q: float, r: float) -> Element:
    """An element for each step: predict, update by the reading (NaN: none), add q to the velocity's variance."""
    n, seen = len(readings), ~np.isnan(readings)
    known = np.where(seen, readings, 0.0)[:, None] * np.array([1.0, 1.0]) / r
    one = lambda m: np.repeat(np.array(m, float)[None], n, 0)
    return one([[1, 1], [0, 1]]), np.zeros((n, 2)), one([[0, 0], [0, q]]), known, one([[1, 1], [1, 1]]) * seen[:, None, None] / r


def _then(e: Element, f: Element) -> Element:
    """The elements of e, each followed by that of f; associative, so stretches may be put together in any grouping."""
    (a, b, c, eta, j), (a2, b2, c2, eta2, j2) = e, f
    turned = lambda m: np.swapaxes(m, -1, -2)
    on = lambda m, v: (m @ v[..., None])[..., 0]
    d = np.linalg.inv(np.eye(2) + c @ j2)
    ahead, back = a2 @ d, turned(a) @ turned(d)
    return ahead @ a, on(ahead, b + on(c, eta2)) + b2, ahead @ c @ turned(a2) + c2, on(back, eta2 - on(j2, b)) + eta, back @ j2 @ a + j


def _whole(e: Element) -> Element:
    """The element of all steps, put together in pairs, pairs of pairs and so on."""
    n = len(e[0])
    if not n:
        return np.eye(2)[None], np.zeros((1, 2)), np.zeros((1, 2, 2)), np.zeros((1, 2)), np.zeros((1, 2, 2))
    while n > 1:
        even = _then(tuple(x[0 : n - 1 : 2] for x in e), tuple(x[1:n:2] for x in e))
        e = even if n % 2 == 0 else tuple(np.concatenate([x, y[n - 1 :]]) for x, y in zip(even, e))
        n = len(e[0])
    return e


def _carried_states(blocks: DataFrame, id_: str, t: str, cols: Sequence[str], q: float, r: float) -> DataFrame:
    """(_group, __part, _<col> as x, v and covariance a, b, d): the filter's state before each block, null if it hasn't started.

    A block's task sums it up as one element per axis, twice where the axis may start
    in it; a trajectory's elements, one row a block, are then applied one after another.
    """
    kind = f"`{id_}` {blocks.schema[id_].dataType.simpleString()}, _block long"

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(t, kind="stable")
        out = {id_: [group[id_].iloc[0]], "_block": [group["_block"].iloc[0]]}
        for c in cols:
            y = group[c].to_numpy(float)
            seen = np.flatnonzero(~np.isnan(y))
            first = int(seen[0]) + 1 if len(seen) else len(y)
            after = _whole(_steps(y[first:], q, r))
            whole = _then(_whole(_steps(y[:first], q, r)), after)
            starts = [y[first - 1]] if len(seen) else []
            out[c] = [np.concatenate([*(np.ravel(x) for x in (*whole, *after)), starts])]
        return pd.DataFrame(out)

    def scanned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_block")
        out = {"_group": group[id_], "__part": group["_block"]}
        for c in cols:
            states, state = [], None
            for packed in group[c]:
                states.append(None if state is None else [*state[0], state[1][0, 0], state[1][0, 1], state[1][1, 1]])
                whole, after, starts = packed[:16], packed[16:32], packed[32:]
                if state is not None:
                    state = _applied(state, whole)
                elif len(starts):
                    state = _applied((np.array([starts[0], 0.0]), np.eye(2)), after)
            out[f"_{c}"] = states
        return pd.DataFrame(out)

    elements = blocks.groupBy(id_, "_block").applyInPandas(summed, ", ".join([kind, *[f"`{c}` array<double>" for c in cols]]))
    kind = f"_group {blocks.schema[id_].dataType.simpleString()}, __part long"
    return elements.groupBy(id_).applyInPandas(scanned, ", ".join([kind, *[f"`_{c}` array<double>" for c in cols]]))


def _applied(state: tuple[np.ndarray, np.ndarray], packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, p = state
    a, b, c, eta, j = np.split(np.asarray(packed), (4, 6, 10, 12))
    a, c, j = (x.reshape(2, 2) for x in (a, c, j))
    ahead = a @ np.linalg.inv(np.eye(2) + p @ j)
    return ahead @ (m + p @ eta) + b, ahead @ p @ a.T + c


def kalman_steps(df: DataFrame, id_: str, t: str, cols: Sequence[str], q: float, r: float, rows: int = STEP_ROWS) -> DataFrame:
    """(id, t, <col>_state, <col>_velocity, <col>_innovation) at every step of the filter of kalman_residual; r must be above 0.

    A trajectory of more than ``rows`` rows is cut into blocks. Each block is summed up
    as one element of an associative scan, which gives the state that every block
    starts from; then all blocks are filtered at once. So no task holds more than a
    block's rows, or one row per block of a trajectory.
    """
    if not r > 0:
        raise ValueError("the readings' variance r must be above 0")
    names = [f"{c}_{x}" for c in cols for x in ("state", "velocity", "innovation")]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_, t)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(t, kind="stable")
        out = {id_: group[id_], t: group[t]}
        for c in cols:
            carried = group[f"_{c}"].iloc[0] if f"_{c}" in group else None
            x, v, a, b, d = (None, 0.0, 1.0, 0.0, 1.0) if carried is None else map(float, carried)
            steps = []
            for o in group[c].astype(float):
                e = None
                if x is None:
                    x = None if o != o else o
                else:
                    x, a, b = x + v, a + 2 * b + d, b + d
                    if o == o:
                        e, k0, k1 = o - x, a / (a + r), b / (a + r)
                        x, v, a, b, d = x + k0 * e, v + k1 * e, (1 - k0) * a, (1 - k0) * b, d - k1 * b
                    d += q
                steps.append((x, v, e))
            out |= {f"{c}_{name}": pd.array([s[i] for s in steps], "Float64") for i, name in enumerate(("state", "velocity", "innovation"))}
        return pd.DataFrame(out)

    narrow = df.select(id_, t, *cols)
    shown = ", ".join([*kinds, *[f"`{n}` double" for n in names]])
    if longest_series(narrow, [id_]) <= rows:
        return narrow.groupBy(id_).applyInPandas(run, shown)
    blocks = stored(in_blocks(narrow, [id_], [t], rows=rows).drop("_guest"), "blocks")
    several = blocks.where("_block > 0").select(F.col(id_).alias("_id")).distinct()
    states = _carried_states(blocks.join(several, F.col(id_).eqNullSafe(F.col("_id")), "left_semi"), id_, t, cols, q, r)
    return blocks.join(states, F.col(id_).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("__part")), "left").drop("_group", "__part").groupBy(id_, "_block").applyInPandas(run, shown)


def frenet_features(df: DataFrame, id_: str, t: str, x: str, y: str, z: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Speed, unit tangent, normal and binormal, curvature and torsion by central differences; null at the ends and where undefined.

    Trajectories of more than ``rows`` rows are windowed in blocks (ranges.in_blocks).
    """
    df = in_blocks(df.select(id_, t, x, y, z), [id_], [t], 1, 2, rows)
    by = Window.partitionBy(id_, "_block").orderBy(t)
    p = [F.col(c) for c in (x, y, z)]
    v = tuple((F.lead(c).over(by) - F.lag(c).over(by)) / 2 for c in p)
    a = tuple(F.lead(c).over(by) - 2 * c + F.lag(c).over(by) for c in p)
    stage = df.select(id_, t, "_block", "_guest", *[e.alias(f"_v{i}") for i, e in enumerate(v)], *[e.alias(f"_a{i}") for i, e in enumerate(a)])
    stage = stage.select("*", *[(F.lead(f"_a{i}").over(by) - F.col(f"_a{i}")).alias(f"_j{i}") for i in range(3)]).where(~F.col("_guest"))
    v, a, j = (tuple(F.col(f"_{n}{i}") for i in range(3)) for n in "vaj")
    w = _cross(v, a)
    stage = stage.withColumns({"speed": F.sqrt(_dot(v, v)), "_w": F.sqrt(_dot(w, w)), **{f"_w{i}": w[i] for i in range(3)}})
    speed, wn, w = F.col("speed"), F.col("_w"), tuple(F.col(f"_w{i}") for i in range(3))
    stage = stage.withColumns({**{f"t{n}": F.try_divide(c, speed) for n, c in zip("xyz", v)}, **{f"b{n}": F.try_divide(c, wn) for n, c in zip("xyz", w)}})
    normal = _cross(tuple(F.col(f"b{n}") for n in "xyz"), tuple(F.col(f"t{n}") for n in "xyz"))
    stage = stage.withColumns({f"n{n}": c for n, c in zip("xyz", normal)})
    return stage.select(id_, t, "speed", *[f"{f}{n}" for f in "tnb" for n in "xyz"], F.try_divide(wn, speed * speed * speed).alias("curvature"), F.try_divide(_dot(w, j), wn * wn).alias("torsion"))


def rotation_extrapolate(df: DataFrame, id_: str, t: str, x: str, y: str, z: str, steps: int = 1, rows: int = BLOCK_ROWS) -> DataFrame:
    """Position ``steps`` ahead of each row: the last displacement, turned on by the last turn; straight on if there is no turn.

    Rodrigues' formula around the axis of the last two displacements; rows without two
    displacements before them give null. Trajectories of more than ``rows`` rows are
    windowed in blocks.
    """
    cols = (x, y, z)
    df = in_blocks(df.select(id_, t, *cols), [id_], [t], 2, 0, rows)
    by = Window.partitionBy(id_, "_block").orderBy(t)
    stage = df.select(id_, t, "_guest", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(cols)], *[(F.lag(c, 1).over(by) - F.lag(c, 2).over(by)).alias(f"_d{i}") for i, c in enumerate(cols)], *[(F.col(c) - F.lag(c, 1).over(by)).alias(f"_e{i}") for i, c in enumerate(cols)]).where(~F.col("_guest"))
    d, e, at = (tuple(F.col(f"_{n}{i}") for i in range(3)) for n in "dep")
    n = _cross(d, e)
    size, turn = F.sqrt(_dot(n, n)), None
    stage = stage.withColumns({"_n": size, "_turn": F.atan2(size, _dot(d, e)), **{f"_n{i}": n[i] for i in range(3)}})
    size, turn = F.col("_n"), F.col("_turn")
    axis = tuple(F.try_divide(F.col(f"_n{i}"), size) for i in range(3))
    side = _cross(axis, e)
    ahead = []
    for i in range(3):
        moves = [F.when(size > 1e-12, e[i] * F.cos(turn * k) + side[i] * F.sin(turn * k)).otherwise(e[i]) for k in range(1, steps + 1)]
        ahead.append((at[i] + sum(moves[1:], moves[0])).alias(f"next_{cols[i]}"))
    return stage.select(id_, t, *ahead)


def sequence_windows(df: DataFrame, id_: str, t: str, cols: Sequence[str], length: int, horizon: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """The last ``length`` values of each column with the values ``horizon`` rows ahead; only full windows with a label.

    A window with a null value isn't full, one whose label is null has none. Series of
    more than ``rows`` rows are windowed in blocks.
    """
    blocks = in_blocks(df.select(id_, t, *cols), [id_], [t], length - 1, horizon, rows)
    by = Window.partitionBy(id_, "_block").orderBy(t)
    frame = by.rowsBetween(-(length - 1), 0)
    out = blocks.select(id_, t, "_guest", *[F.collect_list(c).over(frame).alias(f"{c}_history") for c in cols], *[F.lead(c, horizon).over(by).alias(f"{c}_label") for c in cols])
    full = [F.size(f"{c}_history") == length for c in cols] + [F.col(f"{c}_label").isNotNull() for c in cols]
    for f in full:
        out = out.where(f)
    return out.where(~F.col("_guest")).drop("_guest")
