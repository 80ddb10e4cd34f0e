"""Operators on prediction sets: pivoting, blending, injection, screening, weight fitting, residual stacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ranged, stored, with_part


def pivot_predictions(long: DataFrame, key: Sequence[str], models: Sequence[str]) -> DataFrame:
    """A column per model, in one grouping by key: a pivot would group by (key, model) first, as many groups as long rows."""
    return long.groupBy(*key).agg(*[F.first(F.when(F.col("model") == m, F.col("pred")), ignorenulls=True).alias(m) for m in models])


def weighted_blend(long: DataFrame, key: Sequence[str], weights: DataFrame, renorm: bool = True) -> DataFrame:
    """Weighted sum of each key's predictions by (model, w); with ``renorm`` over the weights of the models present.

    A key none of whose models has both a weight and a prediction stays, with a null blend of 0 models.
    The weights, a few rows, are broadcast: to be joined by model, all long rows would go to one task a model.
    """
    has = F.col("pred").isNotNull() & F.col("w").isNotNull()
    total, present = F.sum(F.when(has, F.col("w") * F.col("pred"))), F.sum(F.when(has, F.col("w")))
    return long.join(F.broadcast(weights.select("model", "w")), "model", "left").groupBy(*key).agg((F.try_divide(total, present) if renorm else total).alias("blend"), F.count(F.when(has, 1)).alias("n_models"))


def blend_columns(wide: DataFrame, models: Sequence[str], weights: DataFrame, renorm: bool = True) -> DataFrame:
    """weighted_blend of a wide table, whose models are columns: the columns given and blend and n_models, without moving a row.

    The weights, one a model, are read first. A model without one counts for nothing; of
    several rows of a model the weights add up.
    """
    given = weights.where(F.col("model").isin(list(models)) & F.col("w").isNotNull()).groupBy("model").agg(F.sum("w").alias("w"))
    w = {r["model"]: r["w"] for r in given.collect()}
    zero, there = F.lit(0.0), {m: F.col(m).isNotNull() for m in models if m in w}
    total = sum((F.when(has, w[m] * F.col(m)).otherwise(zero) for m, has in there.items()), zero)
    present = sum((F.when(has, w[m]).otherwise(zero) for m, has in there.items()), zero)
    n = sum((has.cast("long") for has in there.values()), F.lit(0).cast("long"))
    return wide.withColumns({"blend": F.when(n > 0, F.try_divide(total, present) if renorm else total), "n_models": n})


def inject(df: DataFrame, base: str, new: str, alpha: float, out: str) -> DataFrame:
    return df.withColumn(out, (1 - alpha) * F.col(base) + alpha * F.col(new))


def alpha_sweep(df: DataFrame, base: str, new: str, y: str, alphas: Sequence[float], metric: Callable[[Column, Column], Column], higher_is_better: bool = False) -> DataFrame:
    """Curve of a metric over injections (1 - a) * base + a * new, in one aggregate; ``best`` marks the best, of ties the least a."""
    blended = [metric(F.col(y), (1 - a) * F.col(base) + a * F.col(new)).alias(f"s{i}") for i, a in enumerate(alphas)]
    curve = df.agg(*blended).select(F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.round(f"s{i}", 6).alias("score")) for i, a in enumerate(alphas)])).alias("p")).select("p.*")
    order = F.desc("score") if higher_is_better else F.asc("score")
    top = curve.orderBy(order, "alpha").limit(1).select(F.col("alpha").alias("_best"))
    return curve.join(F.broadcast(top)).select("alpha", "score", (F.col("alpha") == F.col("_best")).alias("best"))


def best_alpha(df: DataFrame, base: str, new: str, y: str, by: Sequence[str] = (), low: float | None = 0.0, high: float | None = 1.0, task_rows: int = 1 << 20, largest: int | None = None) -> DataFrame:
    """The injection a with the least mean |y - ((1 - a) * base + a * new)|, exactly: (by..., alpha, mae, n_scored).

    The loss is convex and piecewise linear in a, with a kink of weight |new - base| where
    a row is met exactly, at a = (y - base) / (new - base). Its minimum is the weighted
    median of the kinks, of a flat stretch the least a, moved into [low, high] (null: no
    bound). Groups of at most ``task_rows`` rows are windowed where they lie, in one pass.
    Are there larger ones, weights are added up per kink, sorted into ranges and summed
    range by range; each range takes over the weight of those before it, so no group is
    one task. ``largest``, a bound of a group's rows where one is known, saves counting
    them. Rows with a null count for nothing; a group whose rows all have new = base has
    alpha null and the base's own loss; a group without a full row doesn't appear.
    """
    keys = list(by)
    of = lambda c: F.col(c).cast("double")
    rows = df.select(*keys, of(base).alias("_b"), (of(new) - of(base)).alias("_d"), (of(y) - of(base)).alias("_r")).dropna(subset=["_b", "_d", "_r"])
    if largest is None:
        rows = stored(rows, "rows")
        largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if keys and largest <= task_rows:
        group = Window.partitionBy(*keys)
        # + 0.0 makes -0.0 and 0.0 one value
        own = rows.withColumn("_a", F.when(F.col("_d") != 0, F.col("_r") / F.col("_d") + 0.0))
        run = own.withColumns({"_run": F.sum(F.abs("_d")).over(group.orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(F.abs("_d")).over(group)})
        median = F.min(F.when(2 * F.col("_run") >= F.col("_all"), F.col("_a"))).over(group)
        found = run.withColumn("_m", median).withColumn("alpha", F.when(F.col("_m").isNotNull(), _within(F.col("_m"), low, high)))
        gap = F.abs(F.col("_r") - F.coalesce("alpha", F.lit(0.0)) * F.col("_d"))
        return found.groupBy(*keys).agg(F.first("alpha").alias("alpha"), F.avg(gap).alias("mae"), F.count(F.lit(1)).alias("n_scored"))
    rows = rows.select(F.struct(F.lit(0).alias("_0"), *keys).alias("_key"), "_b", "_d", "_r")
    kinks = rows.where("_d <> 0").groupBy("_key", (F.col("_r") / F.col("_d")).alias("_a")).agg(F.sum(F.abs("_d")).alias("_w"))
    parts = ranged(kinks, F.col("_key"), F.col("_a"))
    sums = parts.groupBy("_key", "_part").agg(F.sum("_w").alias("w"))
    across = Window.partitionBy("_key")
    before = F.sum("w").over(across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select(F.col("_key").alias("_group"), F.col("_part").alias("__part"), F.coalesce(before, F.lit(0.0)).alias("_before"), F.sum("w").over(across).alias("_all"))
    own = F.sum("_w").over(Window.partitionBy("_key", "_part").orderBy("_a").rowsBetween(Window.unboundedPreceding, 0))
    passed = with_part(parts.withColumn("_own", own), carried, "_key").where(2 * (F.col("_before") + F.col("_own")) >= F.col("_all"))
    best = passed.groupBy("_key").agg(_within(F.min("_a"), low, high).alias("alpha"))
    met = rows.join(best.withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k"), "left")
    gap = F.abs(F.col("_r") - F.coalesce("alpha", F.lit(0.0)) * F.col("_d"))
    return met.groupBy("_key").agg(F.first("alpha").alias("alpha"), F.avg(gap).alias("mae"), F.count(F.lit(1)).alias("n_scored")).select(*[F.col(f"_key.{k}").alias(k) for k in keys], "alpha", "mae", "n_scored")


def _within(c: Column, low: float | None, high: float | None) -> Column:
    c = c if low is None else F.greatest(c, F.lit(float(low)))
    return c if high is None else F.least(c, F.lit(float(high)))


def _rows(df: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """One aggregate over df whose results become a row per entry of ``rows``."""
    flat = {(i, k): c for i, r in enumerate(rows) for k, c in r.items()}
    one = df.agg(*[c.alias(f"_{i}_{k}") for (i, k), c in flat.items()])
    return one.select(F.explode(F.array(*[F.struct(*[F.col(f"_{i}_{k}").alias(k) for k in r]) for i, r in enumerate(rows)])).alias("r")).select("r.*")


def _corr(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are there; null where one of them is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pair_moments(x: np.ndarray) -> np.ndarray:
    """(n, mean of a, mean of b, squares of a, squares of b, products) of each pair of rows of x over the columns where both are there, by matrix products."""
    seen = ~np.isnan(x)
    mid = np.where(seen.any(1), np.nanmean(np.where(seen.any(1)[:, None], x, 0.0), 1), 0.0)
    off, there = np.where(seen, x - mid[:, None], 0.0), seen.astype(float)
    n, sums, squares = there @ there.T, off @ there.T, (off * off) @ there.T
    few = np.maximum(n, 1)
    return np.stack([n, sums / few + mid[:, None], (sums / few).T + mid[None], squares - sums**2 / few, (squares - sums**2 / few).T, off @ off.T - sums * sums.T / few])


def _joined(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together, from those of each."""
    n, share = np.maximum(p[0] + q[0], 1), q[0] / np.maximum(p[0] + q[0], 1)
    da, db, w = q[1] - p[1], q[2] - p[2], p[0] * q[0] / n
    # a side without rows says nothing, whatever its means
    return np.stack([p[0] + q[0], p[1] + da * share, p[2] + db * share, p[3] + q[3] + da * da * w, p[4] + q[4] + db * db * w, p[5] + q[5] + da * db * w])


def prediction_correlation(wide: DataFrame, models: Sequence[str], y: str | None = None) -> DataFrame:
    """Correlation of each pair of models' outputs, or of their errors if ``y`` is given, over the rows where both are there: (a, b, corr).

    One pass: each Arrow batch gives the centred moments of all pairs as matrix
    products, a task joins those of its batches, and each pair's few rows, one a task,
    are joined in turn. Null where one of the two is constant or there are no rows;
    NaN counts as missing; pairs come from the order of ``models``.
    """
    m = len(models)
    pairs = np.triu_indices(m, 1)
    of = [F.col(c).cast("double") if y is None else F.col(c).cast("double") - F.col(y).cast("double") for c in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, m, m))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                total = _joined(total, _pair_moments(_rows_of(batch.slice(at, 8192), m)))
        own = total[:, pairs[0], pairs[1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs[0]), dtype=np.int32)), *(pa.array(c) for c in own)], ["pair", "n", "a", "b", "aa", "bb", "ab"])

    parts = wide.select(*[c.alias(f"_{i}") for i, c in enumerate(of)]).mapInArrow(run, "pair int, n double, a double, b double, aa double, bb double, ab double").where("n > 0")
    by = Window.partitionBy("pair")
    centred = parts.withColumns({f"_{c}": F.col(c) - F.sum(F.col("n") * F.col(c)).over(by) / F.sum("n").over(by) for c in "ab"})
    square = lambda c: F.sum(F.col(c) + F.col("n") * F.col(f"_{c[0]}") * F.col(f"_{c[1]}"))
    sums = centred.groupBy("pair").agg(square("aa").alias("aa"), square("bb").alias("bb"), square("ab").alias("ab"), F.sum("n").alias("n"), F.max(F.abs("a")).alias("la"), F.max(F.abs("b")).alias("lb"))
    # what is left of a constant is the rounding of its mean
    least = lambda c, size: F.col(c) > F.col("n") * (F.lit(1e-15) * F.col(size)) ** 2
    corr = F.when(least("aa", "la") & least("bb", "lb"), F.col("ab") / F.sqrt("aa") / F.sqrt("bb"))
    names = wide.sparkSession.createDataFrame([(k, models[i], models[j]) for k, (i, j) in enumerate(zip(*pairs))], "pair int, a string, b string")
    return names.join(sums.select("pair", corr.alias("corr")), "pair", "left").select("a", "b", "corr")


def complement_screen(wide: DataFrame, base: str, candidates: Sequence[str], y: str) -> DataFrame:
    """Per candidate: correlation of its step from the base with the base's error, and the injection that least squares wants."""
    rest = F.col(y) - F.col(base)
    rows = []
    for c in candidates:
        step = F.col(c) - F.col(base)
        rows.append({"model": F.first(F.lit(c)), "corr": _corr(step, rest), "alpha": F.try_divide(F.sum(step * rest), F.sum(step * step))})
    return _rows(wide, rows)


def _totals(table: np.ndarray, loss: str, trials: np.ndarray) -> np.ndarray:
    """Summed loss of every candidate weight vector over a table of model rows and, last, the target row."""
    total = np.zeros(len(trials))
    for at in range(0, table.shape[1], 1024):
        part = table[:, at : at + 1024]
        gap = trials @ part[:-1]
        gap -= part[-1]
        total += (np.abs(gap, out=gap) if loss == "absolute" else np.square(gap, out=gap)).sum(1)
    return total


def _rows_of(batch: pa.RecordBatch | pa.Table, n: int) -> np.ndarray:
    return np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float) for i in range(n)])


#: Bytes of one packed block. Spark reads thousands of blocks at a time (a batch of Parquet rows, of Arrow rows), whatever they hold.
BLOCK_BYTES = 1 << 12


def _packed(df: DataFrame) -> DataFrame:
    """df, all of doubles, as blocks of whole columns: (n, x), BLOCK_BYTES or one row each; read many times, blocks cost far less than rows."""
    most = max(1, BLOCK_BYTES // (8 * len(df.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch, batch.num_columns)
            parts = [x[:, at : at + most] for at in range(0, x.shape[1], most)]
            yield pa.RecordBatch.from_arrays([pa.array([p.shape[1] for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "x"])

    return df.mapInArrow(run, "n long, x binary")


def _blocks(batch: pa.RecordBatch, rows: int = 8192) -> Iterator[np.ndarray]:
    """The columns of the packed blocks of a batch, as rows of a table; some ``rows`` at a time."""
    n, x = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
    at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(n)) + 1, [len(n)]]).tolist() if len(n) else [0]
    for lo, hi in zip(edges, edges[1:]):
        step = max(1, rows // int(n[lo]))
        for first in range(lo, hi, step):
            last = min(hi, first + step)
            cells = np.frombuffer(x.buffers()[2], count=int(at[last] - at[first]) // 8, offset=int(at[first]))
            cells = cells.reshape(last - first, -1, n[lo])
            yield cells.transpose(1, 0, 2).reshape(cells.shape[1], -1)


def _summed(packed: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, int]:
    """The sum over all blocks of ``size`` numbers of each, and the rows: sums per task, then one aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            for table in _blocks(batch):
                total += of(table)
                n += table.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total), pa.array(np.full(size, n))], ["i", "total", "n"])

    out, n = np.zeros(size), 0
    for r in packed.mapInArrow(run, "i long, total double, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # one row per number
        out[r["i"]], n = r["total"], r["n"]
    return out, n


def _clipped(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The squared-error solution of the normal equations, cut at 0 and rescaled to sum 1."""
    w = np.maximum(np.linalg.lstsq(gram, cross, rcond=None)[0], 0)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def _pair_swaps(losses, start: np.ndarray, steps: Sequence[float], rounds: int) -> tuple[np.ndarray, float]:
    """From the best of the starts (rows) and, to check it, from a random one: moves of weight between two models until none helps.

    Both searches go on at the same time, so that a round is one call of ``losses``.
    """
    other = np.random.default_rng(0).dirichlet(np.ones(start.shape[1]))
    scores = losses(np.vstack([start, other]))
    found = [(scores[:-1].min(), start[scores[:-1].argmin()]), (scores[-1], other)]
    going = [0, 1]
    for _ in range(rounds):
        moves = {i: _moves(found[i][1], steps) for i in going}
        going = [i for i in going if len(moves[i])]
        if not going:
            break
        scores = losses(np.vstack([moves[i] for i in going]))
        for i, own in zip(list(going), np.split(scores, np.cumsum([len(moves[i]) for i in going])[:-1])):
            if own.min() >= found[i][0] - 1e-12:
                going.remove(i)
            else:
                found[i] = own.min(), np.maximum(moves[i][own.argmin()], 0)
    best, w = min((best, w.tolist()) for best, w in found)
    return np.array(w), float(best)


def _fit_in_tasks(narrow: DataFrame, keys: Sequence[str], models: Sequence[str], y: str, loss: str, steps: Sequence[float], rounds: int) -> DataFrame:
    """Each group's weights, found in a task of its own."""
    m = len(models)
    fixed = np.vstack([np.full(m, 1 / m), np.eye(m)])

    def one(t: pa.Table) -> pa.Table:
        table = _rows_of(t.select([*models, y]).combine_chunks(), m + 1)
        start = np.vstack([fixed, _clipped(table[:-1] @ table[:-1].T, table[:-1] @ table[-1])])
        w, best = _pair_swaps(lambda trials: _totals(table, loss, trials) / table.shape[1], start, steps, rounds)
        own = {k: pa.array([t.column(k)[0].as_py()] * m, t.schema.field(k).type) for k in keys}
        return pa.table(own | {"model": pa.array(list(models)), "w": pa.array(w), "loss": pa.array([best] * m)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name in keys)
    return narrow.groupBy(*keys).applyInArrow(one, f"{kinds}, model string, w double, loss double")


def _moves(w: np.ndarray, steps: Sequence[float]) -> np.ndarray:
    """All weight vectors one step of weight from one model to another away."""
    m = len(w)
    moves = [(i, j, s) for i in range(m) for j in range(m) if i != j for s in steps if w[i] >= s - 1e-12]
    return np.array([w + s * (np.eye(m)[j] - np.eye(m)[i]) for i, j, s in moves]).reshape(-1, m)


def _fit_across_tasks(large: DataFrame, models: Sequence[str], y: str, loss: str, steps: Sequence[float], rounds: int) -> DataFrame:
    """(_g, model, w, loss) of groups that no task need hold: the searches of _pair_swaps for all groups at once.

    The state has a row per group and search: the best weights so far and the trials to
    score next. A round joins it to the rows, sums each trial's loss per Arrow batch,
    adds the sums up per search and takes the best trial, or closes the search if none
    is better. Rows of closed searches' groups are read no more. State stays a table,
    written each round.
    """
    m = len(models)
    packed = "_g long, search int, n long, totals array<double>, w array<double>, best double, trials array<double>"
    state_kind = "_g long, search int, w array<double>, best double, trials array<double>, closed boolean"

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = np.asarray(batch.column(0))
            table = _rows_of(batch.select([*models, y]), m + 1)
            for own in np.unique(g):
                x = table[:, g == own]
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([(x @ x.T).ravel()], pa.list_(pa.float64()))], ["_g", "sums"])

    def begun(t: pa.Table) -> pa.Table:
        total = np.sum([r.as_py() for r in t["sums"]], axis=0).reshape(m + 1, m + 1)
        starts = np.vstack([np.full(m, 1 / m), np.eye(m), _clipped(total[:-1, :-1], total[:-1, -1])])
        other = np.random.default_rng(0).dirichlet(np.ones(m))[None]
        g = t["_g"][0].as_py()
        return _state([(g, i, x[0], np.inf, x, False) for i, x in enumerate((starts, other))])

    def _state(rows: list[tuple]) -> pa.Table:
        array = pa.list_(pa.float64())
        kinds = {"_g": pa.int64(), "search": pa.int32(), "w": array, "best": pa.float64(), "trials": array, "closed": pa.bool_()}
        return pa.table({k: pa.array([np.ravel(r[i]) if kind == array else r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds.items())})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, search = np.asarray(batch.column(0)), np.asarray(batch["search"])
            table = _rows_of(batch.select([*models, y]), m + 1)
            for own, of in {(int(a), int(b)) for a, b in zip(g, search)}:
                rows = (g == own) & (search == of)
                first = int(np.argmax(rows))
                w, best, trials = (batch[c][first].as_py() for c in ("w", "best", "trials"))
                totals = _totals(table[:, rows], loss, np.reshape(trials, (-1, m)))
                array = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own]), pa.array([of], pa.int32()), pa.array([int(rows.sum())]), pa.array([totals], array), pa.array([w], array), pa.array([best], pa.float64()), pa.array([trials], array)],
                    ["_g", "search", "n", "totals", "w", "best", "trials"],
                )

    def moved(t: pa.Table) -> pa.Table:
        g, search, w, best = (t[c][0].as_py() for c in ("_g", "search", "w", "best"))
        losses = np.sum([r.as_py() for r in t["totals"]], axis=0) / sum(t["n"].to_pylist())
        trials = np.reshape(t["trials"][0].as_py(), (-1, m))
        if losses.min() >= best - 1e-12:
            return _state([(g, search, w, best, np.zeros(0), True)])
        w, best = np.maximum(trials[losses.argmin()], 0), float(losses.min())
        after = _moves(w, steps)
        return _state([(g, search, w, best, after, not len(after))])

    state = stored(large.mapInArrow(gram, "_g long, sums array<double>").groupBy("_g").applyInArrow(begun, state_kind), "state")
    for _ in range(rounds + 1):
        open_ = state.where("not closed")
        if open_.isEmpty():
            break
        trials = large.join(open_.drop("closed"), "_g").select("_g", *models, y, "search", "w", "best", "trials")
        again = trials.mapInArrow(scored, packed).groupBy("_g", "search").applyInArrow(moved, state_kind)
        state = stored(state.where("closed").unionByName(again), "state")
    best = state.groupBy("_g").agg(F.min(F.struct("best", "w")).alias("_b"))
    each = F.posexplode("_b.w").alias("_i", "w")
    named = F.array(*map(F.lit, models))
    return best.select("_g", F.col("_b.best").alias("loss"), each).select("_g", F.element_at(named, F.col("_i") + 1).alias("model"), "w", "loss")


def fit_blend_weights(wide: DataFrame, models: Sequence[str], y: str, loss: str = "absolute", by: Sequence[str] = (), steps: Sequence[float] = (0.002, 0.01, 0.05, 0.2), rounds: int = 60, task_rows: int = 1 << 17) -> DataFrame:
    """Weights >= 0 that sum to 1 with the least mean loss, by pair swaps: (by..., model, w, loss).

    The search starts from the best of equal weights, each single model and the clipped
    squared-error solution, and again from a random point. Each round moves a step of
    weight from one model to another, tries all such moves on the cluster at once and
    keeps the best, until none helps; the narrow input is written once, in blocks of
    columns, both searches share a pass over it a round, and only weight
    vectors and their losses are on the driver. With ``by`` a group of up to
    ``task_rows`` rows is fitted in a task of its own; all larger ones are fitted at once,
    their trials scored over all tasks and summed by (group, search) each round. Rows with a null are left out; without
    rows there are no weights; a single model has weight 1.
    """
    m, keys = len(models), list(by)
    narrow = wide.select(*keys, *[F.col(c).cast("double") for c in [*models, y]]).dropna(subset=[*models, y])
    fixed = np.vstack([np.full(m, 1 / m), np.eye(m)])
    if keys:
        size = narrow.groupBy(F.struct(*keys).alias("_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_rows)
        if size.isEmpty():
            return _fit_in_tasks(narrow, keys, models, y, loss, steps, rounds)
        groups = stored(size.select("_key", F.monotonically_increasing_id().alias("_g")), "groups")
        same = F.struct(*keys).eqNullSafe(F.col("_key"))
        large = stored(narrow.join(groups, same).select("_g", *models, y), "large")
        found = _fit_across_tasks(large, models, y, loss, steps, rounds).join(groups, "_g").select(*[F.col(f"_key.{k}").alias(k) for k in keys], "model", "w", "loss")
        return _fit_in_tasks(narrow.join(groups, same, "left_anti"), keys, models, y, loss, steps, rounds).unionByName(found)
    table = stored(_packed(narrow), "blend")
    squares, n = _summed(table, lambda x: (x @ x.T).ravel(), (m + 1) ** 2)
    schema = "model string, w double, loss double"
    if not n:
        return wide.sparkSession.createDataFrame([], schema)
    squares = squares.reshape(m + 1, m + 1)
    starts = np.vstack([fixed, _clipped(squares[:m, :m], squares[:m, m])])
    w, best = _pair_swaps(lambda trials: _summed(table, lambda x: _totals(x, loss, trials), len(trials))[0] / n, starts, steps, rounds)
    return wide.sparkSession.createDataFrame([(a, float(b), best) for a, b in zip(models, w)], schema)


def residual_target(df: DataFrame, y: str, base: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(y) - F.col(base))


def recompose(df: DataFrame, stages: Sequence[str], out: str = "pred") -> DataFrame:
    """Sum of a base and its residual stages; a missing stage adds nothing."""
    return df.withColumn(out, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in stages), F.lit(0.0)))
