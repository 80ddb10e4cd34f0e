"""Forecast metrics. Each has an expression, usable in any agg, and a function that returns a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit_rate_of(pred: Sequence[str], true: Sequence[str], radius: float) -> Column:
    """Share of predictions at most ``radius`` from the truth; a null prediction is a miss."""
    d2 = sum(((F.col(p) - F.col(t)) * (F.col(p) - F.col(t)) for p, t in zip(pred, true)), F.lit(0.0))
    return F.avg(F.when(F.sqrt(d2) <= radius, 1.0).otherwise(0.0))


def mae_of(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def smape_nz_of(y: str, p: str, factor: float = 2.0) -> Column:
    """SMAPE over rows whose actual is not zero; null predictions are left out."""
    y_, p_ = F.col(y), F.col(p)
    return F.avg(F.when(y_ != 0, F.try_divide(factor * F.abs(y_ - p_), F.abs(y_) + F.abs(p_))))


def scored_of(y: str, p: str) -> Column:
    return F.count(F.when((F.col(y) != 0) & F.col(p).isNotNull(), 1))


def nmae_of(y: str, p: str, capacity: str, min_util: float = 0.0) -> Column:
    """Mean absolute error over capacity, over rows that use ``min_util`` of it at least."""
    y_, c = F.col(y), F.col(capacity)
    return F.avg(F.when(y_ >= min_util * c, F.try_divide(F.abs(y_ - F.col(p)), c)))


def ficr_of(y: str, p: str, capacity: str, tiers: Sequence[tuple[float, float]]) -> Column:
    """Earned over highest reward, weighted by actual output: the first tier (largest error, rate) that holds the error pays."""
    err = F.try_divide(F.abs(F.col(y) - F.col(p)), F.col(capacity))
    rate = F.lit(0.0)
    for most, r in reversed(list(tiers)):
        rate = F.when(err <= most, F.lit(float(r))).otherwise(rate)
    best = max(r for _, r in tiers)
    return F.try_divide(F.sum(F.when(err.isNotNull(), rate * F.col(y))), F.sum(F.when(err.isNotNull(), F.lit(float(best)) * F.col(y))))


def composite_of(y: str, p: str, capacity: str, tiers, w=(0.5, 0.5)) -> Column:
    return w[0] * (1 - nmae_of(y, p, capacity)) + w[1] * ficr_of(y, p, capacity, tiers)


def _table(df: DataFrame, by: Sequence[str], **columns: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])


def hit_rate(df, pred, true, radius, by=()):
    return _table(df, by, hit_rate=hit_rate_of(pred, true, radius))


def mae(df, y, p, by=()):
    return _table(df, by, mae=mae_of(y, p))


def smape_nz(df, y, p, by=(), factor=2.0):
    return _table(df, by, smape=smape_nz_of(y, p, factor), n_scored=scored_of(y, p))


def weighted_smape(df: DataFrame, y: str, p: str, group: str, weights: DataFrame, factor: float = 2.0) -> DataFrame:
    """smape_nz per group, then the mean over groups by column w of ``weights`` (groups without a score or weight left out)."""
    per = smape_nz(df, y, p, [group], factor).join(weights.select(group, "w"), group).where(F.col("smape").isNotNull())
    return per.agg(F.try_divide(F.sum(F.col("w") * F.col("smape")), F.sum("w")).alias("weighted_smape"), F.sum("n_scored").alias("n_scored"))


def nmae(df, y, p, capacity, min_util=0.0, by=()):
    return _table(df, by, nmae=nmae_of(y, p, capacity, min_util))


def ficr(df, y, p, capacity, tiers, by=()):
    return _table(df, by, ficr=ficr_of(y, p, capacity, tiers))


def composite_score(df, y, p, capacity, tiers, w=(0.5, 0.5), by=()):
    return _table(df, by, nmae=nmae_of(y, p, capacity), ficr=ficr_of(y, p, capacity, tiers), score=composite_of(y, p, capacity, tiers, w))


def metric_rollup(df: DataFrame, dims: Sequence[str], **metrics: Column) -> DataFrame:
    """Metrics per group with subtotals; ``level`` is the grouping id."""
    return df.rollup(*dims).agg(F.grouping_id().cast("long").alias("level"), *[m.alias(n) for n, m in metrics.items()])


def compare_models(long: DataFrame, metric: Callable[[str, str], Column], baseline: str, y: str = "y", higher_is_better: bool = False) -> DataFrame:
    """Score, rank and gain on the baseline of each model of a (model, pred, y) table."""
    scores = long.groupBy("model").agg(metric(y, "pred").alias("score"))
    base = scores.where(F.col("model") == baseline).select(F.col("score").alias("_base"))
    order = F.desc_nulls_last("score") if higher_is_better else F.asc_nulls_last("score")
    gain = (F.col("score") - F.col("_base")) * (1 if higher_is_better else -1)
    # one row per model: the rank's single window holds as many rows as there are models
    return scores.join(F.broadcast(base), how="left").select("model", "score", F.rank().over(Window.orderBy(order)).cast("long").alias("rank"), gain.alias("gain"))
