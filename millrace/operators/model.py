"""Chronological validation and gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def fit_gbt(df: DataFrame, features: Sequence[str], y: str, loss: str = "squared", depth: int = 4, iters: int = 10, seed: int = 7) -> PipelineModel:
    """Assembler and boosted trees in one pipeline; rows with a null feature are skipped."""
    trees = GBTRegressor(featuresCol="_features", labelCol=y, predictionCol="pred", lossType=loss, maxDepth=depth, maxIter=iters, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"), trees]).fit(df)


def fit_and_save(df: DataFrame, path: str, features: Sequence[str], y: str, **options) -> PipelineModel:
    model = fit_gbt(df, features, y, **options)
    model.write().overwrite().save(path)
    return model


def score_model(df: DataFrame, path: str) -> DataFrame:
    return PipelineModel.load(path).transform(df).drop("_features")


def time_split(df: DataFrame, t: str, start: str, end: str, gap_days: int = 0) -> DataFrame:
    """Column ``split``: train before start - gap, valid in [start, end), null elsewhere."""
    start_, at = F.lit(start).cast("date"), F.col(t).cast("date")
    return df.withColumn("split", F.when(at < F.date_sub(start_, gap_days), "train").when((at >= start_) & (at < F.lit(end).cast("date")), "valid"))


def rolling_origin(df: DataFrame, t: str, boundaries: Sequence[str]) -> DataFrame:
    """A row per fold it belongs to: fold i trains before boundaries[i] and validates until boundaries[i + 1]."""
    spark = df.sparkSession
    folds = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(boundaries, boundaries[1:]))], "fold int, _a string, _b string")
    folds = folds.select("fold", F.col("_a").cast("date").alias("_a"), F.col("_b").cast("date").alias("_b"))
    at = F.col(t).cast("date")
    joined = df.join(F.broadcast(folds), at < F.col("_b"))  # a handful of folds
    return joined.withColumn("split", F.when(at < F.col("_a"), "train").otherwise("valid")).drop("_a", "_b")


def oof_predictions(df: DataFrame, folds: Sequence[int], fit: Callable[[DataFrame], PipelineModel], at_once: int = 4) -> DataFrame:
    """Validation rows of rolling_origin's folds, each predicted by a model of that fold's training rows.

    The rows are written once and read by every fold; up to ``at_once`` folds are fitted
    at the same time, each from a thread with a scheduler pool of its own, so that under
    spark.scheduler.mode=FAIR small jobs of one fold don't wait for another's. Rows come
    by fold in the order given, whatever the order in which the fits end.
    """
    rows = stored(df, "folds")
    context = df.sparkSession.sparkContext

    def fitted(i: int) -> PipelineModel:
        context.setLocalProperty("spark.scheduler.pool", f"fold-{i}")
        return fit(rows.where((F.col("fold") == i) & (F.col("split") == "train")))

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        models = list(pool.map(inheritable_thread_target(df.sparkSession)(fitted), folds))
    out = None
    for i, model in zip(folds, models):
        scored = model.transform(rows.where((F.col("fold") == i) & (F.col("split") == "valid"))).drop("_features")
        out = scored if out is None else out.unionByName(scored)
    return out
