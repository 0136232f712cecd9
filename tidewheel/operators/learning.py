"""Forecasters, failure classifier and calibration, and the causal baselines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import boosting
from tidewheel.operators.boosting import Boosting
from tidewheel.operators.windows import Blocks
from tidewheel.sources.shared import fresh_path, settled, shared_dir, side_by_side

#: Stands for an infinite change score in feature vectors, which must be finite.
FINITE = 1e6
#: Forecasters: 80 trees of at most 31 leaves on the log scale, ended early from 10,000 training rows on.
WORKLOAD = Boosting("squared", trees=80, rate=0.07, leaves=31, l2=1.0, least_hessian=1e-3, least_rows=30, bins=255, patience=10)
#: The failure classifier.
RISK = Boosting("logistic", trees=350, rate=0.05, depth=6, l2=5.0, l1=0.1, least_hessian=5.0, rows=0.85, columns=0.8, bins=256)
#: Trees of the forest, of each of its parts, and their depth, the most that Spark ML allows.
FOREST_TREES, PART_TREES, FOREST_DEPTH = 300, 10, 30


def causal_baselines(view: DataFrame, y: str = "total_tokens", season: int = 288, mean: int = 12) -> DataFrame:
    """bucket, actual (the next bucket's value), persistence, seasonal naive and moving average forecasts."""
    b = Blocks(view.select("bucket", y), "bucket", season, ahead=1)
    return b.result(
        "bucket",
        b.lead(y).alias("actual"),
        F.col(y).cast("double").alias("persistence"),
        b.lag(y, season - 1).cast("double").alias("seasonal_naive"),
        b.full(F.avg(y), y, -(mean - 1), 0).alias("moving_average"),
    )


def finite_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.least(F.col(f).cast("double"), F.lit(FINITE)) for f in features})


def forest(rows: DataFrame, trees: int = FOREST_TREES, part: int = PART_TREES, depth: int = FOREST_DEPTH, seed: int = 42) -> list[RandomForestRegressionModel]:
    """A random forest for ``features`` and ``label``, as independent parts of ``part`` trees that are fitted side by side.

    A part draws its own rows. Row's nodes are kept on the executors, so tasks
    carry the nodes of one level of one part and not the trees grown so far.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    ready = for_fit(rows.select("features", "label")).persist()

    def one(i: int) -> RandomForestRegressionModel:
        own = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=min(part, trees - i * part), minInstancesPerNode=5, maxDepth=depth, maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10, seed=seed + i)
        path = fresh_path(rows.sparkSession, "forest")
        own.fit(ready).write().save(path)
        return RandomForestRegressionModel.load(path)

    try:
        return side_by_side(*(lambda i=i: one(i) for i in range(-(-trees // part))))
    finally:
        ready.unpersist()


def forest_mean(rows: DataFrame, parts: list[RandomForestRegressionModel], name: str = "prediction") -> DataFrame:
    """``rows`` with the mean of all trees of all parts."""
    out = reduce(lambda df, x: x[1].setPredictionCol(f"_part_{x[0]}").transform(df), enumerate(parts), rows)
    total = reduce(lambda a, b: a + b, (F.col(f"_part_{i}") * m.getNumTrees for i, m in enumerate(parts)))
    return out.withColumn(name, total / sum(m.getNumTrees for m in parts)).drop(*(f"_part_{i}" for i in range(len(parts))))


def least_squares(rows: DataFrame, features: list[str], label: str) -> tuple[float, dict[str, float]]:
    """Intercept and coefficients of the linear regression on all features.

    Each task sums products of its rows, taken from its own means; such sums
    are merged without loss of digits, and the normal equations are solved for
    columns scaled to unit spread. Of features that depend on one another, the
    solution of least norm is taken. Without rows all numbers are 0.
    """
    names = [*features, label]

    def products(batches: Iterator[pa.RecordBatch]):
        n, mean, spread = 0, np.zeros(len(names)), np.zeros((len(names), len(names)))
        for batch in batches:
            x = np.column_stack([np.asarray(batch[c]) for c in names])
            if len(x):
                own = x.mean(0)
                n, mean, spread = _merged((n, mean, spread), (len(x), own, (x - own).T @ (x - own)))
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], names=["n", "mean", "spread"])

    ready = rows.na.drop(subset=names).select(*(F.col(c).cast("double").alias(c) for c in names))
    # a row for each task, of a size that depends on the number of features alone
    parts = ready.mapInArrow(products, "n long, mean array<double>, spread array<double>").where("n > 0").collect()
    if not parts:
        return 0.0, dict.fromkeys(features, 0.0)
    _, mean, spread = reduce(_merged, ((r["n"], np.array(r["mean"]), np.array(r["spread"]).reshape(len(names), -1)) for r in parts))
    scale = np.sqrt(np.diag(spread))
    scale[scale == 0] = 1.0
    unit = spread / np.outer(scale, scale)
    k = len(features)
    slopes = np.linalg.lstsq(unit[:k, :k], unit[:k, k], rcond=1e-12)[0] * scale[k] / scale[:k]
    return float(mean[k] - slopes @ mean[:k]), dict(zip(features, slopes.tolist(), strict=True))


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, means and centred products of two sets of rows together."""
    (n, mean, spread), (m, other, more) = a, b
    gap = other - mean
    return n + m, mean + gap * (m / (n + m)), spread + more + np.outer(gap, gap) * (n * m / (n + m))


def linear(intercept: float, slopes: dict[str, float]) -> Column:
    return reduce(lambda x, c: x + F.col(c[0]).cast("double") * c[1], slopes.items(), F.lit(intercept))


def boosted(rows: DataFrame, features: list[str], label: str, key: str, p: Boosting) -> boosting.Model:
    """A fitted model as it is read back from the shared folder."""
    model = boosting.fit(rows, features, label, key, p)
    return boosting.read_model(settled(model.table(rows.sparkSession), "boosted-trees"), features)


def forecast(rows: DataFrame, features: list[str], kind: str, target: str = "target_next_5min", split: str = "split", log_target: bool = True, trees: int | None = None, key: str = "bucket") -> DataFrame:
    """``rows`` with a forecast fitted on the train split; on the log scale unless told otherwise, never below 0.

    ``kind`` is ``gbt`` (boosted trees), ``forest`` or ``ols``; ``trees`` sets
    another number of trees. Rows without all features or the target are left out.
    """
    ready = finite_features(rows.na.drop(subset=[*features, target]), features)
    # written: fits read it again and again, and long chains of null checks over computed columns take the planner long
    ready = settled(ready.withColumn("label", F.log1p(target) if log_target else F.col(target).cast("double")), "forecast-rows")
    train = ready.where(F.col(split) == "train")
    if kind == "gbt":
        out = boosted(train, features, "label", key, replace(WORKLOAD, trees=trees or WORKLOAD.trees)).predict(ready, "prediction")
    elif kind == "forest":
        vectors = VectorAssembler(inputCols=features, outputCol="features")
        out = forest_mean(vectors.transform(ready), forest(vectors.transform(train), trees or FOREST_TREES)).drop("features")
    elif kind == "ols":
        out = ready.withColumn("prediction", linear(*least_squares(train, features, "label")))
    else:
        raise ValueError(f"unknown forecaster {kind!r}")
    back = F.expm1("prediction") if log_target else F.col("prediction")
    return out.withColumn("forecast", F.greatest(F.lit(0.0), back)).drop("label", "prediction")


#: Rows of a training partition: an iterative fit runs many short jobs, each over all partitions.
FIT_ROWS = 100_000


def for_fit(rows: DataFrame) -> DataFrame:
    """``rows`` in as few partitions as keep ``FIT_ROWS`` in each."""
    n = rows.count()
    return rows.repartition(max(1, -(-n // FIT_ROWS)))


def failure_risk(rows: DataFrame, features: list[str], label: str = "failure", split: str = "split", trees: int | None = None, key: str = "minute") -> DataFrame:
    """``rows`` that have all features, with the classifier's probability of a failure."""
    ready = rows.na.drop(subset=[*features, label])
    model = boosted(ready.where(F.col(split) == "train"), features, label, key, replace(RISK, trees=trees or RISK.trees))
    return model.predict(ready, "probability_of_failure")


def isotonic(rows: DataFrame, score: str, label: str, split: str = "split", fit_on: str = "calibration") -> DataFrame:
    """``rows`` with the score calibrated by isotonic regression fitted on one split; clamped beyond its range."""
    model = IsotonicRegression(featuresCol=score, labelCol="_y", predictionCol="calibrated").fit(rows.where(F.col(split) == fit_on).withColumn("_y", F.col(label).cast("double")))
    return model.transform(rows)


def ols_by_sums(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: intercept and slope of the simple regression of ``y`` on ``x``."""
    return rows.agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))
