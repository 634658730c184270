"""Forecast models and their measures."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES

TARGET = "target_aqi_24h"


def measures(predicted: DataFrame, target: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """rmse, mae, r2, n_test by one aggregation."""
    e = F.col(target) - F.col(prediction)
    return predicted.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(target) * F.count(target), F.lit(0.0)))).alias("r2"),
        F.count("*").alias("n_test"),
    )


def fit_forest(train: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestRegressor(labelCol=TARGET, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assemble, forest]).fit(train)


def save_forest(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def importances(model: PipelineModel) -> DataFrame:
    """(feature, importance), largest first."""
    from pyspark.sql import SparkSession

    weights = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.active()
    return spark.createDataFrame([(f, float(w)) for f, w in zip(FEATURES, weights, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


class OnlineLinear:
    """Linear model by stochastic gradient with an epsilon-insensitive loss. An epoch goes
    through the chunks of time in their order, each shuffled by the same seed; inputs are
    scaled by the first chunk; rates fall over all steps of all epochs.

    Rows are dealt by a hash of what they hold to blocks of about `rows_per_block`, so the
    result doesn't depend on partitions or files. Each block makes all epochs in one task,
    and weights are averaged by the blocks' rows; a table of one block is the plain serial
    method. One job and as many rows to the driver as there are blocks."""

    def __init__(self, features=FEATURES, target: str = TARGET, epsilon: float = 5.0, epochs: int = 30, rate: float = 0.01, alpha: float = 1e-4, seed: int = 42, rows_per_block: int = 500_000):
        self.features, self.target, self.epsilon, self.epochs, self.rate, self.alpha = tuple(features), target, epsilon, epochs, rate, alpha
        self.seed, self.rows_per_block = seed, rows_per_block
        self.weights: np.ndarray | None = None

    def _scaler(self, chunk: DataFrame) -> None:
        row = chunk.agg(*(F.avg(c) for c in self.features), *(F.stddev_pop(c) for c in self.features)).first()
        k = len(self.features)
        self.mean = np.array(row[:k], float)
        self.sd = np.array([s or 1.0 for s in row[k:]], float)

    def fit(self, train: DataFrame, column: str = "chunk_month") -> OnlineLinear:
        """Null features or targets are left out; without a row there is nothing to fit."""
        rows = train.select(F.col(column).alias("__turn"), *self.features, self.target).na.drop()
        found = rows.agg(F.min("__turn").alias("first"), F.count("*").alias("n")).first()
        if not found.n:
            raise ValueError("no row to fit")
        self._scaler(rows.where(F.col("__turn") == F.lit(found.first)))
        self.weights = np.zeros(len(self.features) + 1)
        self.blocks = -(-found.n // self.rows_per_block)
        self._step(rows)
        return self

    def _step(self, rows: DataFrame) -> None:
        names, target, start, seed = self.features, self.target, self.weights, self.seed
        mean, sd, eps, epochs, rate, alpha = self.mean, self.sd, self.epsilon, self.epochs, self.rate, self.alpha

        def run(pdf):
            import pandas as pd

            pdf = pdf.sort_values(["__turn", *names, target])
            x, y = (pdf[list(names)].to_numpy(float) - mean) / sd, pdf[target].to_numpy(float)
            _, begins = np.unique(pdf["__turn"].to_numpy(), return_index=True)
            orders = [lo + np.random.default_rng(seed).permutation(hi - lo) for lo, hi in zip(begins, [*begins[1:], len(y)], strict=True)]
            order = np.concatenate(orders)
            w, base, t = start[:-1].copy(), float(start[-1]), 0
            for _ in range(epochs):
                for i in order:
                    t += 1
                    step = rate / t**0.25
                    miss = x[i] @ w + base - y[i]
                    w *= 1 - step * alpha
                    if abs(miss) > eps:
                        move = step if miss > 0 else -step
                        w -= move * x[i]
                        base -= move
            return pd.DataFrame({"n": [len(y)], "w": [[*w, base]]})

        block = F.pmod(F.xxhash64("__turn", *names, target), F.lit(self.blocks))
        dealt = rows.withColumn("__block", block)
        got = dealt.groupBy("__block").applyInPandas(run, "n long, w array<double>").collect()  # a row per block
        self.weights = sum(np.array(r.w) * r.n for r in got) / sum(r.n for r in got)

    def save(self, spark, path: str) -> None:
        """Weights and scaler as a table of one row."""
        row = (list(self.features), self.target, self.weights.tolist(), self.mean.tolist(), self.sd.tolist())
        spark.createDataFrame([row], "features array<string>, target string, weights array<double>, mean array<double>, sd array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> OnlineLinear:
        r = spark.read.parquet(path).first()
        out = cls(r.features, r.target)
        out.weights, out.mean, out.sd = np.array(r.weights), np.array(r.mean), np.array(r.sd)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        scale = self.weights[:-1] / self.sd
        base = float(self.weights[-1] - (scale * self.mean).sum())
        terms = [F.col(c) * float(s) for c, s in zip(self.features, scale, strict=True)]
        return df.withColumn("prediction", sum(terms, F.lit(base)))
