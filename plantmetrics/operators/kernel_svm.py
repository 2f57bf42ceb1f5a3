"""Support vector machine with a Gaussian kernel: Nystroem features from landmarks that a hash chooses, then a linear hinge loss.

The kernel matrix of all rows is never built. Each row gets its kernel values against a bounded number of landmarks, turned so
that their inner products come near the kernel; a linear machine on these features is fitted from sums over partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmetrics.session import materialise

# The weight of margin errors.
PENALTY = 10.0
LANDMARKS = 256
ITERATIONS = 60
CURVE_ITERATIONS = 20
TOLERANCE = 1e-4
ROWS_PER_TASK = 20_000  # kernel rows that one task sums in each step
SMALLEST = 1e-10  # of the landmarks' kernel eigenvalues, against the largest


class NystroemFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A vector as exp(-gamma |x - landmark|^2) for every landmark, times a matrix that makes inner products kernel values."""

    landmarks = Param(Params._dummy(), "landmarks", "components of the landmarks, one after the other", TypeConverters.toListFloat)
    turn = Param(Params._dummy(), "turn", "the matrix by rows: landmarks x features", TypeConverters.toListFloat)
    size = Param(Params._dummy(), "size", "number of landmarks", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma = self.getOrDefault(self.size), self.getOrDefault(self.gamma)
        points = np.array(self.getOrDefault(self.landmarks)).reshape(size, -1)
        turn = np.array(self.getOrDefault(self.turn)).reshape(size, -1)

        @F.pandas_udf("array<double>")
        def features(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(gaussian(np.stack(vectors), points, gamma) @ turn))

        mapped = features(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped))


def gaussian(rows: np.ndarray, points: np.ndarray, gamma: float) -> np.ndarray:
    distance = (rows**2).sum(1)[:, None] + (points**2).sum(1) - 2 * rows @ points.T
    return np.exp(-gamma * np.maximum(distance, 0.0))


def scale_gamma(frame: DataFrame, features: str) -> float:
    """1 / (number of components * variance of all components), from sums over partitions."""
    row = frame.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col(features)).alias("s")).select("s.*").first()
    mean, squares = row["mean"].toArray(), row["normL2"].toArray() ** 2
    variance = squares.sum() / (row["count"] * len(mean)) - mean.mean() ** 2
    return 1.0 / (len(mean) * variance) if variance > 0 else 1.0 / len(mean)


def choose_landmarks(frame: DataFrame, features: str, size: int) -> np.ndarray:
    """Up to ``size`` different vectors, those with the smallest hashes, however often a vector is repeated.

    Only hashes are made distinct; then the vectors of the chosen ones are fetched.
    """
    hashed = frame.select(vector_to_array(F.col(features)).alias("x")).withColumn("h", F.xxhash64("x"))
    chosen = [row["h"] for row in hashed.select("h").distinct().orderBy("h").limit(size).collect()]
    found = hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.first("x").alias("x")).orderBy("h").collect()
    return np.array([row["x"] for row in found])


def nystroem(frame: DataFrame, features: str, out: str, size: int = LANDMARKS) -> NystroemFeatures:
    """The feature map of the rows of ``frame``."""
    points, gamma = choose_landmarks(frame, features, size), scale_gamma(frame, features)
    values, vectors = np.linalg.eigh(gaussian(points, points, gamma))
    kept = values > SMALLEST * values.max()
    turn = vectors[:, kept] / np.sqrt(values[kept])
    stage = NystroemFeatures()
    stage._set(
        inputCol=features,
        outputCol=out,
        landmarks=points.ravel().tolist(),
        turn=turn.ravel().tolist(),
        size=len(points),
        gamma=gamma,
    )
    return stage


class KernelSVM:
    """An estimator with ``fit``; the model has prediction, margin and, from a logistic curve over the margin, probability."""

    def __init__(self, label: str = "label", features: str = "features", penalty: float = PENALTY, landmarks: int = LANDMARKS) -> None:
        self.label, self.features, self.penalty, self.landmarks = label, features, penalty, landmarks

    def fit(self, frame: DataFrame) -> PipelineModel:
        """Fit on all rows of ``frame``. The hinge loss is the mean over rows, so the penalty is divided by their number."""
        n = frame.count()
        kernel = nystroem(frame, self.features, "kernel", self.landmarks)
        machine = LinearSVC(
            featuresCol="kernel",
            labelCol=self.label,
            rawPredictionCol="margin",
            regParam=1.0 / (self.penalty * max(n, 1)),
            maxIter=ITERATIONS,
            tol=TOLERANCE,
            standardization=False,
        )
        curve = LogisticRegression(
            featuresCol="margin",
            labelCol=self.label,
            rawPredictionCol="logit",
            probabilityCol="probability",
            predictionCol="likelier",
            regParam=1.0 / math.sqrt(max(n, 1)) / 100,
            maxIter=CURVE_ITERATIONS,
        )
        # the learners get a plain table, as the trees do: their plans then hold no function and no cached relation of this session
        mapped = materialise(kernel.transform(frame.select(self.features, self.label)), "kernel-rows")
        # a step is one short job, so few rows go to few tasks
        fitted = Pipeline(stages=[machine, curve]).fit(mapped.coalesce(n // ROWS_PER_TASK + 1))
        return PipelineModel(stages=[kernel, *fitted.stages])
