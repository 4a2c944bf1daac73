"""K nearest neighbours with scaled, weighted features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import nearest
from .linear import gram


@dataclass
class Neighbors:
    """Features are standardised (population deviation) and weighted by sqrt(w / sum of w); mahalanobis whitens them by
    the training covariance instead. weights: uniform or distance (zero distances take all)."""

    features: Sequence[str]
    target: str
    k: int = 5
    feature_weights: Sequence[float] | None = None
    metric: str = "euclidean"
    weights: str = "uniform"
    transform: np.ndarray | None = None
    mean: np.ndarray | None = None
    train: DataFrame | None = None

    def fit(self, df: DataFrame, key: str) -> Neighbors:
        g, n = gram(df, [F.lit(1.0), *map(F.col, self.features)])
        self.mean = g[0, 1:] / n
        cov = g[1:, 1:] / n - np.outer(self.mean, self.mean)
        w = np.ones(len(self.features)) if self.feature_weights is None else np.asarray(self.feature_weights, float)
        scale = np.sqrt(w / w.sum())
        if self.metric == "mahalanobis":
            self.transform = np.linalg.cholesky(np.linalg.pinv(cov))
        else:
            sd = np.sqrt(np.diag(cov))
            self.transform = np.diag(scale / np.where(sd > 0, sd, 1.0))
        self.train = df.select(F.col(key).alias("p_key"), self.vector().alias("p_vec"), F.col(self.target).cast("double").alias(self.target))
        return self

    def vector(self) -> Column:
        z = [F.col(f).cast("double") - F.lit(float(m)) for f, m in zip(self.features, self.mean, strict=True)]
        out = []
        for j in range(self.transform.shape[1]):
            v = F.lit(0.0)
            for i, c in enumerate(z):
                if self.transform[i, j]:
                    v = v + c * F.lit(float(self.transform[i, j]))
            out.append(v)
        return F.array(*out)

    def neighbors(self, df: DataFrame, key: str) -> DataFrame:
        """(q_id, p_id, distance, target, rank), ranks from 0."""
        q = df.select(F.col(key).alias("q_key"), self.vector().alias("q_vec"))
        return nearest(q, self.train, "q_key", "p_key", "q_vec", "p_vec", self.k, self.target)

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        near = self.neighbors(df, key)
        if self.weights == "uniform":
            value = F.avg(self.target)
        else:
            zero = F.max((F.col("distance") == 0).cast("int")) == 1
            value = F.when(zero, F.avg(F.when(F.col("distance") == 0, F.col(self.target)))).otherwise(F.try_divide(F.sum(F.try_divide(F.col(self.target), F.col("distance"))), F.sum(F.try_divide(F.lit(1.0), F.col("distance")))))
        return near.groupBy(F.col("q_id").alias(key)).agg(value.alias("prediction"))

    def score(self, df: DataFrame, key: str) -> float:
        """Mean squared error."""
        got = df.select(key, self.target).join(self.predict(df, key), key)
        return float(got.agg(F.avg((F.col(self.target) - F.col("prediction")) ** 2)).first()[0])
