"""One-class novelty score with an RBF kernel, approximated by random Fourier features.

Training is full-batch gradient descent: each step sums per-task partial gradients in one
aggregate, so only a vector of ``n_features`` numbers reaches the driver per step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.operators import ranks


def _mapped(x: pd.Series, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return math.sqrt(2.0 / len(b)) * np.cos(np.vstack(x.to_numpy()) @ w + b)


@dataclass
class OneClassSvm:
    nu: float = 0.01
    n_features: int = 256
    steps: int = 30
    rate: float = 0.1
    gamma: float | None = None  # None: 1 / (columns * variance of all cells)
    seed: int = 42

    def fit(self, df: DataFrame, features: str = "features") -> OneClassModel:
        cell = F.explode(features)
        count, width = df.agg(F.count("*"), F.max(F.size(features))).first()
        gamma = self.gamma
        if gamma is None:
            variance = df.select(cell.alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
            gamma = 1.0 / (width * variance)
        rng = np.random.default_rng(self.seed)
        w = rng.normal(scale=math.sqrt(2.0 * gamma), size=(width, self.n_features))
        b = rng.uniform(0, 2 * math.pi, self.n_features)
        rows = df.select(F.col(features).alias("x"))
        # The mean map is the solution with equal multipliers: a sound start.
        weights, level = self._sums(rows, w, b, None, None)[0] / count, 0.0
        level = float(weights @ weights)
        for step in range(self.steps):
            below, n_below = self._sums(rows, w, b, weights, level)
            rate = self.rate / math.sqrt(step + 1.0)
            weights = weights - rate * (weights - below / (self.nu * count))
            level = level - rate * (n_below / (self.nu * count) - 1.0) * float(weights @ weights)
        model = OneClassModel(w, b, weights, 0.0)
        margin = model.decision(df, features, "_margin")
        model.level = ranks.exact_quantiles(margin, "_margin", {"q": self.nu}).first().q
        return model

    def _sums(self, rows: DataFrame, w, b, weights, level) -> tuple[np.ndarray, float]:
        """Sum of the mapped rows below the level (all rows at the start) and their number."""
        def partial(batches):
            total, n = np.zeros(len(b)), 0
            for pdf in batches:
                if len(pdf):
                    z = _mapped(pdf["x"], w, b)
                    part = z if weights is None else z[z @ weights < level]
                    total, n = total + part.sum(axis=0), n + len(part)
            yield pd.DataFrame({"i": np.arange(len(b) + 1), "v": np.append(total, n)})

        summed = rows.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        vector = np.zeros(len(b) + 1)
        vector[summed["i"].to_numpy()] = summed["v"].to_numpy()
        return vector[:-1], float(vector[-1])


@dataclass
class OneClassModel:
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    level: float

    def decision(self, df: DataFrame, features: str = "features", output: str = "score") -> DataFrame:
        """Distance to the boundary: higher is more normal, below 0 outside."""
        shared = df.sparkSession.sparkContext.broadcast((self.w, self.b, self.weights))
        level = self.level

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            w, b, weights = shared.value
            return pd.Series(_mapped(x, w, b) @ weights - level if len(x) else [], dtype=float)

        return df.withColumn(output, margin(F.col(features)))
