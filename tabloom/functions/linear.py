"""Least squares from second moments: one distributed pass, then a k x k solve."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame

from .columns import finite


@dataclass
class Moments:
    """Row count, means and centred cross products of complete rows."""

    names: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]

    def std(self, ddof: int = 0) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cross), 0.0) / max(1, self.n - ddof))

    def corr(self) -> np.ndarray:
        d = np.sqrt(np.maximum(np.diag(self.cross), 1e-300))
        return self.cross / np.outer(d, d)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Second moments over rows where every column is finite (JVM-side tree aggregation)."""
    cols = list(columns)
    rows = df.select(*[finite(c).alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    packed = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="v").transform(rows).select("v")
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(packed, "v"))
    stats = matrix.computeColumnSummaryStatistics()
    n = int(stats.count())
    mean = np.asarray(stats.mean(), dtype=float)
    cov = matrix.computeCovariance().toArray() if n > 1 else np.zeros((len(cols), len(cols)))
    return Moments(cols, n, mean, cov * max(0, n - 1))


@dataclass
class Fit:
    features: list[str]
    coef: np.ndarray
    intercept: float
    sse: float
    sst: float
    n: int

    def predict(self, x: Sequence[float]) -> float:
        return float(np.dot(self.coef, np.asarray(x, dtype=float)) + self.intercept)


def least_squares(m: Moments, features: Sequence[str], target: str, alpha: float = 0.0) -> Fit:
    """Ridge (or plain) regression with a free intercept."""
    xi, yi = m.index(features), m.names.index(target)
    sxx, sxy, syy = m.cross[np.ix_(xi, xi)], m.cross[xi, yi], m.cross[yi, yi]
    a = sxx + alpha * np.eye(len(xi))
    coef = np.linalg.solve(a, sxy) if np.linalg.matrix_rank(a) == len(xi) else np.linalg.lstsq(a, sxy, rcond=None)[0]
    sse = float(syy - 2 * coef @ sxy + coef @ sxx @ coef)
    return Fit(list(features), coef, float(m.mean[yi] - coef @ m.mean[xi]), max(sse, 0.0), float(syy), m.n)
