"""A multilayer perceptron fitted by L-BFGS passes over matrices of rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.lineage import even_parts

#: Rows that go through the layers together, corrections that the curvature is made of, and steps that must still gain.
CHUNK, CORRECTIONS, RECENT = 2048, 10, 20
#: Features go through the layers in single precision, which halves their time; sums over blocks are in double.
KINDS = np.float32, np.int32, float
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``v, label, n`` as the bytes of up to ``CHUNK`` rows each."""
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            columns = part.column(0).flatten(), part.column(1), part.column(2)
            yield pa.record_batch([pa.array([c.to_numpy(zero_copy_only=False).astype(k).tobytes()], pa.binary()) for c, k in zip(columns, KINDS)], names=["v", "label", "n"])


def _block(row) -> Block:
    v, label, n = (np.frombuffer(row[c], k) for c, k in zip(("v", "label", "n"), KINDS))
    return v.reshape(len(n), -1), label, n


def layers_of(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the matrix and the offsets of each layer, in MLlib's order of the weights."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _through(steps: Sequence[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The values that enter each layer, and the logarithms of the classes' chances but for a number per row, the greatest 0."""
    acts = [x]
    for w, b in steps[:-1]:
        z = acts[-1] @ w
        z += b
        np.negative(z, out=z)
        np.minimum(z, 80.0, out=z)
        np.exp(z, out=z)
        z += 1.0
        acts.append(np.reciprocal(z, out=z))
    z = acts[-1] @ steps[-1][0]
    z += steps[-1][1]
    z -= z.max(1, keepdims=True)
    return acts, z


def loss_and_gradient(weights: np.ndarray, layers: Sequence[int], part: Iterator[Block]) -> np.ndarray:
    """Sums over the rows of a partition: their number, their cross-entropy and its gradient (sigmoid layers, softmax end).

    A block goes through the layers in the precision of its features.
    """
    total = np.zeros(2 + len(weights))
    slopes, of_kind = layers_of(total[2:], layers), {}
    for x, label, n in part:
        if x.dtype not in of_kind:
            of_kind[x.dtype] = layers_of(weights.astype(x.dtype), layers)
        steps = of_kind[x.dtype]
        acts, z = _through(steps, x)
        every = np.exp(z)
        size = every.sum(1, keepdims=True)
        at = np.arange(len(x)), label
        total[0] += n.sum()
        total[1] += float(n @ (np.log(size[:, 0]) - z[at]).astype(float))
        error = every
        error /= size
        error[at] -= 1.0
        error *= n[:, None].astype(x.dtype)
        ones = np.ones(len(x), x.dtype)
        for i in range(len(steps) - 1, -1, -1):
            slopes[i][0][...] += acts[i].T @ error
            slopes[i][1][...] += ones @ error
            if i:
                error = error @ steps[i][0].T
                error *= acts[i]
                error *= np.subtract(1.0, acts[i], out=acts[i])
    return total


def outcomes(weights: np.ndarray, layers: Sequence[int], part: Iterator[Block]) -> np.ndarray:
    """How many rows of a partition have each label (rows) and are taken for each class (columns)."""
    steps, total = layers_of(weights, layers), np.zeros((layers[-1], layers[-1]))
    for x, label, n in part:
        np.add.at(total, (label, _through(steps, x.astype(float))[1].argmax(1)), n)
    return total


class PerceptronModel:
    """A fitted perceptron of MLlib that scores rows as matrices; ``counts`` are its :func:`outcomes` on the rows of the fit."""

    def __init__(self, model, counts: np.ndarray):
        self.model, self.counts = model, counts

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "model":
            raise AttributeError(name)
        return getattr(self.model, name)

    @property
    def shares(self):
        """The classes' chances, as a function of a matrix of features."""
        steps = layers_of(self.model.weights.toArray(), list(self.model.getLayers()))

        def walk(x: np.ndarray) -> np.ndarray:
            every = [np.exp(_through(steps, x[i:i + CHUNK])[1]) for i in range(0, len(x), CHUNK)]
            p = np.concatenate(every) if every else np.zeros((0, len(steps[-1][1])))
            return p / p.sum(1, keepdims=True)

        return walk

    def transform(self, df: DataFrame) -> DataFrame:
        shares, classes = self.shares, list(self.model.getLayers())[-1]

        @arrow_udf("array<double>")
        def chances(features: pa.Array) -> pa.Array:
            p = shares(features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, classes), pa.int32()), pa.array(p.ravel()))

        best = F.array_max(F.transform("_p", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
        rows = df.withColumn("_p", chances(vector_to_array("features")))
        return rows.withColumns({"probability": array_to_vector("_p"), "prediction": (-best["i"]).cast("double")}).drop("_p")


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 100, tol: float = 1e-6) -> np.ndarray:
    """L-BFGS with steps that keep the strong Wolfe conditions, ended as MLlib ends: no gain over recent steps or a flat gradient."""
    x = start.copy()
    value, slope = f(x)
    first, recent, pairs = value, deque([value], RECENT), deque(maxlen=CORRECTIONS)
    for _ in range(steps):
        if np.linalg.norm(slope) <= max(tol * abs(value), 1e-8):
            break
        way = -_inverse_curvature(pairs, slope)
        if way @ slope >= 0.0:
            pairs.clear()
            way = -slope
        found = _step(f, x, value, slope, way, 1.0 if pairs else 1.0 / max(np.linalg.norm(way), 1e-300))
        if found is None:
            break
        t, new, new_slope = found
        s, y = t * way, new_slope - slope
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs.append((s, y))
        x, value, slope = x + s, new, new_slope
        recent.append(value)
        if abs(value - max(recent)) <= tol * abs(first):
            break
    return x


def _inverse_curvature(pairs, slope: np.ndarray) -> np.ndarray:
    q, kept = slope.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        kept.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(kept)):
        q += s * (a - (y @ q) / (s @ y))
    return q


def _step(f, x: np.ndarray, value: float, slope: np.ndarray, way: np.ndarray, t: float, low: float = 1e-4, flat: float = 0.9, tries: int = 20):
    """``step, value, gradient`` along ``way`` by bracketing and halving, or None if nothing lowers the value."""
    begin, lo, hi, best = way @ slope, 0.0, np.inf, None
    for _ in range(tries):
        new, new_slope = f(x + t * way)
        end = way @ new_slope
        if not np.isfinite(new) or new > value + low * t * begin:
            hi = t
        else:
            if best is None or new < best[1]:
                best = t, new, new_slope
            if abs(end) <= flat * abs(begin):
                return t, new, new_slope
            lo, hi = (t, hi) if end < 0.0 else (lo, t)
        t = (lo + hi) / 2.0 if np.isfinite(hi) else 2.0 * t
    return best


def fit(est, counted: DataFrame):
    """MLlib's perceptron ``est`` trained on ``v, label, n`` (equal rows may be counted): an estimator at its end, a table to fit it on, and its outcomes.

    MLlib draws the first weights. Each step is one pass over matrices of rows that stay with the executors; a task hands
    on one sum of losses and gradients.
    """
    layers = list(est.getLayers())
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])
    bare = counted.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), float(c)) for c in range(layers[-1])], schema)
    start = est.copy().setMaxIter(0).fit(bare).weights.toArray()
    packed = even_parts(counted.select("v", "label", "n").mapInArrow(_packed, "v binary, label binary, n binary"))
    blocks = packed.rdd.map(_block).persist(StorageLevel.MEMORY_AND_DISK)

    def mean(weights: np.ndarray) -> tuple[float, np.ndarray]:
        total = blocks.mapPartitions(lambda part: [loss_and_gradient(weights, layers, part)]).reduce(np.add)
        return float(total[1] / total[0]), total[2:] / total[0]

    try:
        end = minimize(mean, start, est.getMaxIter(), est.getTol())
        counts = blocks.mapPartitions(lambda part: [outcomes(end, layers, part)]).reduce(np.add)
    finally:
        blocks.unpersist()
    return est.copy().setInitialWeights(Vectors.dense(end)).setMaxIter(0), bare, counts
