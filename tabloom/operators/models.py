"""Model training on MLlib: preprocessing, a model catalogue, search, calibration, ensembles and explanations."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.columns import clip, finite, ident, is_numeric, kind_of
from ..functions.hashing import uniform
from ..functions.lineage import cut_lineage, even_parts, stored_table
from ..functions.linear import least_squares, moments
from ..functions.quantiles import quantile_map
from . import evaluate as ev
from . import forest, perceptron
from .features import LIMIT, balanced_weights, categories, clean_category, ordinal_codes, ordinal_encode, stratified_split
from .nearest import EUCLID, nearest

# ---- preprocessing ----


@dataclass
class Preprocessor:
    """Median-imputed robust scaling, one-hot for up to 30 categories and sorted codes beyond."""

    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    hot: dict[str, list[str]] = field(default_factory=dict)
    coded: dict[str, DataFrame] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> "Preprocessor":
        p = cls()
        nums = [c for c in features if is_numeric(df.schema[c].dataType) or kind_of(df.schema[c].dataType) == "bool"]
        clean = df.select(*[clip(finite(c), -LIMIT, LIMIT).alias(c) for c in nums]) if nums else None
        first = quantile_map(clean, nums, [0.25, 0.5, 0.75]) if nums else {}
        fill = {c: first[c][1] if c in first else 0.0 for c in nums}
        # filling moves the quartiles of columns with gaps alone
        gaps = clean.agg(*[F.count_if(ident(c).isNull()).alias(c) for c in nums]).first() if nums else {}
        q = {c: first[c][::2] for c in nums if not gaps[c]} | quantile_map(clean.fillna(fill), [c for c in nums if gaps[c]], [0.25, 0.75])
        for c in nums:
            lo, hi = q[c]
            p.numeric[c] = (fill[c], fill[c], hi - lo if hi > lo else 1.0)
            p.names.append(c)
        for c in features:
            if c in nums:
                continue
            values = categories(df, c)
            if values is not None:
                p.hot[c] = values
                p.names += [f"{c}_{v}" for v in values]
            else:
                p.coded[c] = ordinal_codes(df, c)
                p.names.append(c)
        return p

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        for c, codes in self.coded.items():
            df = ordinal_encode(df, c, codes)
        parts = [(F.coalesce(clip(finite(c), -LIMIT, LIMIT), F.lit(fill)) - mid) / F.lit(float(iqr)) for c, (fill, mid, iqr) in self.numeric.items()]
        for c, values in self.hot.items():
            parts += [(clean_category(c) == F.lit(v)).cast("double") for v in values]
        parts += [ident(f"{c}_code").cast("double") for c in self.coded]
        return df.withColumn(out, array_to_vector(F.array(*parts))).drop(*[f"{c}_code" for c in self.coded])


def prepare(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], task: str = "classification", train_share: float = 0.8, seed: int = 42):
    """``train, test, preprocessor``: split, preprocessing fitted on the training rows, ``features`` and ``label`` columns.

    The split table is written once (Parquet in the shared folder): every fit and every
    metric afterwards reads it instead of replaying the split.
    """
    rows = df.withColumn("label", ident(label).cast("double")).where("label is not null")
    if task == "classification":
        marked = stratified_split(rows, "label", keys, train_share, seed)
    else:
        marked = rows.withColumn("is_train", uniform(*[ident(k) for k in keys], seed=seed) <= train_share)
    marked = stored_table(marked, "split")
    train = marked.where("is_train").drop("is_train")
    prep = Preprocessor.fit(train, features)
    return prep.transform(train), prep.transform(marked.where(~F.col("is_train")).drop("is_train")), prep


# ---- catalogue ----

COMMON = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}


def estimator(key: str, task: str, classes: int = 2, width: int = 1, rows: int = 1, label_std: float = 1.0, seed: int = 42, weight: str | None = None):
    """An unfitted MLlib estimator: logreg, linreg, dt, rf, et, gb (also xgb, lgbm, cat), svm or mlp.

    The boosted-tree keys share one gradient-boosted tree model; the SVM is linear.
    """
    w = {"weightCol": weight} if weight else {}
    boosted = key in ("gb", "xgb", "lgbm", "cat")
    if task == "classification":
        if key == "logreg":
            return mc.LogisticRegression(regParam=1.0 / rows, standardization=False, maxIter=200, **COMMON, **w)
        if key == "dt":
            return mc.DecisionTreeClassifier(maxDepth=5, seed=seed, **COMMON, **w)
        if key == "rf":
            return mc.RandomForestClassifier(numTrees=100, seed=seed, **COMMON, **w)
        if key == "et":
            return mc.RandomForestClassifier(numTrees=100, bootstrap=False, maxBins=32, seed=seed, **COMMON, **w)
        if boosted or key == "svm":
            base = mc.GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, **COMMON, **w) if boosted else mc.LinearSVC(regParam=1.0 / rows, **COMMON, **w)
            return base if classes == 2 else mc.OneVsRest(classifier=base, **COMMON)
        if key == "mlp":
            return mc.MultilayerPerceptronClassifier(layers=[width, 64, 32, classes], seed=seed, maxIter=100, **COMMON)
    else:
        if key == "linreg":
            return mr.LinearRegression(regParam=max(label_std, 1e-12) / rows, standardization=False, solver="normal", **COMMON, **w)
        if key == "dt":
            return mr.DecisionTreeRegressor(maxDepth=5, seed=seed, **COMMON, **w)
        if key in ("rf", "et"):
            more = {"bootstrap": False, "maxBins": 32} if key == "et" else {}
            return mr.RandomForestRegressor(numTrees=100, seed=seed, **more, **COMMON, **w)
        if boosted:
            return mr.GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, **COMMON, **w)
    raise ValueError(f"no {task} model {key!r}")


class NeighbourModel:
    """k nearest neighbours behind the interface of a fitted MLlib model; the training rows stay a distributed table."""

    def __init__(self, train: DataFrame, task: str, classes: int, k: int = 5):
        self.train, self.task, self.classes, self.k = cut_lineage(train.select("features", "label")), task, classes, k

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for classes, ``probability``: the neighbours' shares, ties to the smaller class."""
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        near = _neighbours(self.train, rows, "_row", self.k)
        if self.task == "regression":
            found = near.groupBy("_row").agg(F.avg("label").alias("prediction"))
        else:
            share = F.array(*[F.avg((F.col("label") == c).cast("double")) for c in range(self.classes)])
            best = F.array_max(F.transform("p", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
            found = near.groupBy("_row").agg(share.alias("p")).select("_row", array_to_vector("p").alias("probability"), (-best["i"]).cast("double").alias("prediction"))
        return rows.join(found, "_row").drop("_row")


#: Trees see no more of a row than the bins of its features, its label and its weight. A forest draws rows by their number.
BINNED, BINS = ("dt", "et", "rf", "gb", "xgb", "lgbm", "cat"), 32


class BinnedModel:
    """A tree model over bin numbers behind the interface of a fitted MLlib model; ``cuts`` are each feature's bin ends.

    ``rows`` are the counted bins that it was fitted on.
    """

    def __init__(self, model, cuts: list[list[float]], rows: DataFrame):
        self.model, self.cuts, self.rows = model, cuts, rows

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "model":
            raise AttributeError(name)
        return getattr(self.model, name)

    def transform(self, df: DataFrame) -> DataFrame:
        rows = _with_bins(df.withColumn("_values", F.col("features")), self.cuts)
        return self.model.transform(rows.withColumn("features", array_to_vector("_b")).drop("_b")).withColumn("features", F.col("_values")).drop("_values")

    @property
    def shares(self):
        """What :func:`scored` has as ``probs``, as a function of a matrix of features; forests and single trees have it."""
        if isinstance(self.model, forest.ForestModel):
            walk = self.model.shares
        elif isinstance(self.model, mc.DecisionTreeClassificationModel):
            walk = _tree_shares(self.model._java_obj.rootNode())
        else:
            raise AttributeError("shares")
        ends = [np.array(c) for c in self.cuts]
        return lambda x: walk(np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(ends)], axis=1).astype(np.int32))


def _tree_shares(root):
    """Class shares of rows of bin numbers by a fitted tree of MLlib."""
    feature, cut, turn, share, todo = [], [], [], [], [root]
    while todo:
        node = todo.pop(0)
        leaf = node.subtreeDepth() == 0
        feature.append(-1 if leaf else node.split().featureIndex())
        cut.append(0.0 if leaf else node.split().threshold())
        turn.append(0 if leaf else len(feature) + len(todo))
        share.append(_leaf_values(node, "classification"))
        if not leaf:
            todo += [node.leftChild(), node.rightChild()]
    feature, cut, turn, share, depth = np.array(feature), np.array(cut), np.array(turn), np.array(share), root.subtreeDepth()

    def walk(bins: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = feature[node]
            node = np.where(f >= 0, turn[node] + (bins[at, f] > cut[node]), node)
        return share[node]

    return walk


def _with_bins(df: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``df`` with ``_b``, the number of cuts below each feature."""
    wide = df.withColumn("_v", vector_to_array("features"))
    wide = wide.select(*df.columns, *[F.col("_v")[i].alias(f"_v{i}") for i in range(len(cuts))])
    # buckets are closed on the left, bins on the right
    ends = [[-math.inf, *[math.nextafter(x, math.inf) for x in c], math.inf] for c in cuts]
    cut = [i for i, c in enumerate(cuts) if c]
    if cut:
        wide = Bucketizer(splitsArray=[ends[i] for i in cut], inputCols=[f"_v{i}" for i in cut], outputCols=[f"_b{i}" for i in cut]).transform(wide)
    return wide.select(*df.columns, F.array(*[F.col(f"_b{i}") if c else F.lit(0.0) for i, c in enumerate(cuts)]).alias("_b"))


def bin_cuts(train: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """The ends of up to ``bins`` bins per feature: between all values if they are few, else at even ranks."""
    grid = [i / bins for i in range(1, bins)]
    rows = train.select(vector_to_array("features").alias("v"))
    s = rows.agg(*[x for i in range(width) for x in (F.approx_count_distinct(F.col("v")[i]).alias(f"d{i}"), F.max(F.col("v")[i]).alias(f"hi{i}"))]).first()
    few = [i for i in range(width) if s[f"d{i}"] <= 2 * bins]
    values = rows.agg(*[F.sort_array(F.collect_set(F.col("v")[i])).alias(f"v{i}") for i in few]).first() if few else {}
    # a feature cut between all its values needs no ranks
    many = [i for i in range(width) if i not in few or len(values[f"v{i}"]) > bins]
    ranks = rows.agg(*[F.percentile_approx(F.col("v")[i], grid, 10_000).alias(f"q{i}") for i in many]).first() if many else {}
    out = []
    for i in range(width):
        if i in many:
            out.append(sorted({q for q in ranks[f"q{i}"] or [] if q < s[f"hi{i}"]}))
        else:
            out.append([(a + b) / 2.0 for a, b in zip(values[f"v{i}"], values[f"v{i}"][1:])])
    return out


def _binned(train: DataFrame, cuts: list[list[float]], weight: str | None, times: str | None = None) -> DataFrame:
    """``features, label, weight, n``: the distinct rows of bin numbers with the rows behind each, and their weight."""
    n = ident(times) if times else F.lit(1)
    rows = _with_bins(train.select("features", "label", ((ident(weight) if weight else F.lit(1.0)) * n).alias("w"), n.cast("long").alias("n")), cuts)
    rows = rows.groupBy("_b", "label").agg(F.sum("w").alias("weight"), F.sum("n").alias("n"))
    return stored_table(rows.select(array_to_vector("_b").alias("features"), "label", "weight", "n"), "bins")


def count_bins(train: DataFrame, width: int, weight: str | None = None) -> tuple[list[list[float]], DataFrame]:
    """The bin ends of the features and the counted bins, which all trees of one table share."""
    cuts = bin_cuts(train, width)
    return cuts, _binned(train, cuts, weight)


def _shared_bins(train: DataFrame, models: Sequence[str], task: str) -> tuple[list[list[float]], DataFrame] | None:
    """Counted bins for a list of models, if several of them are trees of classes."""
    if task != "classification" or sum(k in BINNED for k in models) < 2:
        return None
    return count_bins(train, len(train.select(vector_to_array("features").alias("v")).first()["v"]))


def _shared_rows(train: DataFrame, models: Sequence[str], task: str) -> FitRows | None:
    """Matrices of the rows for a list of models, if several of them are linear models of two classes."""
    if task != "classification" or sum(k in LINEAR for k in models) < 2 or (train.agg(F.max("label")).first()[0] or 0) > 1:
        return None
    return _fit_rows(train)


class LogisticModel:
    """A fitted two-class logistic regression behind the interface of an MLlib model."""

    def __init__(self, weights: np.ndarray):
        self.coefficients, self.intercept = DenseVector(weights[:-1]), float(weights[-1])

    def transform(self, df: DataFrame) -> DataFrame:
        wide = df.withColumn("_v", vector_to_array("features"))
        z = sum((F.col("_v")[i] * float(c) for i, c in enumerate(self.coefficients)), F.lit(self.intercept))
        wide = wide.withColumn("_p", 1.0 / (1.0 + F.exp(-z)))
        return wide.withColumns({"probability": array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_v", "_p")

    def shares(self, x: np.ndarray) -> np.ndarray:
        """What :func:`scored` has as ``probs``, for a matrix of features."""
        return _sigmoids(x @ self.coefficients.toArray() + self.intercept)


class HingeModel:
    """A fitted two-class linear support vector machine behind the interface of an MLlib model."""

    def __init__(self, weights: np.ndarray):
        self.coefficients, self.intercept = DenseVector(weights[:-1]), float(weights[-1])

    def transform(self, df: DataFrame) -> DataFrame:
        wide = df.withColumn("_v", vector_to_array("features"))
        wide = wide.withColumn("_z", sum((F.col("_v")[i] * float(c) for i, c in enumerate(self.coefficients)), F.lit(self.intercept)))
        return wide.withColumns({"rawPrediction": array_to_vector(F.array(-F.col("_z"), F.col("_z"))), "prediction": (F.col("_z") > 0.0).cast("double")}).drop("_v", "_z")

    def shares(self, x: np.ndarray) -> np.ndarray:
        return _sigmoids(x @ self.coefficients.toArray() + self.intercept)


def _sigmoids(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = 1.0 / (1.0 + np.exp(-z))
    return np.stack([1.0 - p, p], axis=1)


#: Rows of a matrix that a pass takes at once.
CHUNK = 4096


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``v, label, weight, fold`` as the bytes of up to ``CHUNK`` rows each; weights that are all 1 are left out."""
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            v, y, w, f = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0).slice(i, CHUNK).flatten(), *(batch.column(j).slice(i, CHUNK) for j in (1, 2, 3))))
            some = v.astype(float).tobytes(), y.astype(np.float32).tobytes(), b"" if (w == 1.0).all() else w.astype(float).tobytes(), f.astype(np.int32).tobytes()
            yield pa.record_batch([pa.array([x], pa.binary()) for x in some], names=["v", "label", "weight", "fold"])


def _block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    y = np.frombuffer(row["label"], np.float32)
    return np.frombuffer(row["v"]).reshape(len(y), -1), y, np.frombuffer(row["weight"]) if row["weight"] else None, np.frombuffer(row["fold"], np.int32)


class FitRows:
    """Rows as matrices that stay with the executors for the passes of linear fits."""

    def __init__(self, df: DataFrame):
        self.width = len(df.select("v").first()["v"])
        packed = even_parts(df.mapInArrow(_packed, "v binary, label binary, weight binary, fold binary"))
        self.blocks = packed.rdd.map(_block).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> "FitRows":
        return self

    def __exit__(self, *_) -> None:
        self.blocks.unpersist()

    def added(self, sums) -> np.ndarray:
        """The partial sums of all tasks, one short array each."""
        return self.blocks.mapPartitions(lambda part: [sums(part)]).reduce(np.add)

    def curved(self, point: np.ndarray, left: np.ndarray, curve) -> np.ndarray:
        """For each row of ``point``: its weight, two losses, the gradient and the curvature matrix over the rows outside its fold.

        ``curve(y, z, job)`` has the loss, another loss, the slope and the curvature at the scores of some rows.
        """
        d = point.shape[1]

        def sums(part: Iterator) -> np.ndarray:
            total = np.zeros((len(point), 3 + d + d * d))
            for x, y, w, f in part:
                z = x @ point[:, :-1].T + point[:, -1]
                for j, t in enumerate(total):
                    loss, other, slope, bend = curve(y, z[:, j], j)
                    out = f == left[j]
                    use = w
                    if out.any():
                        use = np.where(out, 0.0, 1.0 if w is None else w)
                    if use is not None:
                        loss, other, slope, bend = loss * use, other * use, slope * use, bend * use
                    t[:3] += len(y) if use is None else use.sum(), loss.sum(), other.sum()
                    t[3:2 + d] += slope @ x
                    t[2 + d] += slope.sum()
                    h = t[3 + d:].reshape(d, d)
                    some = np.flatnonzero(bend)
                    # a hinge bends at few rows
                    rows, bend = (x[some], bend[some]) if 2 * len(some) < len(x) else (x, bend)
                    h[:-1, :-1] += rows.T @ (rows * bend[:, None])
                    edge = bend @ rows
                    h[:-1, -1] += edge
                    h[-1, :-1] += edge
                    h[-1, -1] += bend.sum()
            return total

        return self.added(sums)


def _log_loss(y: np.ndarray, z: np.ndarray, _: int) -> tuple[np.ndarray, ...]:
    e = np.exp(-np.abs(z))
    p = np.where(z >= 0, 1.0, e) / (1.0 + e)
    loss = np.maximum(z, 0.0) - y * z + np.log1p(e)
    return loss, loss, p - y, p * (1.0 - p)


def _newton(rows: FitRows, width: int, jobs: Sequence[tuple[int, float]], passes: int = 100, tol: float = 1e-8) -> np.ndarray:
    """Weights, the intercept last, of L2 logistic fits that share each pass over the rows.

    A job ``(fold, strength)`` leaves out the rows of its fold and penalises the coefficients of the mean loss. A task
    sends one partial sum of the losses, gradients and curvatures of all jobs; a step that doesn't lower the loss is halved.
    """
    d, out = width + 1, np.array([f for f, _ in jobs])
    strength = np.array([s for _, s in jobs])[:, None] * np.append(np.ones(width), 0.0)
    at = np.zeros((len(jobs), d))
    kept, best, open_ = at.copy(), np.full(len(jobs), np.inf), np.ones(len(jobs), dtype=bool)
    for _ in range(passes):
        which = np.flatnonzero(open_)
        for j, t in zip(which, rows.curved(at[which], out[which], _log_loss)):
            n = max(t[0], 1e-300)
            loss = t[1] / n + 0.5 * float(strength[j] @ at[j] ** 2)
            if loss > best[j] + 1e-12 * abs(best[j]):
                at[j] = (at[j] + kept[j]) / 2.0
                open_[j] = float(np.abs(at[j] - kept[j]).max()) > tol
                continue
            best[j], kept[j] = loss, at[j].copy()
            h = t[3 + d:].reshape(d, d) / n + np.diag(strength[j])
            step = np.linalg.lstsq(h, t[3:3 + d] / n + strength[j] * at[j], rcond=None)[0]
            open_[j] = float(np.abs(step).max()) > tol * max(1.0, float(np.abs(at[j]).max()))
            at[j] = at[j] - step
        if not open_.any():
            break
    return np.where(open_[:, None], kept, at)


#: Half the width that the corner of a hinge is rounded over, from the first passes to the last, and by which factor it shrinks.
ROUND, SHARP, SHRINK = 1.0, 1e-4, 4.0


class _HingeFit:
    """One hinge fit between passes: Newton steps on the rounded hinge, damped where one doesn't lower it."""

    def __init__(self, width: int, strength: float):
        self.at = self.kept = self.lead = np.zeros(width + 1)
        self.strength, self.h, self.damp, self.open = strength, ROUND, 0.0, True
        self.value, self.least, self.penalty = np.inf, np.inf, None

    def take(self, t: np.ndarray) -> None:
        """Moves on by the sums of a pass at ``self.at``."""
        d, n = len(self.at), max(t[0], 1e-300)
        slope, bend = t[3:3 + d] / n, t[3 + d:].reshape(d, d) / n
        if self.penalty is None:
            # every row bends by a half at the first point, so these are the second moments
            moments = 2.0 * bend
            var = np.maximum(np.diag(moments) - moments[-1] ** 2, 0.0) * n / max(n - 1.0, 1.0)
            self.free = np.append(var[:-1] > 1e-12 * np.diag(moments)[:-1], True)
            self.penalty = self.strength * np.append(var[:-1], 0.0)
        cost = 0.5 * float(self.penalty @ self.at**2)
        if t[2] / n + cost < self.least:
            self.least, self.lead = t[2] / n + cost, self.at
        if t[1] / n + cost > self.value * (1.0 + 1e-12):
            self.damp = max(10.0 * self.damp, 1e-3 * float(np.trace(self.bend)) / d)
            self.open = self.damp < 1e12
        else:
            self.kept, self.value, self.damp = self.at, t[1] / n + cost, self.damp / 10.0 if self.damp > 1e-9 else 0.0
            self.slope, self.bend = slope + self.penalty * self.at, bend + np.diag(self.penalty)
        f = self.free
        step = np.zeros(d)
        step[f] = np.linalg.lstsq(self.bend[np.ix_(f, f)] + self.damp * np.eye(int(f.sum())), self.slope[f], rcond=None)[0]
        gain = 0.5 * float(self.slope @ step)
        if self.kept is self.at and gain <= 1e-3 * self.h * max(self.value, 1e-9):
            if self.h <= SHARP:
                self.open = self.open and gain > 1e-9 * self.value
            else:
                # near enough: the step goes on with a sharper corner, whose first value is taken as it is
                self.h, self.value = max(SHARP, self.h / SHRINK), np.inf
        self.at = self.kept - step


def _hinge(rows: FitRows, width: int, jobs: Sequence[tuple[int, float]], passes: int = 200) -> np.ndarray:
    """Weights, the intercept last, of linear support vector machines that share each pass over the rows, as in :func:`_newton`.

    The loss is MLlib's: the mean hinge and the strength times half the squares of the coefficients of standardised
    features; a feature without spread has none. Its corner is rounded over a width that shrinks from pass to pass, so that
    Newton's steps apply; the point of the least hinge itself is returned.
    """
    fits = [_HingeFit(width, s) for _, s in jobs]
    for _ in range(passes):
        which = [j for j, x in enumerate(fits) if x.open]
        if not which:
            break
        width_of = [fits[j].h for j in which]

        def curve(y: np.ndarray, z: np.ndarray, j: int, width_of=width_of) -> tuple[np.ndarray, ...]:
            h, sign = width_of[j], 2.0 * y - 1.0
            short = 1.0 - sign * z
            inside = np.abs(short) <= h
            part = np.where(inside, (short + h) / (2.0 * h), short > 0.0)
            return np.where(inside, h * part * part, np.maximum(short, 0.0)), np.maximum(short, 0.0), -sign * part, inside / (2.0 * h)

        out = np.array([jobs[j][0] for j in which])
        for j, t in zip(which, rows.curved(np.array([fits[j].at for j in which]), out, curve)):
            fits[j].take(t)
    return np.array([x.lead for x in fits])


def _fit_rows(train: DataFrame, weight: str | None = None, fold: str | None = None) -> FitRows:
    """``v, label, weight, fold`` packed for the passes of fits."""
    marks = (ident(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), (ident(fold) if fold else F.lit(-1)).alias("fold")
    return FitRows(train.select(vector_to_array("features").alias("v"), "label", *marks))


#: Linear models of two classes: how they are fitted and scored.
LINEAR = {"logreg": (_newton, LogisticModel), "svm": (_hinge, HingeModel)}
#: No row is in this fold.
NO_FOLD = -2


def _linear(key: str, rows: FitRows, jobs: Sequence[tuple[int, float]]) -> list:
    """A model per job ``(fold left out, strength)``, fitted in shared passes."""
    fit, kind = LINEAR[key]
    return [kind(w) for w in fit(rows, rows.width, jobs)]


#: Bins of a score's range in the curves of the folds; MLlib's evaluator joins scores to a thousand.
CURVE_BINS = 1 << 14


def _fold_areas(rows: FitRows, weights: np.ndarray, jobs: Sequence[tuple[int, float]]) -> np.ndarray:
    """ROC-AUC of each logistic fit on the rows of its fold, scores in ``CURVE_BINS`` bins (ties count half)."""
    fold = np.array([f for f, _ in jobs])

    def spans(part: Iterator) -> list[np.ndarray]:
        lo, hi = np.full(len(fold), np.inf), np.full(len(fold), -np.inf)
        for x, _, _, _ in part:
            z = x @ weights[:, :-1].T + weights[:, -1]
            lo, hi = np.minimum(lo, z.min(0)), np.maximum(hi, z.max(0))
        return [np.array([lo, -hi])]

    low, high = rows.blocks.mapPartitions(spans).reduce(np.minimum)
    low, high = np.where(np.isfinite(low), low, 0.0), np.where(np.isfinite(high), -high, 0.0)
    scale = CURVE_BINS / np.where(high > low, high - low, 1.0)

    def tally(part: Iterator) -> np.ndarray:
        total = np.zeros((len(fold), 2 * CURVE_BINS))
        for x, y, w, f in part:
            for j in range(len(fold)):
                mine = f == fold[j]
                z = x[mine] @ weights[j, :-1] + weights[j, -1]
                b = np.clip(((z - low[j]) * scale[j]).astype(int), 0, CURVE_BINS - 1)
                total[j] += np.bincount(2 * b + (y[mine] > 0), None if w is None else w[mine], 2 * CURVE_BINS)
        return total

    # the curves of all fits are bounded by the bins
    curve = rows.added(tally)
    neg, pos = curve[:, 0::2], curve[:, 1::2]
    ahead = np.cumsum(neg, axis=1) - neg / 2.0
    pairs = pos.sum(1) * neg.sum(1)
    return np.where(pairs > 0, (pos * ahead).sum(1) / np.maximum(pairs, 1.0), 1.0)


#: Scores that a task sorts in the areas of held-out rows, and rows whose scores are sent together.
AREA_ROWS, SENT = 1_000_000, 1 << 18


def _exact_areas(rows: FitRows, models: Sequence, folds: Sequence[int]) -> list[float | None]:
    """ROC-AUC of each linear model on the rows of its fold, ties counting half; None without rows of both classes.

    A histogram of the scores cuts them into stretches of bounded size; a task sorts the scores of a stretch.
    """
    weights = np.array([[*m.coefficients.toArray(), m.intercept] for m in models])
    span = lambda z: np.array([z.min(initial=np.inf), -z.max(initial=-np.inf)])

    def scores(part: Iterator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for x, y, _, f in part:
            for j, w in enumerate(weights):
                mine = f == folds[j]
                yield j, x[mine] @ w[:-1] + w[-1], y[mine] > 0

    def spans(part: Iterator) -> list[np.ndarray]:
        out = np.full((len(weights), 2), np.inf)
        for j, z, _ in scores(part):
            out[j] = np.minimum(out[j], span(z))
        return [out]

    low, high = rows.blocks.mapPartitions(spans).reduce(np.minimum).T * [[1.0], [-1.0]]
    scale = CURVE_BINS / np.where((high > low) & np.isfinite(high - low), high - low, 1.0)
    place = lambda j, z: np.clip((z - low[j]) * scale[j], 0, CURVE_BINS - 1).astype(np.int64)

    def tally(part: Iterator) -> np.ndarray:
        total = np.zeros((len(weights), CURVE_BINS))
        for j, z, _ in scores(part):
            total[j] += np.bincount(place(j, z), minlength=CURVE_BINS)
        return total

    stretch = (np.cumsum(rows.added(tally), axis=1) // AREA_ROWS).astype(np.int64)

    def sent(part: Iterator) -> Iterator[tuple[tuple[int, int], tuple[bytes, bytes]]]:
        held: dict[int, list] = {}

        def flush(j: int) -> Iterator:
            z, y = (np.concatenate(c) for c in zip(*held.pop(j)))
            z, own = np.unique(z, return_inverse=True)
            n = np.stack([np.bincount(own, ~y, len(z)), np.bincount(own, y, len(z))], axis=1)
            to = stretch[j][place(j, z)]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for a, b in zip(cuts, [*cuts[1:], len(z)]):
                yield (j, int(to[a])), (z[a:b].tobytes(), n[a:b].tobytes())

        for j, z, y in scores(part):
            if len(z):
                held.setdefault(j, []).append((z, y))
                if sum(len(c) for c, _ in held[j]) >= SENT:
                    yield from flush(j)
        for j in list(held):
            yield from flush(j)

    def counted(found) -> tuple[float, float, float]:
        z, n = (np.concatenate(c) for c in zip(*((np.frombuffer(a), np.frombuffer(b).reshape(-1, 2)) for a, b in found)))
        n = n[np.argsort(z, kind="stable")]
        # equal scores are one
        first = np.flatnonzero(np.append(True, np.diff(np.sort(z)) > 0))
        neg, pos = np.add.reduceat(n, first).T
        return float(neg.sum()), float(pos.sum()), float(pos @ (np.cumsum(neg) - neg / 2.0))

    parts = max(rows.blocks.getNumPartitions(), len(weights))
    found = sorted(rows.blocks.mapPartitions(sent).groupByKey(parts).mapValues(counted).collect())
    out: list[float | None] = []
    for j in range(len(weights)):
        neg = pos = ahead = 0.0
        for (i, _), (n, p, inside) in found:
            if i == j:
                neg, pos, ahead = neg + n, pos + p, ahead + inside + p * neg
        out.append(ahead / (pos * neg) if pos * neg else None)
    return out


def equal_rows(df: DataFrame, times: str | None = None) -> DataFrame:
    """``v, label, n``: distinct rows of features and label with how often they occur, stored."""
    rows = df.select(vector_to_array("features").alias("v"), "label", (ident(times) if times else F.lit(1)).cast("long").alias("n"))
    return stored_table(rows.groupBy("v", "label").agg(F.sum("n").alias("n")), "equal")


#: Equal rows are counted if no more than this share of them is left: the count is worth about a tenth of the passes of a fit.
WORTH = 0.8


def _perceptron_rows(train: DataFrame, n: int) -> DataFrame:
    """``v, label, n`` of all rows: distinct ones counted, or each by itself where hardly any are equal."""
    v = vector_to_array("features")
    if train.agg(F.approx_count_distinct(F.xxhash64(v, "label"))).first()[0] <= WORTH * n:
        return equal_rows(train)
    return train.select(v.alias("v"), "label", F.lit(1).cast("long").alias("n"))


def fit_model(
    key: str, train: DataFrame, task: str = "classification", weighted: bool = False, seed: int = 42,
    bins: tuple[list[list[float]], DataFrame] | None = None, packed: FitRows | None = None,
):
    """Fit one catalogue model on ``features, label`` (balanced row weights on request; neighbours have none).

    ``bins`` are the counted bins of ``train`` and ``packed`` its matrices, both without weights, if they are known.
    """
    if key == "knn":
        top = train.agg(F.max("label")).first()[0] if task == "classification" else 0
        return NeighbourModel(train, task, int(top or 0) + 1)
    s = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sd"), F.max("label").alias("top")).first()
    classes = int(s["top"]) + 1 if task == "classification" else 0
    width = len(train.select(vector_to_array("features").alias("v")).first()["v"])
    if weighted and task == "classification":
        train = balanced_weights(train, "label")
    # distinct regression labels are as many as rows, so only classes are counted together
    binned = task == "classification" and (classes <= 2 and key in BINNED or key in ("dt", "et", "rf"))
    est = estimator(key, task, max(2, classes), width, max(1, s["n"]), s["sd"] or 1.0, seed, "weight" if binned or (weighted and key != "mlp") else None)
    if binned:
        cuts, rows = bins if bins and not weighted else count_bins(train, width, "weight" if weighted else None)
        if key == "rf":
            return BinnedModel(forest.fit(rows, width, max(2, classes), 1 + max(map(len, cuts)), est.getNumTrees(), est.getMaxDepth(), seed), cuts, rows)
        return BinnedModel(_fitted(est, rows), cuts, rows)
    if key in LINEAR and classes <= 2:
        with nullcontext(packed) if packed and not weighted else _fit_rows(train, "weight" if weighted else None) as rows:
            return _linear(key, rows, [(NO_FOLD, est.getRegParam())])[0]
    if key == "mlp":
        est, bare, counts = perceptron.fit(est, _perceptron_rows(train, s["n"]))
        return perceptron.PerceptronModel(_fitted(est, bare), counts)
    return _fitted(est, train)


def _fitted(est, train: DataFrame, params: dict | None = None):
    """``est`` fitted, without its training summary.

    A summary of two classes holds its session, which travels with the model to the tasks; once an ``Observation`` was
    used in that session it can't be serialised, and no row could be scored.
    """
    model = est.fit(train, params or {})
    none = train.sparkSession.sparkContext._jvm.scala.Option.empty()
    for m in getattr(model, "models", [model]):
        if getattr(m, "hasSummary", False):
            m._java_obj.setSummary(none)
    return model


def scored(model, df: DataFrame, probs: str = "probs") -> DataFrame:
    """``prediction`` plus ``probs``: class probabilities as an array (one-hot of the prediction when a model has none)."""
    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn(probs, vector_to_array("probability"))
    if "rawPrediction" in out.columns:
        m = vector_to_array("rawPrediction")
        two = F.size(m) == 2
        return out.withColumn(probs, F.when(two, F.array(1.0 / (1.0 + F.exp(m[1])), 1.0 / (1.0 + F.exp(-m[1])))).otherwise(
            F.transform(m, lambda x: F.exp(x) / F.aggregate(m, F.lit(0.0), lambda a, b: a + F.exp(b)))
        ))
    return out


def _neighbours(train: DataFrame, test: DataFrame, key: str, k: int) -> DataFrame:
    """``key, label`` of the k nearest training rows, ties by the smaller label; both tables stay distributed."""
    points = lambda df, c, name: df.select(ident(c).alias(name), vector_to_array("features").alias("v"))
    near = nearest(points(train, "label", "d"), "d", "v", points(test, key, "q"), "q", "v", k, EUCLID)
    return near.select(F.col("q").alias(key), F.col("d").alias("label"))


def nearest_neighbours(train: DataFrame, test: DataFrame, key: str, task: str = "classification", k: int = 5) -> DataFrame:
    """k-nearest-neighbour vote (ties to the smaller label) or mean per test row."""
    votes = _neighbours(train, test, key, k)
    if task == "regression":
        return votes.groupBy(key).agg(F.avg("label").alias("prediction"))
    tally = votes.groupBy(key, "label").agg(F.count("*").alias("n"))
    return tally.groupBy(key).agg(F.max(F.struct("n", (-F.col("label")).alias("o"))).alias("b")).select(key, (-F.col("b.o")).alias("prediction"))


# ---- search, validation, calibration, ensemble ----

#: What sets the draw of the folds apart from that of the split.
FOLD_SEED = 104_729

# Search grids, by MLlib parameter name.
GRIDS = {
    "logreg": {"regParam": [100.0, 10.0, 1.0, 0.2, 0.1, 0.02]},
    "dt": {"maxDepth": [3, 5, 7, 10], "minInstancesPerNode": [1, 2, 4]},
    "rf": {"numTrees": [50, 100, 150, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4]},
    "et": {"numTrees": [50, 100, 150, 200], "maxDepth": [5, 10, 15, 20], "minInstancesPerNode": [1, 2, 5]},
    "gb": {"maxIter": [50, 100, 150], "stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [3, 5, 7]},
    "xgb": {"maxIter": [50, 100, 150, 200], "maxDepth": [3, 5, 7, 9], "stepSize": [0.01, 0.05, 0.1, 0.2], "subsamplingRate": [0.6, 0.8, 1.0]},
    "lgbm": {"maxIter": [50, 100, 150, 200], "maxDepth": [5, 10, 20], "stepSize": [0.01, 0.05, 0.1, 0.2], "subsamplingRate": [0.6, 0.8, 1.0]},
    "cat": {"maxIter": [50, 100, 150], "maxDepth": [4, 6, 8], "stepSize": [0.01, 0.05, 0.1]},
    "svm": {"regParam": [10.0, 1.0, 0.1, 0.02]},
    "mlp": {"layers": [[32], [64, 32], [100]], "tol": [1e-4, 1e-6]},
    "linreg": {"fitIntercept": [True, False]},
}


def _evaluator(task: str, classes: int):
    if task == "regression":
        return RegressionEvaluator(metricName="r2")
    return BinaryClassificationEvaluator() if classes == 2 else MulticlassClassificationEvaluator(metricName="f1")


def _folds(df: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """Folds are drawn apart from the split: training rows hold its smallest draws, so those would leave the last fold short."""
    return df.withColumn("fold", F.floor(uniform(*[ident(c) for c in keys], seed=seed + FOLD_SEED) * k).cast("int"))


def _fold_scores(est, maps: Sequence[dict], marked: DataFrame, folds: int, evaluator, parallelism: int = 1) -> np.ndarray:
    """A score per fold and parameter map, ``parallelism`` fits at a time.

    Folds are read from their table and not cached: an estimator stores the blocks it iterates over only of a table that isn't.
    """
    if isinstance(est, mc.LogisticRegression) and isinstance(evaluator, BinaryClassificationEvaluator):
        # fits of two classes share their passes
        jobs = [(f, est.copy(m).getRegParam()) for f in range(folds) for m in maps]
        with _fit_rows(marked, fold="fold") as rows:
            return _fold_areas(rows, _newton(rows, rows.width, jobs), jobs).reshape(folds, len(maps))

    @inheritable_thread_target(marked.sparkSession)
    def score(job: tuple[int, dict]) -> float:
        own, held = marked.where(F.col("fold") != job[0]).drop("fold"), marked.where(F.col("fold") == job[0]).drop("fold")
        return evaluator.evaluate(_fitted(est, own, job[1]).transform(held))

    with ThreadPool(max(1, parallelism)) as pool:
        return np.array(pool.map(score, [(f, m) for f in range(folds) for m in maps], chunksize=1)).reshape(folds, len(maps))


def search(key: str, train: DataFrame, keys: Sequence[str], task: str = "classification", draws: int = 20, folds: int = 3, seed: int = 42, parallelism: int = 4):
    """Random search: up to ``draws`` seeded picks of the grid, each cross-validated on hash folds."""
    s = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sd"), F.max("label").alias("top")).first()
    classes = int(s["top"]) + 1 if task == "classification" else 0
    width = len(train.select(vector_to_array("features").alias("v")).first()["v"])
    est = estimator(key, task, max(2, classes), width, s["n"], s["sd"] or 1.0, seed)
    tuned = est.getClassifier() if isinstance(est, mc.OneVsRest) else est
    # strengths are per row, and hidden layers stand between the features and the classes
    fitted = {"regParam": lambda v: v / s["n"], "layers": lambda hidden: [width, *hidden, max(2, classes)]}
    grid = ParamGridBuilder()
    for name, values in GRIDS[key].items():
        grid = grid.addGrid(tuned.getParam(name), [fitted.get(name, lambda v: v)(v) for v in values])
    maps = grid.build()
    random.Random(seed).shuffle(maps)
    maps = maps[:draws]
    scores = _fold_scores(est, maps, _folds(train, keys, folds, seed), folds, _evaluator(task, classes), parallelism)
    mean, spread = scores.mean(0), scores.std(0)
    lead = maps[int(mean.argmax())]
    rows = [(i, {p.name: str(v) for p, v in m.items()}, float(a), float(d)) for i, (m, a, d) in enumerate(zip(maps, mean, spread))]
    if key == "logreg" and classes == 2:
        with _fit_rows(train) as fit_rows:
            model = _linear(key, fit_rows, [(NO_FOLD, est.copy(lead).getRegParam())])[0]
    else:
        model = _fitted(est, train, lead)
    return model, train.sparkSession.createDataFrame(rows, "draw int, params map<string,string>, score double, spread double")


def cross_validate(key: str, train: DataFrame, keys: Sequence[str], task: str = "classification", folds: int = 5, seed: int = 42) -> DataFrame:
    """Mean and spread of the fold scores of one model."""
    s = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sd"), F.max("label").alias("top")).first()
    classes = int(s["top"]) + 1 if task == "classification" else 0
    width = len(train.select(vector_to_array("features").alias("v")).first()["v"])
    est = estimator(key, task, max(2, classes), width, s["n"], s["sd"] or 1.0, seed)
    k = max(2, min(folds, 5))
    scores = _fold_scores(est, [{}], _folds(train, keys, k, seed), k, _evaluator(task, classes), 2)
    return train.sparkSession.createDataFrame([(key, k, float(scores.mean()), float(scores.std()))], "model string, folds int, score double, spread double")


def calibrate(key: str, train: DataFrame, keys: Sequence[str], folds: int = 3, seed: int = 42):
    """Platt scaling: a logistic fit of the label on out-of-fold scores, as ``(a, b)`` of sigmoid(a x logit + b)."""
    marked = _folds(train, keys, folds, seed)
    parts = None
    for f in range(folds):
        model = fit_model(key, marked.where(F.col("fold") != f).drop("fold"), seed=seed)
        held = scored(model, marked.where(F.col("fold") == f)).select("label", _logit(F.col("probs")[1]).alias("z"))
        parts = held if parts is None else parts.unionByName(held)
    lr = mc.LogisticRegression(featuresCol="v", labelCol="label", regParam=0.0).fit(parts.select("label", array_to_vector(F.array("z")).alias("v")))
    return float(lr.coefficients[0]), float(lr.intercept)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0 - 1e-12))
    return F.log(q / (1.0 - q))


def calibrated(df: DataFrame, a: float, b: float, probs: str = "probs") -> DataFrame:
    p = 1.0 / (1.0 + F.exp(-(_logit(ident(probs)[1]) * a + b)))
    return df.withColumn(probs, F.array(1.0 - p, p))


def ensemble(models: Sequence, df: DataFrame, task: str = "classification") -> DataFrame:
    """Average of the models' probabilities (or predictions); each model scores the same rows in turn, without joins."""
    if task == "classification" and all(hasattr(m, "shares") for m in models):
        walks = [m.shares for m in models]

        @arrow_udf("array<double>")
        def together(features: pa.Array) -> pa.Array:
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)
            p = sum(w(x) for w in walks) / len(walks)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))

        return _likeliest(df.withColumn("probs", together(vector_to_array("features"))))
    out, cols = df, []
    for i, m in enumerate(models):
        s = scored(m, out)
        extra = [c for c in s.columns if c not in out.columns]
        keep = F.col("probs") if task == "classification" else F.col("prediction")
        out = s.withColumn(f"_m{i}", keep).drop(*[c for c in extra if c != f"_m{i}"])
        cols.append(f"_m{i}")
    n = float(len(cols))
    if task == "regression":
        total = F.col(cols[0])
        for c in cols[1:]:
            total = total + F.col(c)
        return out.withColumn("prediction", total / n).drop(*cols)
    total = F.col(cols[0])
    for c in cols[1:]:
        total = F.zip_with(total, F.col(c), lambda a, b: a + b)
    return _likeliest(out.withColumn("probs", F.transform(total, lambda x: x / n)).drop(*cols))


def _likeliest(df: DataFrame) -> DataFrame:
    """``prediction``: the class of the greatest of ``probs``, ties to the smaller one."""
    best = F.array_max(F.transform("probs", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    return df.withColumn("prediction", (-best["i"]).cast("double"))


def best_ensemble(train: DataFrame, test: DataFrame, models: Sequence[str], keys: Sequence[str], task: str = "classification", top: int = 3, folds: int = 3, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """The average of the ``top`` models by mean score over folds of the training rows, and which they are.

    The members are fitted on all training rows; the test rows have no say in the choice.
    """
    marked = stored_table(_folds(train, keys, folds, seed).select("features", "label", "fold"), "folds")
    score = dict.fromkeys(models, 0.0)
    sizes = {r["fold"]: r for r in marked.groupBy("fold").agg(F.count("*").alias("n"), F.max("label").alias("top")).collect()}
    linear = [k for k in models if k in LINEAR] if task == "classification" and max(r["top"] for r in sizes.values()) <= 1 else []
    with (_fit_rows(marked, fold="fold") if linear else nullcontext()) as packed:
        # linear models of all folds share their passes
        total = sum(r["n"] for r in sizes.values())
        jobs = [(f, 1.0 / max(1, total - (sizes[f]["n"] if f in sizes else 0))) for f in range(folds)]
        fitted = {k: _linear(k, packed, jobs) for k in linear}
        areas = _exact_areas(packed, [m for k in linear for m in fitted[k]], [*range(folds)] * len(linear)) if linear else []
        for f in range(folds):
            own, held = marked.where(F.col("fold") != f).drop("fold"), marked.where(F.col("fold") == f).drop("fold")
            bins = _shared_bins(own, models, task)
            tested = _binned(held, bins[0], None) if bins else None
            for k in models:
                area = areas[linear.index(k) * folds + f] if k in linear else None
                if area is None:
                    area = _lead_score(fitted[k][f] if k in linear else fit_model(k, own, task, bins=bins), held, task, tested)
                score[k] += area / folds
        best = sorted(models, key=lambda k: (-score[k], k))[:top]
        bins = _shared_bins(train, best, task)
        return ensemble([fit_model(k, train, task, bins=bins, packed=packed) for k in best], test, task), best


def _lead_score(model, held: DataFrame, task: str, bins: DataFrame | None = None) -> float:
    """What ranks a model on held-out rows: R2, ROC-AUC, or F1 beyond two classes."""
    if task == "regression":
        return float(ev.regression_metrics(model.transform(held), "label", "prediction").first()["r2"])
    s = _outcomes(model, held, bins=bins)
    auc = ev.ranking_metrics(s, "label", "p", times="n").first()["roc_auc"]
    return float(auc if auc is not None else ev.classification_metrics(s, "label", "prediction", "n").first()["f1"])


def _outcomes(model, df: DataFrame, own: bool = False, bins: DataFrame | None = None, ranked: bool = True) -> DataFrame:
    """``label, prediction, p, n``: how often each outcome occurs, so that rows are scored once for all measures.

    A tree scores each distinct row of bins once. ``own`` says that it was fitted on ``df``, so its bins are counted
    already; ``bins`` are those of ``df`` if they are known. Without ``ranked`` there is no ``p``.
    """
    if own and not ranked and isinstance(model, perceptron.PerceptronModel):
        known = [(float(i), float(j), int(n)) for (i, j), n in np.ndenumerate(model.counts) if n]
        return df.sparkSession.createDataFrame(known, "label double, prediction double, n long")
    if isinstance(model, BinnedModel):
        rows = scored(model.model, model.rows if own else bins if bins is not None else _binned(df, model.cuts, None))
    else:
        rows = scored(model, df).withColumn("n", F.lit(1))
    by = ["label", "prediction", *([F.col("probs")[1].alias("p")] if ranked else [])]
    if ranked and not isinstance(model, (BinnedModel, NeighbourModel)):
        # hardly two rows have one score, so there is nothing to count
        return cut_lineage(rows.select(*by, F.col("n").cast("long").alias("n")))
    return cut_lineage(rows.groupBy(*by).agg(F.sum("n").alias("n")))


def leaderboard(train: DataFrame, test: DataFrame, models: Sequence[str], task: str = "classification", weighted: bool = False) -> tuple[DataFrame, dict]:
    """Fit, score and rank the chosen models: ROC-AUC (F1 beyond two classes) or R2, with the generalisation gap."""
    rows, fitted = [], {}
    bins = None if weighted else _shared_bins(train, models, task)
    tested = _binned(test, bins[0], None) if bins else None
    with (None if weighted else _shared_rows(train, models, task)) or nullcontext() as packed:
        for key in models:
            m = fit_model(key, train, task, weighted, bins=bins, packed=packed)
            fitted[key] = m
            if task == "regression":
                r = ev.regression_metrics(m.transform(test), "label", "prediction").first()
                t = ev.regression_metrics(m.transform(train), "label", "prediction").first()
                rows.append((key, None, None, float(r["mae"]), float(r["rmse"]), float(r["r2"]), float(t["r2"]) - float(r["r2"])))
                continue
            s, ct = _outcomes(m, test, bins=tested), ev.classification_metrics(_outcomes(m, train, own=True, ranked=False), "label", "prediction", "n").first()
            c = ev.classification_metrics(s, "label", "prediction", "n").first()
            auc = ev.ranking_metrics(s, "label", "p", times="n").first()["roc_auc"]
            lead = auc if auc is not None else c["f1"]
            rows.append((key, float(c["accuracy"]), float(c["f1"]), None, None, float(lead), float(ct["accuracy"]) - float(c["accuracy"])))
    table = train.sparkSession.createDataFrame(rows, "model string, accuracy double, f1 double, mae double, rmse double, score double, gap double")
    return table.orderBy(F.col("score").desc(), "model"), fitted


# ---- explanations ----


def importance(model, names: Sequence[str], spark) -> DataFrame:
    """Tree gains or absolute coefficients, normalised to sum 1."""
    if hasattr(model, "featureImportances"):
        w = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        w = np.abs(model.coefficients.toArray())
    elif hasattr(model, "coefficientMatrix"):
        w = np.abs(model.coefficientMatrix.toArray()).mean(0)
    else:
        return spark.createDataFrame([], "feature string, importance double")
    total = float(w.sum()) or 1.0
    return spark.createDataFrame([(n, float(x) / total) for n, x in zip(names, w)], "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def mean_importance(models: Sequence, names: Sequence[str], spark) -> DataFrame:
    parts = None
    for m in models:
        p = importance(m, names, spark)
        parts = p if parts is None else parts.unionByName(p)
    mean = parts.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return mean.orderBy(F.col("importance").desc(), "feature")


def linear_attribution(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Mean absolute contribution coef x (x - mean) per feature: exact Shapley values of a linear model."""
    cols = list(coefficients)
    means = df.agg(*[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    s = df.agg(*[F.avg(F.abs((finite(c) - means[f"m{i}"]) * float(coefficients[c]))).alias(f"a{i}") for i, c in enumerate(cols)])
    return s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("attribution")) for i, c in enumerate(cols)])).alias("e")).select("e.*")


def permutation_importance(model, df: DataFrame, features: Sequence[str], keys: Sequence[str], prep: Preprocessor, seed: int = 42) -> DataFrame:
    """Accuracy lost when one feature is replaced by its value in another row.

    Rows are shifted by one place in a hash order inside hash groups of bounded
    expected size, which permutes the column without a global sort.
    """
    from pyspark.sql import Window as W

    base = ev.classification_metrics(scored(model, prep.transform(df)), "label", "prediction").first()["accuracy"]
    n = df.count()
    groups = max(1, n // 10_000)
    u = uniform(*[ident(k) for k in keys], seed=seed)
    ring = df.withColumn("_u", u).withColumn("_g", F.floor(F.col("_u") * groups * 7919) % groups)
    w = W.partitionBy("_g").orderBy("_u")
    whole = W.partitionBy("_g").orderBy("_u").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = []
    for c in features:
        moved = ring.withColumn(c, F.coalesce(F.lag(ident(c)).over(w), F.last(ident(c)).over(whole)))
        acc = ev.classification_metrics(scored(model, prep.transform(moved.drop("_u", "_g"))), "label", "prediction").first()["accuracy"]
        rows.append((c, float(base) - float(acc)))
    return df.sparkSession.createDataFrame(rows, "feature string, drop double").orderBy(F.col("drop").desc(), "feature")


def surrogate_rules(df: DataFrame, names: Sequence[str], prediction: str = "prediction", depth: int = 3) -> DataFrame:
    """``line, rule`` text of a shallow tree that imitates the predictions."""
    tree = mc.DecisionTreeClassifier(maxDepth=depth, featuresCol="features", labelCol="_p", predictionCol="_sp", rawPredictionCol="_sr", probabilityCol="_sq")
    model = tree.fit(df.select("features", ident(prediction).cast("double").alias("_p")))
    lines = []
    for line in model.toDebugString.splitlines()[1:]:
        for i in reversed(range(len(names))):
            line = line.replace(f"feature {i} ", f"{names[i]} ")
        lines.append((len(lines) + 1, line.rstrip()))
    return df.sparkSession.createDataFrame(lines, "line int, rule string")


# ---- trees as SQL ----


def _leaf_values(node, task: str) -> list[float]:
    if task == "regression":
        return [float(node.prediction())]
    counts = list(node.impurityStats().stats())
    total = sum(counts) or 1.0
    return [c / total for c in counts]


def _case(node, columns: Sequence[str], k: int, task: str) -> str:
    """Nested CASE for output ``k`` of a fitted tree node."""
    if node.subtreeDepth() == 0:
        return repr(_leaf_values(node, task)[k])
    split = node.split()
    yes, no = _case(node.leftChild(), columns, k, task), _case(node.rightChild(), columns, k, task)
    column, threshold = columns[split.featureIndex()], split.threshold()
    if isinstance(column, tuple):
        column, threshold = column[0], column[1][int(threshold)]
    return f"CASE WHEN {column} <= {threshold!r} THEN {yes} ELSE {no} END"


def tree_sql(model, columns: Sequence[str]) -> str:
    """A SQL expression equal to the model's prediction; ``columns`` are SQL expressions of the features.

    One tree, a forest (all trees) or boosted regression trees.
    """
    if isinstance(model, BinnedModel):
        # a bin number is at most k where the value is at most the k-th cut
        return tree_sql(model.model, [(c, ends) for c, ends in zip(columns, model.cuts)])
    if isinstance(model, forest.ForestModel):
        trees = model.trees
    else:
        trees = list(model._java_obj.trees()) if hasattr(model, "trees") else [model._java_obj]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    classes = getattr(model, "numClasses", 0)
    boosted = type(model).__name__.startswith("GBT")
    if boosted or not classes:
        total = " + ".join(f"{float(w)!r} * ({_case(t.rootNode(), columns, 0, 'regression')})" for t, w in zip(trees, weights))
        if boosted and classes:
            return f"CASE WHEN {total} > 0 THEN 1.0 ELSE 0.0 END"
        return total if boosted else f"({total}) / {float(sum(weights))!r}"
    sums = ["(" + " + ".join(f"({_case(t.rootNode(), columns, k, 'classification')})" for t in trees) + ")" for k in range(classes)]
    out = f"{float(classes - 1)!r}"
    for k in reversed(range(classes - 1)):
        others = " AND ".join(f"{sums[k]} >= {sums[j]}" for j in range(k + 1, classes))
        out = f"CASE WHEN {others} THEN {float(k)!r} ELSE {out} END"
    return out


# ---- anomalies and what-if ----


def _pairwise_correlation(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, standard deviations and correlations, each from the rows that have the columns it is about."""
    x = [finite(c) for c in cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    s = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(x)],
               *[F.corr(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs if i < j]).first()
    mean = np.array([s[f"m{i}"] or 0.0 for i in range(len(cols))])
    std = np.array([s[f"s{i}"] or 0.0 for i in range(len(cols))])
    corr = np.eye(len(cols))
    for i, j in pairs:
        if i < j:
            c = s[f"c{i}_{j}"]
            corr[i, j] = corr[j, i] = c if c is not None and np.isfinite(c) else 0.0
    return mean, np.where(std > 0, std, 1.0), corr


def reconstruction_anomalies(df: DataFrame, columns: Sequence[str], k: int = 2, quantile: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """PCA reconstruction: rows with ``error`` and ``anomaly`` (above the quantile), and mean error per feature.

    Components come from pairwise-complete correlations. A row with missing features is placed by least squares on the
    features it has, and its error is their mean; a row without any has no error and is no anomaly.
    """
    cols = list(columns)
    mean, std, corr = _pairwise_correlation(df, cols)
    pc = np.linalg.eigh(corr)[1][:, ::-1][:, :min(k, len(cols))]

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = (np.array(pdf["_x"].tolist(), dtype=float).reshape(len(pdf), len(cols)) - mean) / std
            seen = np.isfinite(z)
            z = np.where(seen, z, 0.0)
            # the normal equations of each row over its own features, a little ridge for rows with few
            normal = np.einsum("ri,ij,ik->rjk", seen, pc, pc) + 1e-9 * np.eye(pc.shape[1])
            place = np.linalg.solve(normal, (z @ pc)[:, :, None])[:, :, 0]
            gap = np.where(seen, (z - place @ pc.T) ** 2, np.nan)
            yield pdf.drop(columns="_x").assign(_e=[[None if np.isnan(v) else v for v in row] for row in gap.tolist()])

    rows = df.withColumn("_x", F.array(*[F.coalesce(finite(c), F.lit(float("nan"))) for c in cols]))
    schema = T.StructType([*df.schema.fields, T.StructField("_e", T.ArrayType(T.DoubleType()))])
    x = rows.mapInPandas(errors, schema)
    known = F.filter("_e", lambda v: v.isNotNull())
    x = cut_lineage(x.withColumn("error", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, b: a + b), F.size(known).cast("double"))))
    cut = quantile_map(x, ["error"], [quantile])["error"][0]
    out = x.withColumn("anomaly", F.coalesce(F.col("error") > cut, F.lit(False)))
    per = x.agg(*[F.avg(F.col("_e")[i]).alias(f"e{i}") for i in range(len(cols))]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"e{i}").alias("error")) for i, c in enumerate(cols)])).alias("e")
    ).select("e.*").orderBy(F.col("error").desc(), "feature")
    return out.drop("_e"), per


def what_if(model, df: DataFrame, prep: Preprocessor, overrides: dict[str, object]) -> DataFrame:
    """Scores before and after the overrides, side by side."""
    before = scored(model, prep.transform(df)).withColumnsRenamed({"prediction": "prediction_before", "probs": "probs_before"})
    before = before.drop("features", "rawPrediction", "probability")
    changed = before.withColumns({f"_o_{c}": ident(c) for c in overrides}).withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in overrides.items()})
    after = scored(model, prep.transform(changed)).drop("features", "rawPrediction", "probability")
    return after.withColumns({c: ident(f"_o_{c}") for c in overrides}).drop(*[f"_o_{c}" for c in overrides])


# ---- uplift ----


def uplift(df: DataFrame, features: Sequence[str], outcome: str, treatment: str, key: str = "logreg") -> DataFrame:
    """T-learner: one model per arm, both scored on every row, with effect and quadrant."""
    prep = Preprocessor.fit(df, features)
    rows = prep.transform(df).withColumn("label", finite(outcome)).where("label is not null")
    arms = {}
    for arm in (1, 0):
        part = rows.where(ident(treatment) == arm)
        s = part.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
        if s["n"] < 5 or s["k"] < 2:
            raise ValueError("each arm needs five rows and two outcome classes")
        arms[arm] = fit_model(key, part)
    one = scored(arms[1], rows).withColumn("p_treated", F.col("probs")[1]).drop("rawPrediction", "probability", "prediction", "probs")
    both = scored(arms[0], one).withColumn("p_control", F.col("probs")[1]).drop("rawPrediction", "probability", "prediction", "probs", "features")
    t, c = F.col("p_treated") >= 0.5, F.col("p_control") >= 0.5
    quadrant = F.when(t & ~c, "Persuadables").when(t & c, "Sure Things").when(~t & ~c, "Lost Causes").otherwise("Sleeping Dogs")
    return both.withColumn("effect", F.col("p_treated") - F.col("p_control")).withColumn("quadrant", quadrant)


def uplift_summary(scored_rows: DataFrame) -> DataFrame:
    s = scored_rows.groupBy("quadrant").agg(F.count("*").alias("rows"), F.avg("effect").alias("mean_effect"))
    overall = scored_rows.agg(F.avg("effect")).scalar()
    return s.withColumn("ate", overall)


def ridge_coefficients(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    fit = least_squares(moments(df, [*features, target]), list(features), target, alpha)
    return dict(zip(fit.features, (float(c) for c in fit.coef)))


