"""A random forest of classes over counted rows of bin numbers, grown level by level for all trees together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Rows that walk through all trees together.
CHUNK = 16_384
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) decided by 64-bit keys and the seed (the finaliser of SplitMix64)."""
    z = keys + np.uint64(seed * int(_MIX[0]) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(12)).astype(float) * 2.0**-52 + 2.0**-53


class Draws:
    """Poisson draws of means ``n`` (whole numbers above 0), all distribution functions end to end in one sorted table."""

    def __init__(self, n: np.ndarray):
        means, self.which = np.unique(n, return_inverse=True)
        tables, self.shift, at = [], np.zeros(len(means), np.int64), 0
        for i, mean in enumerate(means):
            reach = int(9 * math.sqrt(mean)) + 20
            low = max(0, int(mean) - reach)
            # logarithms of the terms from one to the next, so that no factorial overflows
            log = np.concatenate([[0.0], np.cumsum(math.log(mean) - np.log(np.arange(low + 1, int(mean) + reach + 1)))])
            upto = np.cumsum(np.exp(log - log.max()))
            tables.append(i + upto / upto[-1])
            self.shift[i] = low - at
            at += len(upto)
        self.table = np.concatenate(tables) if tables else np.zeros(0)

    def __call__(self, u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The draws of some rows at the uniform numbers ``u``."""
        which = self.which[rows]
        return (np.searchsorted(self.table, which + u) + self.shift[which]).astype(float)


class Trees:
    """Nodes of all trees as arrays ``[tree, node]``, children of node ``i`` at ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, trees: int, depth: int, classes: int):
        nodes = 2 ** (depth + 1) - 1
        self.feature, self.bin = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int32)
        self.gain, self.counts = np.zeros((trees, nodes)), np.zeros((trees, nodes, classes))

    def leaves(self, bins: np.ndarray, levels: int) -> Iterator[np.ndarray]:
        """The node that each row of bin numbers reaches in each tree after at most ``levels`` steps."""
        at = np.arange(len(bins))
        for feature, cut in zip(self.feature, self.bin):
            node = np.zeros(len(bins), np.int32)
            for _ in range(levels):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (bins[at, f] > cut[node]), node)
            yield node

    def prune(self) -> None:
        """Leaves of one parent that vote for the same class become one, as MLlib's do."""
        for t in range(len(self.feature)):
            for i in range(self.feature.shape[1] // 2 - 1, -1, -1):
                ends = 2 * i + 1, 2 * i + 2
                if self.feature[t, i] >= 0 and all(self.feature[t, e] < 0 for e in ends) and self.counts[t, ends[0]].argmax() == self.counts[t, ends[1]].argmax():
                    self.feature[t, i] = -1


class Node:
    """A node behind the interface of a node of MLlib's trees."""

    def __init__(self, trees: Trees, tree: int, at: int = 0):
        self.trees, self.tree, self.at = trees, tree, at

    def subtreeDepth(self) -> int:
        return 0 if self.trees.feature[self.tree, self.at] < 0 else 1 + max(self.leftChild().subtreeDepth(), self.rightChild().subtreeDepth())

    def leftChild(self) -> "Node":
        return Node(self.trees, self.tree, 2 * self.at + 1)

    def rightChild(self) -> "Node":
        return Node(self.trees, self.tree, 2 * self.at + 2)

    def split(self) -> "Node":
        return self

    def featureIndex(self) -> int:
        return int(self.trees.feature[self.tree, self.at])

    def threshold(self) -> float:
        return float(self.trees.bin[self.tree, self.at])

    def impurityStats(self) -> "Node":
        return self

    def stats(self) -> list[float]:
        return self.trees.counts[self.tree, self.at].tolist()

    def rootNode(self) -> "Node":
        return self


class ForestModel:
    """A fitted forest over bin numbers behind the interface of a fitted MLlib model."""

    def __init__(self, trees: Trees, depth: int, width: int, classes: int):
        self.nodes, self.depth, self.width, self.numClasses = trees, depth, width, classes

    @property
    def trees(self) -> list[Node]:
        return [Node(self.nodes, t) for t in range(len(self.nodes.feature))]

    @property
    def featureImportances(self) -> DenseVector:
        """The mean over trees of the share of each feature in the gains, by rows."""
        total = np.zeros(self.width)
        for feature, gain, counts in zip(self.nodes.feature, self.nodes.gain, self.nodes.counts):
            inner = feature >= 0
            # a node below a leaf that was pruned is in no tree any more
            for i in range(1, len(feature)):
                inner[i] &= inner[(i - 1) // 2]
            own = np.bincount(feature[inner], (gain * counts.sum(1))[inner], self.width)
            total += own / own.sum() if own.sum() > 0 else 0.0
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    @property
    def shares(self):
        """The mean class shares of the trees, as a function of rows of bin numbers."""
        nodes, depth, classes = self.nodes, self.depth, self.numClasses
        share = nodes.counts / np.maximum(nodes.counts.sum(2, keepdims=True), 1e-300)

        def walk(bins: np.ndarray) -> np.ndarray:
            total = np.zeros((len(bins), classes))
            for i in range(0, len(bins), CHUNK):
                for t, node in enumerate(nodes.leaves(bins[i:i + CHUNK], depth)):
                    total[i:i + CHUNK] += share[t, node]
            return total / np.maximum(total.sum(1, keepdims=True), 1e-300)

        return walk

    def transform(self, df: DataFrame) -> DataFrame:
        classes, shares = self.numClasses, self.shares

        @arrow_udf("array<double>")
        def vote(features: pa.Array) -> pa.Array:
            total = shares(features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1).astype(np.int32))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, classes), pa.int32()), pa.array(total.ravel()))

        best = F.array_max(F.transform("_p", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
        rows = df.withColumn("_p", vote(vector_to_array("features")))
        return rows.withColumns({"probability": array_to_vector("_p"), "prediction": (-best["i"]).cast("double")}).drop("_p")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``b, label, n, weight, key`` as the bytes of up to ``CHUNK`` rows each."""
    kinds = np.int32, np.int32, float, float, np.int64
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            columns = part.column(0).flatten(), *part.columns[1:]
            yield pa.record_batch([pa.array([c.to_numpy(zero_copy_only=False).astype(k).tobytes()], pa.binary()) for c, k in zip(columns, kinds)], names=["b", "label", "n", "weight", "key"])


def _block(row) -> tuple[np.ndarray, ...]:
    label, n, weight, key = (np.frombuffer(row[c], k) for c, k in (("label", np.int32), ("n", float), ("weight", float), ("key", np.uint64)))
    return np.frombuffer(row["b"], np.int32).reshape(len(n), -1), label, n, weight, key


def _gini(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and size of class counts along the last axis."""
    n = counts.sum(-1)
    return 1.0 - ((counts / np.maximum(n, 1e-300)[..., None]) ** 2).sum(-1), n


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of class counts ``[node, feature, bin, class]``: each node's feature place, last bin on the left, gain, and the counts of both sides."""
    left = np.cumsum(hist, axis=2)
    whole = left[:, :, -1:, :]
    (impure, n), (a, na), (b, nb) = _gini(whole), _gini(left), _gini(whole - left)
    gain = np.where((na > 0) & (nb > 0), impure - (na * a + nb * b) / np.maximum(n, 1e-300), -np.inf)
    top = gain.reshape(len(hist), -1).argmax(1)
    place, cut = np.divmod(top, hist.shape[2])
    at = np.arange(len(hist))
    return place, cut, gain[at, place, cut], left[at, place, cut], (whole - left)[at, place, cut]


def fit(rows: DataFrame, width: int, classes: int, bins: int, trees: int = 100, depth: int = 5, seed: int = 42) -> ForestModel:
    """A forest of ``trees`` trees on ``features`` (bin numbers below ``bins``), ``label``, ``n`` rows behind each and their ``weight``.

    A tree draws each of the n rows by a Poisson number of mean 1, so their sum is one draw of mean n, decided by the
    row's hash; a node looks at the square root of the features, as MLlib's does. A level takes one pass over matrices
    of rows that stay with the executors: a task counts the bins of each tree's open nodes, counts meet by tree, and
    only the chosen splits reach the driver.
    """
    few = max(1, math.ceil(math.sqrt(width)))
    v = vector_to_array("features")
    keyed = rows.select(v.alias("b"), F.col("label").cast("int").alias("label"), "n", (F.col("weight") / F.col("n")).alias("weight"), F.xxhash64(v, "label").alias("key"))
    kinds = "b binary, label binary, n binary, weight binary, key binary"
    blocks = keyed.mapInArrow(_packed, kinds).rdd.map(_block).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = max(1, min(trees, rows.sparkSession.sparkContext.defaultParallelism))
    rng, grown = np.random.default_rng(seed), Trees(trees, depth, classes)
    open_ = np.zeros(grown.feature.shape, bool)
    open_[:, 0] = True
    try:
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            looked = np.argsort(rng.random((trees, nodes, width)), axis=2)[:, :, :few].astype(np.int32)
            here = open_[:, first:first + nodes]
            if not here.any():
                break

            def counted(part, grown=grown, level=level, first=first, nodes=nodes, looked=looked, here=here):
                total = np.zeros((trees, nodes * few * bins * classes))
                for b, label, n, weight, key in part:
                    draws = Draws(n)
                    for t, node in enumerate(grown.leaves(b, level)):
                        place = node - first
                        mine = np.flatnonzero(place >= 0)
                        mine = mine[here[t, place[mine]]]
                        if not len(mine):
                            continue
                        w = draws(_uniform(key[mine], seed + t * 7919), mine) * weight[mine]
                        place = place[mine]
                        for j in range(few):
                            bin_ = b[mine, looked[t, place, j]]
                            total[t] += np.bincount(((place * few + j) * bins + bin_) * classes + label[mine], w, total.shape[1])
                for t in range(trees):
                    if here[t].any():
                        yield t, total[t]

            def chosen(total: np.ndarray):
                return best_splits(total.reshape(nodes, few, bins, classes))

            for t, (place, cut, gain, left, right) in blocks.mapPartitions(counted).reduceByKey(np.add, tasks).mapValues(chosen).collect():
                for i in np.flatnonzero(here[t]):
                    at = first + i
                    if level == 0:
                        grown.counts[t, at] = left[i] + right[i]
                    if not gain[i] > 0.0:
                        continue
                    grown.feature[t, at], grown.bin[t, at], grown.gain[t, at] = looked[t, i, place[i]], cut[i], gain[i]
                    for child, counts in ((2 * at + 1, left[i]), (2 * at + 2, right[i])):
                        grown.counts[t, child] = counts
                        open_[t, child] = np.count_nonzero(counts) > 1
    finally:
        blocks.unpersist()
    grown.prune()
    return ForestModel(grown, depth, width, classes)
