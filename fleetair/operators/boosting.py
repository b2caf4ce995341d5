"""Boosted trees with a softmax loss over several classes, grown level by level.

Features are cut into bins at quantiles. A level of the trees of a round, one tree per class,
is one pass: every partition routes its rows, adds up first and second derivatives
per class, node, feature and bin, and a grouped sum puts the partitions together.
What reaches the driver is those sums, whose number depends on the trees' shape and
not on the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetair.plans.scratch import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 64
#: Weight of a leaf's square in the loss, and the least second derivative in a leaf.
L2, MIN_WEIGHT = 1.0, 1.0
#: Rounds after which the rows' margins are written; until then they are made again from the trees.
KEEP_ROUNDS = 10
#: Rows that one partition holds, about.
SHARD_ROWS = 1 << 20


@dataclass(frozen=True)
class Trees:
    """One row per tree: class by class, round after round.

    A tree is a heap: the children of node i are 2 i + 1 and 2 i + 2. ``feature`` is -1 in a
    leaf; a row goes right where its feature is at or above ``threshold``.
    """

    features: tuple[str, ...]
    classes: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The sum of the leaves of each class, by rows of ``x``."""
        return _margins(x, self.feature, self.threshold, self.value, self.classes)


def _route(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree that each row reaches within so many levels."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        f = feature[at]
        at = np.where(f >= 0, 2 * at + 1 + (x[rows, f] >= threshold[at]), at)
    return at


def _closed(feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> tuple:
    """The same trees with every leaf on the last level: what is below a leaf has its value."""
    feature, threshold, value = feature.copy(), threshold.copy(), value.copy()
    for node in range(feature.shape[1] // 2):
        leaf = feature[:, node] < 0
        for child in (2 * node + 1, 2 * node + 2):
            feature[leaf, child], value[leaf, child] = -1, value[leaf, node]
        feature[leaf, node] = 0
    return feature, threshold, value


def _margins(x, feature, threshold, value, classes: int) -> np.ndarray:
    out, levels = np.zeros((len(x), classes)), int(np.log2(feature.shape[1] + 1)) - 1
    feature, threshold, value = _closed(feature, threshold.astype(x.dtype), value)
    # One feature's values after another's.
    columns, rows, start = np.ascontiguousarray(x.T).ravel(), np.arange(len(x)), feature * len(x)
    for t in range(len(feature)):
        at = np.zeros(len(x), np.int64)
        for _ in range(levels):
            at = 2 * at + 1 + (columns.take(rows + start[t].take(at)) >= threshold[t].take(at))
        out[:, t % classes] += value[t].take(at)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _cuts(df: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each feature, from one pass of mergeable summaries."""
    shares = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000) for i in range(features)]).first()
    return [np.unique(np.array(c or [], dtype=float)) for c in found]


def _binned(df: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The number of cuts at or below each feature, instead of the feature."""
    @F.arrow_udf("array<short>")
    def bins(x: pa.Array) -> pa.Array:
        rows = _matrix(x, len(cuts))
        out = np.stack([np.searchsorted(c, rows[:, i], "right") for i, c in enumerate(cuts)], axis=1)
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(cuts))
        return pa.ListArray.from_arrays(offsets, pa.array(out.astype(np.int16).ravel()))

    return df.select(bins("x").alias("x"), "y")


def _sums(rows: DataFrame, shards: int, width: int, recent: tuple, partial: tuple, level: int, bins: int, classes: int) -> np.ndarray:
    """First and second derivatives by class, node of the level, feature and bin."""
    nodes, first = 1 << level, (1 << level) - 1
    shape = (classes, nodes, width, bins)

    def add(batches):
        total = np.zeros((2, classes, width, nodes * bins))
        for batch in batches:
            x, y = _matrix(batch.column("x"), width), batch.column("y").to_numpy()
            margin = _matrix(batch.column("margin"), classes) + _margins(x, *recent, classes)
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            columns = np.ascontiguousarray(x.T)
            for c in range(classes):
                at = _route(x, partial[0][c], partial[1][c], level) - first
                here = np.flatnonzero((at >= 0) & (partial[0][c][np.maximum(at, 0) + first] == OPEN))
                g, h = p[here, c] - (y[here] == c), np.maximum(2 * p[here, c] * (1 - p[here, c]), 1e-16)
                node = at[here] * bins
                for f in range(width):
                    key = node + columns[f].take(here)
                    for k, weight in enumerate((g, h)):
                        total[k, c, f] += np.bincount(key, weight, nodes * bins)
        total = total.reshape(2, classes, width, nodes, bins).swapaxes(2, 3)
        flat = total.reshape(2, -1)
        at = np.flatnonzero(flat[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[0, at]), pa.array(flat[1, at])], ["at", "g", "h"])

    found = rows.mapInArrow(add, "at long, g double, h double")
    if shards > 1:  # the sums of one partition are all there is
        found = found.groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found = found.toArrow()
    out = np.zeros((2, int(np.prod(shape))))
    out[:, found["at"].to_numpy()] = found["g"].to_numpy(), found["h"].to_numpy()
    return out.reshape(2, *shape)


#: A node whose rows are still to be looked at.
OPEN = -2


def _grow(rows: DataFrame, shards: int, width: int, recent: tuple, cuts: list[np.ndarray], classes: int, depth: int, bins: int, rate: float):
    """One tree per class: feature, bin, value and gain of every node."""
    size = (1 << (depth + 1)) - 1
    feature = np.full((classes, size), -1)
    cut, value, gain = np.zeros((classes, size), np.int64), np.zeros((classes, size)), np.zeros((classes, size))
    feature[:, 0] = OPEN
    possible = np.array([[b < len(c) for b in range(bins - 1)] for c in cuts])
    for level in range(depth):
        if not (feature == OPEN).any():
            break
        # Open nodes end the way of their rows: no row is sent below them yet.
        g, h = _sums(rows, shards, width, recent, (feature, cut), level, bins, classes)
        left, whole = np.cumsum([g, h], axis=-1)[..., :-1], np.array([g, h]).sum(axis=-1, keepdims=True)
        right = whole - left
        score = lambda s: s[0] ** 2 / (s[1] + L2)
        better = np.where(
            possible & (left[1] >= MIN_WEIGHT) & (right[1] >= MIN_WEIGHT), score(left) + score(right) - score(whole), -np.inf)
        for c, node in zip(*np.nonzero(feature[:, (1 << level) - 1 : (2 << level) - 1] == OPEN)):
            at = (1 << level) - 1 + node
            f, b = np.unravel_index(int(better[c, node].argmax()), better.shape[2:])
            value[c, at] = -rate * whole[0, c, node, 0, 0] / (whole[1, c, node, 0, 0] + L2)
            feature[c, at] = -1
            if better[c, node, f, b] <= 1e-6:
                continue
            feature[c, at], cut[c, at], gain[c, at] = f, b + 1, better[c, node, f, b]
            for side, part in ((1, left), (2, right)):
                child = 2 * at + side
                value[c, child] = -rate * part[0, c, node, f, b] / (part[1, c, node, f, b] + L2)
                feature[c, child] = OPEN if level + 1 < depth else -1
    return feature, cut, value, gain


def train_trees(
    rows: DataFrame, features: Sequence[str], classes: int, rounds: int = 100, depth: int = 6, rate: float = 0.1,
    bins: int = BINS,
) -> Trees:
    """Trees from rows of ``x array<double>, y int``, complete and with classes from 0."""
    width = len(features)
    n = rows.count()
    if not n:
        raise ValueError("no complete labelled rows to learn from")
    cuts = _cuts(rows, width, bins)
    zeros = F.lit([0.0] * classes)
    shards = -(-n // SHARD_ROWS)
    held = cut_lineage(_binned(rows, cuts).withColumn("margin", zeros).repartition(shards))
    grown, recent = [], []
    none = tuple(np.zeros((0, (2 << depth) - 1)) for _ in range(3))

    def together(trees: list) -> tuple:
        """feature, cut and value of several rounds, a row per tree."""
        return tuple(np.concatenate(t) for t in zip(*[t[:3] for t in trees])) if trees else none

    for _ in range(rounds):
        if len(recent) == KEEP_ROUNDS:
            held, recent = cut_lineage(_moved(held, together(recent), width, classes)), []
        tree = _grow(held, shards, width, together(recent), cuts, classes, depth, bins, rate)
        grown.append(tree)
        recent.append(tree)
    feature, cut, value, gain = (np.concatenate(t) for t in zip(*grown))
    padded = [np.append(c, np.inf) for c in cuts]
    threshold = np.array([
        [padded[f][b - 1] if f >= 0 else 0.0 for f, b in zip(*tree)] for tree in zip(feature.tolist(), cut.tolist())])
    return Trees(tuple(features), classes, feature, threshold, value, gain)


def _moved(rows: DataFrame, trees: tuple, width: int, classes: int) -> DataFrame:
    """The margins after some more trees."""
    def move(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            margin = _matrix(batch.column("margin"), classes) + _margins(x, *trees, classes)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * classes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("y"), pa.ListArray.from_arrays(offsets, pa.array(margin.ravel()))], ["x", "y", "margin"])

    return rows.mapInArrow(move, rows.schema)


def tree_margins(x: Column, model: Trees) -> Column:
    """A sum per class; the class with the greatest is the prediction."""
    trees, classes, width = (model.feature, model.threshold, model.value), model.classes, len(model.features)

    @F.arrow_udf("array<double>")
    def margins(batch: pa.Array) -> pa.Array:
        found = _margins(_matrix(batch, width), *trees, classes)
        offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * classes)
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    return margins(x)


def importances(model: Trees) -> dict[str, float]:
    """The mean gain of a feature's splits, as a share of all features'."""
    split = model.feature >= 0
    n = np.bincount(model.feature[split], minlength=len(model.features))
    mean = np.bincount(model.feature[split], model.gain[split], len(model.features)) / np.maximum(n, 1)
    return dict(zip(model.features, (mean / max(mean.sum(), 1e-300)).tolist()))


def save_trees(spark: SparkSession, model: Trees, path: str) -> None:
    """A row per tree: its class, and its nodes as arrays."""
    rows = [
        (t // model.classes, t % model.classes, list(model.features), *(a[t].tolist() for a in (model.feature, model.threshold, model.value, model.gain)))
        for t in range(len(model.feature))]
    schema = "round int, class int, features array<string>, feature array<int>, threshold array<double>, value array<double>, gain array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str) -> Trees:
    rows = spark.read.parquet(path).orderBy("round", "class").collect()
    arrays = (np.array([r[c] for r in rows]) for c in ("feature", "threshold", "value", "gain"))
    return Trees(tuple(rows[0]["features"]), max(r["class"] for r in rows) + 1, *arrays)
