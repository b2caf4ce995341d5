"""Training a dense network by mini-batches, in parallel over the partitions.

An epoch is one pass. Every partition starts from the same weights and moments, goes
through its rows in mini-batches with Adam, and the partitions' weights are averaged by
their rows. One partition, which a small table is, is plain training by mini-batches.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetair.functions.scoring import Layer
from fleetair.plans.scratch import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that one partition holds, about.
SHARD_ROWS = 1 << 20
#: Adam: how much of the moments stays at a step, and what keeps a step finite.
KEEP, KEEP_SQUARE, TINY = 0.9, 0.999, 1e-7


def _shapes(sizes: Sequence[int]) -> list[tuple[int, ...]]:
    """Weights and offsets of each layer, in the order they have in the flat vector."""
    return [s for n, m in zip(sizes, sizes[1:]) for s in ((n, m), (m,))]


def _parts(flat: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _shapes(sizes):
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def first_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Uniform weights whose spread keeps the size of what passes through; no offsets."""
    rng, parts = np.random.default_rng(seed), []
    for n, m in zip(sizes, sizes[1:]):
        parts += [rng.uniform(-1, 1, n * m) * np.sqrt(6 / (n + m)), np.zeros(m)]
    return np.concatenate(parts)


def gradient(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, float]:
    """Of the mean log loss, and the summed loss. ``mask`` scales the first hidden units."""
    parts, depth = _parts(flat, sizes), len(sizes) - 1
    values = [x]
    for k in range(depth):
        z = values[-1] @ parts[2 * k] + parts[2 * k + 1]
        if k < depth - 1:
            z = np.maximum(z, 0.0)
            z = z * mask if k == 0 and mask is not None else z
        values.append(z)
    z = values[-1] - values[-1].max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[rows, y], 1e-300)).sum())
    p[rows, y] -= 1.0
    back, out = p / len(y), [None] * len(parts)
    for k in reversed(range(depth)):
        out[2 * k], out[2 * k + 1] = values[k].T @ back, back.sum(axis=0)
        if k:
            back = (back @ parts[2 * k].T) * (values[k] > 0)
            back = back * mask if k == 1 and mask is not None else back
    return np.concatenate([o.ravel() for o in out]), loss


def train_mlp(
    rows: DataFrame, sizes: Sequence[int], epochs: int = 50, batch: int = 32, rate: float = 1e-3, dropout: float = 0.3,
    seed: int = 42,
) -> tuple[list[Layer], list[float]]:
    """Layers, and the mean loss of each epoch, from rows of ``x array<double>, y int``.

    Hidden units are rectified, the output is a softmax. ``dropout`` is the part of the
    first hidden layer that is left out of a mini-batch.
    """
    n = rows.count()
    if not n:
        raise ValueError("no complete labelled rows to learn from")
    shards = -(-n // SHARD_ROWS)
    held = cut_lineage(rows.repartition(shards))
    weights = first_weights(sizes, seed)
    state, steps, losses = np.stack([weights, np.zeros_like(weights), np.zeros_like(weights)]), 0, []
    for epoch in range(epochs):
        found = held.mapInArrow(_epoch(state, steps, sizes, batch, rate, dropout, (seed, epoch)), "at int, w double, m double, v double, n long")
        if shards > 1:
            found = found.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("w", "m", "v")], F.sum("n").alias("n"), F.max("n").alias("most"))
        else:
            found = found.withColumn("most", F.col("n"))
        found = found.toArrow()
        at = found["at"].to_numpy()
        order = np.argsort(at)
        sums = {c: found[c].to_numpy()[order] for c in found.schema.names}
        # The first row has the loss; rows count where partitions were.
        losses.append(float(sums["w"][0] / sums["n"][0]))
        state = np.stack([sums[c][1:] / sums["n"][1:] for c in ("w", "m", "v")])
        steps += -(-int(sums["most"][0]) // batch)
    return _layers(state[0], sizes), losses


def _epoch(state: np.ndarray, steps: int, sizes: Sequence[int], batch: int, rate: float, dropout: float, seeds: tuple):
    """A partition's way through its rows: weights and moments times its rows, and its loss at -1."""
    def run(batches):
        w, m, v = state.copy()
        t, n, loss = steps, 0, 0.0
        rng = np.random.default_rng([*seeds, TaskContext.get().partitionId()])
        for arrow in batches:
            x = arrow.column("x").flatten().to_numpy(zero_copy_only=False).reshape(arrow.num_rows, sizes[0])
            y, order = arrow.column("y").to_numpy(), rng.permutation(arrow.num_rows)
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                mask = (rng.random((len(some), sizes[1])) >= dropout) / (1 - dropout) if dropout and len(sizes) > 2 else None
                g, lost = gradient(w, sizes, x[some], y[some], mask)
                t, loss = t + 1, loss + lost
                m = KEEP * m + (1 - KEEP) * g
                v = KEEP_SQUARE * v + (1 - KEEP_SQUARE) * g * g
                w = w - rate * (m / (1 - KEEP**t)) / (np.sqrt(v / (1 - KEEP_SQUARE**t)) + TINY)
            n += arrow.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(-1, len(w), dtype=np.int32)), *(pa.array(np.append(first, part * n)) for first, part in ((loss, w), (0.0, m), (0.0, v))),
                pa.array(np.full(len(w) + 1, n)),
            ], ["at", "w", "m", "v", "n"])

    return run


def _layers(flat: np.ndarray, sizes: Sequence[int]) -> list[Layer]:
    parts, depth = _parts(flat, sizes), len(sizes) - 1
    return [
        {"w": parts[2 * k].T.tolist(), "b": parts[2 * k + 1].tolist(), "act": "relu" if k < depth - 1 else "softmax"}
        for k in range(depth)]


def save_layers(spark: SparkSession, layers: Sequence[Layer], path: str) -> None:
    """A row per unit: (layer, unit, weights, bias, act)."""
    rows = [
        (k, u, list(map(float, w)), float(b), layer["act"])
        for k, layer in enumerate(layers) for u, (w, b) in enumerate(zip(layer["w"], layer["b"], strict=True))]
    table = spark.createDataFrame(rows, "layer int, unit int, weights array<double>, bias double, act string")
    table.coalesce(1).write.mode("overwrite").parquet(path)
