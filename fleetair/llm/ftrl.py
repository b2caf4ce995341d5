"""Follow-the-regularised-leader for sparse linear classifiers, on Spark.

The training rows are dealt into shards by a hash. Each shard runs per-coordinate
FTRL-proximal over its rows, and the shards' weights are averaged (one-shot
parameter mixing). A lost task is simply run again: its rows and their order
depend on the input alone.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: A small sample is gone over until a shard has made this many updates, at most
#: ``MAX_EPOCHS`` times.
MIN_UPDATES = 4_000
MAX_EPOCHS = 40


@dataclass(frozen=True)
class Penalty:
    """Step sizes and the elastic net: ``l1`` zeroes weights, ``l2`` shrinks them."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 1e-3


def train_shard(rows, dim: int, outputs: int, epochs: int, penalty: Penalty) -> np.ndarray:
    """FTRL over (indices, values, class) rows; returns ``dim + 1`` rows of weights.

    With one output the loss is logistic (class 0 or 1), else softmax. The last
    row of the weights is the intercept, which is not penalised.
    """
    z = np.zeros((dim + 1, outputs))
    n = np.zeros((dim + 1, outputs))

    def weights(at):
        zi, ni = z[at], n[at]
        l1 = np.where(at == dim, 0.0, penalty.l1)[:, None]
        w = -(zi - np.sign(zi) * l1) / ((penalty.beta + np.sqrt(ni)) / penalty.alpha + penalty.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for idx, val, cls in rows:
            at = np.append(idx, dim)
            x = np.append(val, 1.0)
            w = weights(at)
            margin = x @ w
            if outputs == 1:
                err = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))) - cls
            else:
                err = np.exp(margin - margin.max())
                err /= err.sum()
                err[cls] -= 1.0
            g = np.outer(x, err)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / penalty.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(dim + 1))


def train(
    rows: DataFrame, dim: int, outputs: int, shards: int = 4, epochs: int = 3,
    penalty: Penalty = Penalty(),
) -> np.ndarray:
    """Weights from rows of ``key long, idx array<int>, val array<float>, cls int``.

    ``rows`` must be bounded by the caller: a shard holds its share of them. The
    driver receives the nonzero weights only, at most shards x dim x outputs.
    """
    def fit(batch: pa.Table) -> pa.Table:
        order = np.argsort(batch["key"].to_numpy(), kind="stable")
        order = np.random.default_rng(0).permutation(order)
        idx, val, cls = (batch[c].combine_chunks() for c in ("idx", "val", "cls"))
        data = [
            (np.asarray(idx[i].values), np.asarray(val[i].values, dtype=float), cls[i].as_py())
            for i in order.tolist()
        ]
        rounds = max(epochs, min(MAX_EPOCHS, -(-MIN_UPDATES // max(1, len(data)))))
        w = train_shard(data, dim, outputs, rounds, penalty)
        at, out = np.nonzero(w)
        return pa.table({
            "at": pa.array(at, pa.int32()), "out": pa.array(out, pa.int32()),
            "w": pa.array(w[at, out], pa.float64()),
        })

    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards)))
    found = (
        dealt.groupBy("_shard").applyInArrow(fit, "at int, out int, w double")
        .groupBy("at", "out").agg(F.sum("w").alias("w"))
    ).toArrow()
    used = dealt.select("_shard").distinct().count() if found.num_rows else 1
    total = np.zeros((dim + 1, outputs))
    total[found["at"].to_numpy(), found["out"].to_numpy()] = found["w"].to_numpy() / used
    return total
