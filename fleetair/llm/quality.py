"""Quality classifier: hashed word n-gram logistic regression.

A text's features are its word 1- and 2-grams, hashed into buckets, with weight
count / sqrt(number of n-grams). Words are runs of letters and digits or runs of
punctuation, in lower case (A-Z). Training is follow-the-regularised-leader over a
bounded sample; a score is the sparse dot product of one text with the weights.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.llm import ftrl
from fleetair.llm.common import bounded_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BITS = 18
SAMPLE_PER_LABEL = 10_000
#: Bytes hashed at a time; a longer text is cut between words.
PIECE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
#: The 2-gram of a word followed by itself, whatever the word: it backs off to this one.
_REPEATED = np.uint64(0x7265706561746564)
#: Likewise a word that comes again after one other ("so. so. so.").
_ALTERNATING = np.uint64(0x616C7465726E6174)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 2, dtype=np.int8)  # punctuation and signs
    kind[[9, 10, 11, 12, 13, 32]] = 0
    for lo, hi in (("0", "9"), ("a", "z"), ("A", "Z")):
        kind[ord(lo) : ord(hi) + 1] = 1
    kind[128:] = 1
    return kind


_KIND = _byte_classes()
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _PRIME, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    size = max(1 << 14, 1 << (n - 1).bit_length())
    if size not in _TABLES:
        inverse = np.full(size, _INVERSE, dtype=np.uint64)
        inverse[0] = 1
        _TABLES[size] = (_powers(size), np.cumprod(inverse))
    return _TABLES[size]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of the bytes, from prefix sums."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    kind = _KIND[data]
    start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    end = np.append(start[1:], len(data))
    word = kind[start] != 0
    start, end = start[word], end[word]
    power, inverse = _tables(len(data))
    prefix = np.append(np.uint64(0), np.cumsum((_LOWER[data] + np.uint64(1)) * power[: len(data)]))
    return (prefix[end] - prefix[start]) * inverse[start] * _MIX


def buckets(text: str) -> np.ndarray:
    """The bucket of every word 1- and 2-gram of the whole text.

    A word that comes again at once, or after one other, also counts in the bucket
    of all such repeats.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            gaps = np.flatnonzero(_KIND[data[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
        parts.append(word_hashes(data[at:end]))
        at = end
    one = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * _MIX + one[1:]
    same = np.full(int((one[:-1] == one[1:]).sum()), _REPEATED)
    every_other = np.full(int((one[:-2] == one[2:]).sum()), _ALTERNATING)
    both = np.concatenate([one, two, same, every_other])
    return ((both ^ (both >> np.uint64(32))) * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # one per bucket, then the intercept


def fit(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "quality", per_label: int = SAMPLE_PER_LABEL,
) -> QualityModel:
    """Learn from the labels given (the caller has left held-out rows away).

    NULL labels teach nothing; of several labels of one document the smallest
    counts. ``per_label`` bounds the sample, which is why it may be broadcast.
    """
    marked = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("cls"))
    )
    sample = bounded_sample(marked, "key", "cls", per_label)

    @F.arrow_udf("struct<idx: array<int>, val: array<float>>")
    def features(batch: pa.Array) -> pa.Array:
        idx, val = [], []
        for x in batch:
            b = buckets(x.as_py() or "")
            at, n = np.unique(b, return_counts=True)
            idx.append(at.astype(np.int32))
            val.append((n / np.sqrt(max(1, len(b)))).astype(np.float32))
        return pa.StructArray.from_arrays(
            [pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["idx", "val"]
        )

    rows = (
        documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(F.broadcast(sample), "key")
        .select("key", features("text").alias("f"), "cls").select("key", "f.idx", "f.val", "cls")
    )
    return QualityModel(ftrl.train(rows, 1 << BUCKET_BITS, 1, penalty=ftrl.Penalty(l1=0.02))[:, 0])


def score(text: Column, model: QualityModel) -> Column:
    """The probability of label 1, over the whole text; NULL counts as empty.

    A text without words gets the score of the intercept alone.
    """
    weights, intercept = model.weights[:-1].astype(np.float32), float(model.weights[-1])

    @F.arrow_udf("double")
    def dot(batch: pa.Array) -> pa.Array:
        out = []
        for x in batch:
            b = buckets(x.as_py() or "")
            margin = float(weights[b].sum(dtype=np.float64)) / np.sqrt(max(1, len(b))) + intercept
            out.append(1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, margin)))))
        return pa.array(out, pa.float64())

    return dot(text)
