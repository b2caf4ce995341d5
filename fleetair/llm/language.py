"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams, hashed into buckets.
Document frequencies come from all learning rows. The model is trained with
follow-the-regularised-leader under elastic-net penalties, on a bounded sample of
labelled rows, and its temperature is fitted on sampled rows kept out of training.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.llm import ftrl
from fleetair.llm.common import bounded_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BITS = 16
MAX_GRAM = 3
SAMPLE_PER_LANGUAGE = 3_000
#: Code points hashed at a time, so that one text of any length needs bounded memory.
PIECE = 1 << 20
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = regex.compile(r"\p{L}")


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket of character n-grams occurs in the whole text."""
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    shift = np.uint64(64 - BUCKET_BITS)
    for at in range(0, len(text), PIECE):
        # A piece starts MAX_GRAM - 1 characters early; grams wholly before it are skipped.
        lead = min(at, MAX_GRAM - 1)
        piece = text[at - lead : at + PIECE].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code = (code + np.uint64(1)) * _MIX
        h = code
        for size in range(1, MAX_GRAM + 1):
            if size > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MIX + code[size - 1 :]
            fresh = h[max(0, lead - size + 1) :]
            counts += np.bincount(
                ((fresh ^ (fresh >> np.uint64(31))) * _MIX >> shift).astype(np.int64),
                minlength=1 << BUCKET_BITS,
            )
    return counts


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(text)
    idx = np.flatnonzero(counts)
    val = (1.0 + np.log(counts[idx])) * idf[idx]
    norm = np.sqrt(val @ val)
    return idx, val / norm if norm else val


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # one row per bucket, then the intercept
    temperature: float


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts.

    Every partition sends one row per bucket it met; the sums are one row per bucket.
    """
    def count(batches):
        seen, rows = np.zeros(1 << BUCKET_BITS, dtype=np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen += gram_counts(value.as_py()) > 0
                rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], ["at", "n"]
        )

    sums = (
        texts.select(F.col(text)).where(F.col(text).isNotNull())
        .mapInArrow(count, "at long, n long")
        .groupBy("at").agg(F.sum("n").alias("n"))
    ).toArrow()
    at, n = sums["at"].to_numpy(), sums["n"].to_numpy()
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    total[at[at >= 0]] = n[at >= 0]
    return total, int(n[at < 0].sum())


def fit_temperature(margins: np.ndarray, cls: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search."""
    def loss(log_t: float) -> float:
        z = margins / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(cls)), cls]))

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(
    rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from the rows given (the caller has left held-out rows away).

    Rows without text, without a letter or without a language teach nothing.
    ``per_language`` bounds the labelled sample; document frequencies use all rows.
    """
    known = rows.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    frequency, n_texts = document_frequencies(known)
    idf = np.log((1.0 + n_texts) / (1.0 + frequency)) + 1.0
    sample = bounded_sample(known, "key", "lang", per_language)
    languages = tuple(sorted(r[0] for r in known.select("lang").distinct().collect()))
    if not languages:
        return LanguageModel((), idf, np.zeros((len(idf) + 1, 0)), 1.0)

    @F.arrow_udf("struct<idx: array<int>, val: array<float>>")
    def features(batch: pa.Array) -> pa.Array:
        found = [tfidf(x.as_py(), idf) for x in batch]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.list_(pa.int32())),
             pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))],
            ["idx", "val"],
        )

    cls = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1
    ready = sample.select(
        "key", features("text").alias("f"), cls.cast("int").alias("cls"),
        (F.pmod(F.xxhash64(F.lit("calibration"), "key"), F.lit(5)) == 0).alias("kept_out"),
    ).select("key", "f.idx", "f.val", "cls", "kept_out")
    weights = ftrl.train(ready.where(~F.col("kept_out")), len(idf), len(languages))

    def margin(batches):
        for b in batches:
            idx, val = b.column("idx"), b.column("val")
            z = [
                (np.asarray(val[i].values) @ weights[np.asarray(idx[i].values)] + weights[-1]).tolist()
                for i in range(b.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("cls"), pa.array(z, pa.list_(pa.float64()))], ["cls", "z"]
            )

    held = ready.where("kept_out").select("idx", "val", "cls").mapInArrow(
        margin, "cls int, z array<double>").toArrow()
    temperature = 1.0
    if held.num_rows and len(languages) > 1:
        temperature = fit_temperature(np.array(held["z"].to_pylist()), held["cls"].to_numpy())
    return LanguageModel(languages, idf, weights, temperature)


def predict(text: Column, model: LanguageModel) -> Column:
    """struct<lang_pred string, score double> of a text column, over whole texts.

    ``score`` is the calibrated probability of the predicted language. A text that
    is NULL or has no letter, and any text when the model knows no language, is
    ``und`` with score 0. Of equally likely languages the first by name is taken.
    """
    languages, temperature = model.languages, model.temperature
    idf, weights = model.idf, model.weights[:-1].astype(np.float32)
    intercept = model.weights[-1]

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def score(batch: pa.Array) -> pa.Array:
        names, scores = [], []
        for value in batch:
            t = value.as_py()
            if t is None or not languages or not _LETTER.search(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            idx, val = tfidf(t, idf)
            z = (val @ weights[idx] + intercept) / temperature
            p = np.exp(z - z.max())
            best = int(p.argmax())
            names.append(languages[best])
            scores.append(float(p[best] / p.sum()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return score(text)
