"""A corpus pipeline: language, near-duplicates, contamination, mixture, shards.

Every stage takes all that the one before kept and returns the columns of its input;
the last adds ``shard``, ``slot``, ``size`` and ``text_crc32``. An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetair.llm import decontaminate, language, mixing, sharding, simhash
from fleetair.llm.common import free_name, sent, table, text_bytes, written
from fleetair.llm.queries import DOMAIN_WEIGHTS, domain_labels

#: A document in which no language is this likely is rejected.
MIN_CONFIDENCE = 0.35
SHARDS = 16

#: Language identification learns from rows of the corpus itself, so no SQL can tell.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters, and those of no clear language."""
    model = language.fit(docs)
    if not model.languages:  # nothing to learn from: only letters can be asked for
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = free_name(docs, "_language")
    found = docs.withColumn(name, language.predict(F.col("text"), model))
    sure = (F.col(name)["lang_pred"] != language.UNKNOWN) & (F.col(name)["score"] >= MIN_CONFIDENCE)
    return found.where(sure).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by their fitted rates, at most once each."""
    mixed = mixing.mix(docs, domain_labels(table(spark, sf_dir, "labels")), DOMAIN_WEIGHTS)
    copies = mixed.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("copies").alias("_copies"))
    gone = written(copies.where("_copies = 0").select("_gone"), "gone")
    gone = sent(gone, 16 + text_bytes(F.col("_gone")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, n_shards=SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
