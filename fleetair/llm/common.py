"""Small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetair.plans.scratch import scratch_path

_HASH_STEPS = 1_000_000
#: Bytes of a table that is sent to every executor, measured.
MAX_SENT_BYTES = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3. Remainder 1 is held out of learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def bounded_sample(df: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``key``.

    The counts per label are taken over all rows; a label with fewer rows keeps
    them all. The driver holds one count per label.
    """
    counts = df.groupBy(label).count().where(F.col(label).isNotNull()).collect()
    if not counts:
        return df.limit(0)
    share = F.lit(0)
    for row in counts:
        share = F.when(
            F.col(label) == F.lit(row[label]),
            F.lit(min(_HASH_STEPS, _HASH_STEPS * per_label // row["count"])),
        ).otherwise(share)
    position = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(_HASH_STEPS))
    return df.where(F.col(label).isNotNull() & (position < share))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it again.

    Later jobs start from the files, also after executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(value: Column) -> Column:
    """About how many bytes a value takes."""
    return F.coalesce(F.octet_length(value.cast("string")), F.lit(0))


def sent(df: DataFrame, width: Column) -> DataFrame:
    """A written table marked for every executor if its rows, of so many bytes, are few enough.

    A larger one is joined through a shuffle.
    """
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= MAX_SENT_BYTES else df
