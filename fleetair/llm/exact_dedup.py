"""Exact de-duplication that no group of copies can slow down.

Copies are merged in three steps, each of which compares the digest and then the
full normalised text: within a map task, within a salt, and across salts. Every map
task sends one row per text it holds, every salt one row per text it received, so
the last step meets at most ``SALTS`` rows of a text however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetair.llm.common import written

SALTS = 16
#: Characters that do not count when texts are compared.
SPACE = " \t\n\v\f\r"
_ID_SPAN = 1 << 65


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _big(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def _rank(length: Column, key: Column) -> Column:
    """One number that grows with the length, then with a smaller key; NULL keys last.

    A number of fixed width lets the aggregation stay a hash aggregation.
    """
    below = F.coalesce(_big(1 << 63) - key.cast("decimal(20,0)"), _big(0))
    return (length.cast("decimal(10,0)") * _big(_ID_SPAN) + below).cast("decimal(38,0)")


def _key_of(rank: Column) -> Column:
    below = rank % _big(_ID_SPAN)
    return F.when(below > 0, (_big(1 << 63) - below).cast("long"))


def _length_of(rank: Column) -> Column:
    return F.floor((rank - rank % _big(_ID_SPAN)) / _big(_ID_SPAN)).cast("long")


def groups(rows: DataFrame) -> DataFrame:
    """``sha, of_digest, text, rank, n`` per distinct text of ``sha, text, rank``.

    ``of_digest`` is the number of different texts with this digest; ``text`` is
    given only where that is more than one.
    """
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    merged = [F.max("rank").alias("rank"), F.sum("n").alias("n")]
    winners = (
        salted.withColumn("n", F.lit(1).cast("long"))
        .groupBy("sha", "text", "salt").agg(*merged)
    )
    # Dealt by digest, so that texts of one digest meet without another exchange.
    whole = winners.repartition("sha").groupBy("sha", "text").agg(*merged)
    of_digest = F.count(F.lit(1)).over(Window.partitionBy("sha"))
    return (
        whole.withColumn("of_digest", of_digest)
        .select("sha", "of_digest", F.when(F.col("of_digest") > 1, F.col("text")).alias("text"), "rank", "n")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when identical without the characters of ``SPACE``; NULL counts as
    empty. Of equal texts the row with the most code points, then the smallest key
    stays; a NULL key comes after every other. Rows that tie in both are the same row
    repeated and share their fate. ``group_size`` counts rows.
    """
    plain = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    rows = (
        plain.select("key", F.length("raw").alias("length"), normalised(F.col("raw")).alias("text"))
        .select("key", _rank(F.col("length"), F.col("key")).alias("rank"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text")
    )
    found = written(groups(rows), "groups")
    best = found.select("sha", F.col("text").alias("same_text"), "of_digest", F.col("rank").alias("best"), F.col("n").alias("group_size"))

    joined = rows.select("key", "rank", "sha").join(best.where("of_digest = 1").drop("same_text", "of_digest"), "sha")
    shared = best.where("of_digest > 1")
    if not shared.isEmpty():  # two texts with one digest: the text decides
        other = rows.join(shared, "sha").where(F.col("text") == F.col("same_text"))
        joined = joined.unionByName(other.select(*joined.columns))
    return joined.select(
        F.col("key").alias(key), _key_of(F.col("best")).alias("keep_id"), "group_size",
        (F.col("rank") == F.col("best")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
