"""Pairing and labelling as one stream, in many batches and in any order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from fleetair.operators import asof, pairing
from fleetair.plans.losses import Losses
from fleetair.plans.scratch import scratch_path
from fleetair.sources import logs
from fleetair.streaming import operators as st
from fleetair.streaming import stateful

KEYS = "k string, ts timestamp, id long, side string, a double, b double"
END = "2100-01-01 00:00:00"


def rows(spark, n, seed):
    """Readings and commands of a few devices, a NULL device among them, with ties of the time."""
    rng = random.Random(seed)
    readings, commands = [], []
    for i in range(n):
        k, t = rng.choice(["x", "y", None]), 1000 + rng.randrange(n) * 0.4
        if rng.random() < 0.2:
            commands.append((k, t, 10_000 + i, rng.randrange(3), f"name{i}"))
        else:
            readings.append((k, t, i, rng.choice("AAB"), i * 1.0, -i * 1.0))
    as_time = lambda df: df.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    r = as_time(spark.createDataFrame(readings, KEYS.replace("timestamp", "double")))
    c = as_time(spark.createDataFrame(commands, "k string, ts double, id long, label int, event_name string"))
    return r, c.withColumn("label", F.col("label").cast("tinyint"))


def arriving(spark, df, files, seed, kind):
    """A stream of small files: rows come up to a minute late, and a last row ends it."""
    path = scratch_path(spark, "arriving")
    late = F.floor((F.unix_micros("ts") / 1_000_000 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(60))) / F.lit(files))
    numbered = df.withColumn("_at", late).orderBy("_at").collect()
    size = -(-len(numbered) // files)
    for i in range(0, len(numbered), size):
        part = spark.createDataFrame([tuple(r)[:-1] for r in numbered[i : i + size]], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    end = spark.range(1).select(*[
        F.lit(END).cast("timestamp").alias(c) if c == "ts" else F.lit("end").alias(c) if c == "k" else F.lit(-1).cast("long").alias(c) if c == "id"
        else F.lit("A").alias(c) if c == "side" else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    end.coalesce(1).write.mode("append").parquet(path)
    return logs.stream_readings(spark, path, df.schema, files_per_batch=1)


@pytest.mark.parametrize("slot_ms", [86_400_000, 7_000])
def test_chain_equals_batch(spark, monkeypatch, slot_ms):
    monkeypatch.setattr(stateful.in_order, "__defaults__", (slot_ms,))
    r, c = rows(spark, 240, 5)
    # Times that tie are ordered by id; a command goes before a reading of its time.
    pairs = pairing.pair_latest(r, "k", ["ts", "id"], "side", ["a"], ["b"])
    want = asof.label_asof(pairs, c, "k", "ts", "id")
    delay = "200 seconds"
    streamed = st.chained_pair(arriving(spark, r, 4, 1, "r"), "k", "ts", "id", "side", ["a"], ["b"], delay)
    both = st.chained_label(streamed, arriving(spark, c, 3, 2, "c"), "k", "ts", "id", delay)
    out = scratch_path(spark, "chained")
    both.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "cp")) \
        .trigger(availableNow=True).start().awaitTermination()
    columns = ["k", "ts", "id", "a", "b", "label", "event_name", "label_source"]
    got = spark.read.schema(both.schema).parquet(out).where("k IS NULL OR k <> 'end'")
    tuples = lambda df: sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert tuples(got) == tuples(want) and want.count() > 30


def test_losses_of_tables_add_up(spark):
    found = Losses()
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 4 != 0, F.col("id")))
    watched = found.watch(df, "first", {"none": F.col("v").isNull(), "odd": F.col("id") % 2 == 1, "never": F.lit(False)})
    assert watched.where("v IS NOT NULL AND id % 2 = 0").count() == 25
    assert {(r.stage, r.reason): r.rows for r in found.report(spark).collect()} == {
        ("first", "in"): 100, ("first", "kept"): 25, ("first", "none"): 25, ("first", "odd"): 50, ("first", "never"): 0}
    with pytest.raises(ValueError, match="watched already"):
        found.watch(df, "first", {})
