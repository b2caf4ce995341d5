"""Streams give the batch result, however the input is cut or delayed."""

import pytest
from pyspark.sql import functions as F

from fleetair.checks import core
from fleetair.operators import asof, pairing
from fleetair.sources import adapters as ad
from fleetair.sources import logs
from fleetair.streaming import operators as st

END = "2100-01-01 00:00:00"


@pytest.fixture(scope="module")
def events(spark, sf):
    e = ad.events(spark, sf).where("user_id < 6").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.cache()


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


class Feed:
    """A folder that receives a table in pieces, one stream run per piece."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.schema = spark, schema
        self.path, self.out, self.checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def stream(self):
        return logs.stream_readings(self.spark, self.path, self.schema)

    def add(self, df):
        df.coalesce(1).write.mode("append").parquet(self.path)

    def run(self, df):
        """Start from the checkpoint, take what is there, stop."""
        q = (df.writeStream.format("parquet").option("path", self.out)
             .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    def result(self, df):
        return self.spark.read.schema(df.schema).parquet(self.out)


def closing(spark, df):
    return spark.range(1).select(*[
        F.lit(END).cast("timestamp").alias(f.name) if f.name == "ts"
        else F.lit("A").alias(f.name) if f.name == "side"
        else F.lit("click").alias(f.name) if f.name == "event_type"
        else F.lit(-1).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def day(df, a, b):
    return df.where((F.dayofmonth("ts") >= a) & (F.dayofmonth("ts") < b))


def pair_input(events):
    r = ad.readings_of(events)
    return r.withColumns({"value_a": F.col("value"), "value_b": F.col("value")}).drop("value")


def test_pair_late_rows_and_restarts(spark, events, tmp_path):
    """Days arrive out of order inside the watermark; every run restarts."""
    r = pair_input(events)
    feed = Feed(spark, tmp_path, r.schema)
    for part in (day(r, 4, 7), day(r, 1, 4), day(r, 10, 16), day(r, 7, 10), day(r, 16, 40), closing(spark, r)):
        feed.add(part)
        pairs = st.stream_pair(
            feed.stream(), "device_id", "ts", "event_id", "side", ["value_a"], ["value_b"], "10 days")
        feed.run(pairs)
    batch = pairing.pair_latest(r, "device_id", ["ts", "event_id"], "side", ["value_a"], ["value_b"])
    assert rows(feed.result(pairs)) == rows(batch)


def test_rows_past_the_watermark_are_dropped_and_counted(spark, events, tmp_path):
    r = pair_input(events)
    feed = Feed(spark, tmp_path, r.schema)
    build = lambda: st.stream_pair(
        feed.stream(), "device_id", "ts", "event_id", "side", ["value_a"], ["value_b"], "1 day")
    feed.add(day(r, 20, 22))
    feed.run(build())
    late = day(r, 1, 3)
    feed.add(late)
    q = feed.run(build())
    dropped = sum(
        int(op["numRowsDroppedByWatermark"]) for p in q.recentProgress for op in p["stateOperators"])
    assert dropped == late.count() > 0


def test_label_over_batches(spark, events, tmp_path):
    feed = Feed(spark, tmp_path, events.schema)
    for part in (day(events, 1, 9), day(events, 9, 17), day(events, 17, 40), closing(spark, events)):
        feed.add(part)
        s = feed.stream()
        out = st.stream_label(
            ad.readings_of(s), core.label_commands(ad.commands_of(s)), "device_id", "ts", "event_id", "1 hour")
        feed.run(out)
    batch = asof.label_asof(
        ad.readings_of(events), core.label_commands(ad.commands_of(events)), "device_id", "ts", "event_id")
    assert rows(feed.result(out).where("device_id >= 0")) == rows(batch)


def test_dedup_within_watermark(spark, events, tmp_path):
    r = events.select(F.col("user_id").alias("device_id"), F.date_trunc("day", "ts").alias("ts"))
    feed = Feed(spark, tmp_path, r.schema)
    for part in (day(r, 1, 5), day(r, 1, 8)):
        feed.add(part)
        out = st.stream_dedup(feed.stream(), "device_id", "ts", "30 days")
        feed.run(out)
    assert rows(feed.result(out)) == rows(day(r, 1, 8).distinct())


def test_rollup_rejects_unknown_kind(events):
    with pytest.raises(ValueError, match="kind"):
        st.stream_rollup(events, "user_id", "ts", ["value"], "hopping")
