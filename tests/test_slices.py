"""Slicing a hot key must not change any result."""

import random

import pytest
from pyspark.sql import functions as F

from fleetair.operators import asof, pairing, quality
from fleetair.operators import timeseries as ts_ops
from fleetair.plans.timeline import Timeline, first_per_group, plan_slices
from fleetair.sources import adapters as ad

MAX_ROWS = 40


def hot_events(spark, sf):
    """A third of all events belong to device 0; NULL is a large key as well."""
    e = ad.events(spark, sf)
    key = (
        F.when(F.col("event_id") % 3 == 0, 0)
        .when(F.col("event_id") % 5 == 0, None)
        .otherwise(F.col("user_id"))
    )
    return e.withColumn("user_id", key.cast("long"))


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.fixture(scope="module")
def hot(spark, sf):
    df = hot_events(spark, sf).cache()
    assert df.count() > 500
    return df


def sliced(df, pos="ts", key="device_id", max_rows=MAX_ROWS):
    s = plan_slices(df, key, pos, max_rows)
    assert s.n_hot >= 1 and s.n_slices > 5
    return s


def test_slices_bound_every_task(hot):
    r = ad.readings_of(hot)
    tagged = sliced(r).tag(r)
    most = tagged.groupBy("device_id", "_slice").count().agg(F.max("count")).first()[0]
    assert most <= MAX_ROWS
    assert tagged.count() == r.count()


def test_bursts_are_narrowed(spark):
    """Nearly all rows of the key in one second of a year."""
    df = spark.range(3000).select(
        F.lit(1).alias("k"),
        F.when(F.col("id") < 10, F.col("id") * 3_000_000_000_000)
        .otherwise(5_000_000_000_000 + F.col("id") * 300).alias("t"),
    )
    s = plan_slices(df, "k", "t", 100)
    most = s.tag(df).groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert most <= 100


def test_ties_cannot_be_split_but_are_kept(spark):
    df = spark.range(300).select(F.lit(1).alias("k"), F.lit(7).alias("t"), "id")
    with pytest.warns(UserWarning, match="share one value"):
        s = plan_slices(df, "k", "t", 100)
    out = Timeline(df, "k", ["t", "id"], s).scan(total={"n": F.lit(1)}).result()
    assert out.agg(F.max("n")).first()[0] == 300


@pytest.mark.parametrize("max_rows", [7, 90])
def test_pair_latest(hot, max_rows):
    r = ad.readings_of(hot).withColumn("value_b", F.col("value"))
    args = ("device_id", ["ts", "event_id"], "side", ["value"], ["value_b"])
    plain = pairing.pair_latest(r, *args)
    cut = pairing.pair_latest(r, *args, slices=sliced(r, max_rows=max_rows))
    assert rows(plain) == rows(cut)


def test_pair_latest_alternating_hot_key(spark):
    """A key that never repeats a side carries its parity over every slice."""
    df = spark.range(500).select(
        F.lit("d").alias("k"), F.col("id").alias("t"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("side"),
    ).withColumns({"a": F.col("t"), "b": F.col("t")})
    s = plan_slices(df, "k", "t", 23)
    out = pairing.pair_latest(df, "k", "t", "side", ["a"], ["b"], slices=s)
    assert [r.t for r in out.orderBy("t").collect()] == list(range(1, 500, 2))


def test_asof(hot):
    from fleetair.checks.core import label_commands

    r, c = ad.readings_of(hot), label_commands(ad.commands_of(hot))
    plain = asof.label_asof(r, c, "device_id", "ts", "event_id")
    cut = asof.label_asof(r, c, "device_id", "ts", "event_id", sliced(r))
    assert rows(plain) == rows(cut)


OPS = {
    "hold_last": lambda r, s: asof.hold_last(r, "device_id", ["ts", "event_id"], ["va", "vb"], s),
    "counter": lambda r, s: ts_ops.sample_counter(r, "device_id", ["ts", "event_id"], slices=s),
    "warmup": lambda r, s: quality.drop_warmup(r, 30, "device_id", ["ts", "event_id"], s),
    "check": lambda r, s: quality.timestamp_check(r, "device_id", "step", "flag", ["ts", "event_id"], s),
    "cadence": lambda r, s: ts_ops.cadence_violations(
        r, "device_id", "ts", 3600, 1800, ["ts", "event_id"], s),
    "boots": lambda r, s: ts_ops.boot_segments(r, "device_id", ["ts", "event_id"], "ms", 2**30, s),
    "intervals": lambda r, s: ts_ops.label_intervals(
        r, "device_id", ["ts", "event_id"], "label", "ts", s),
    "sequence": lambda r, s: ts_ops.order_by_sequence(
        r, "device_id", "idx", "ts", "event_id", "fresh", s),
}


def enriched(hot):
    return ad.readings_of(hot).withColumns({
        "va": F.when(F.col("event_id") % 7 == 0, F.col("value")),
        "vb": F.when(F.col("event_id") % 90 == 1, F.col("value")),
        "step": F.floor(F.col("event_id") % 50 / 3).cast("long"),
        "ms": F.col("event_id") * 97_654_321 % (2**32),
        "label": F.when(F.col("event_id") % 6 < 4, F.floor(F.col("event_id") / 20) % 3),
        "idx": (F.col("event_id") % 256).cast("int"),
        "fresh": F.col("event_id") % 4 != 0,
    })


@pytest.mark.parametrize("name", OPS)
def test_operator(hot, name):
    r = enriched(hot)
    assert rows(OPS[name](r, None)) == rows(OPS[name](r, sliced(r)))


def test_trailing_means(hot):
    """Equal to sums over every window, also for ties, the hot key and the NULL key."""
    r = ad.readings_of(hot).withColumn("ts", F.date_trunc("hour", "ts"))
    got = ts_ops.trailing_means(r, "device_id", "ts", {"value": {"m_1h": 3600, "m_1d": 86400}})
    data = r.collect()
    for g in got.collect():
        for name, seconds in (("m_1h", 3600), ("m_1d", 86400)):
            window = [x.value for x in data if x.device_id == g.device_id and 0 <= (g.ts - x.ts).total_seconds() <= seconds]
            assert g[name] == pytest.approx(sum(window) / len(window), rel=1e-12)
    assert got.count() == len(data)


def test_rows_without_a_time_are_cut_too(spark):
    """They come first, in the order of the second column, and have slices of their own."""
    df = spark.range(600).select(
        F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("t"), "id",
        F.when(F.col("id") % 7 < 3, "A").otherwise("B").alias("side"), F.col("id").cast("double").alias("v"),
    ).withColumn("u", F.col("v"))
    s = plan_slices(df, "k", "t", 60, tie="id")
    per_slice = s.tag(df).groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("timed"))
    assert per_slice.agg(F.max("n")).first()[0] <= 60
    assert per_slice.where("_slice < 0 AND timed = 0").count() >= 7
    args = ("k", ["t", "id"], "side", ["v"], ["u"])
    assert rows(pairing.pair_latest(df, *args)) == rows(pairing.pair_latest(df, *args, slices=s))


def test_input_is_read_once_however_many_functions(spark, tmp_path):
    """The rows of a cut table are read for the cuts and once more, whatever is asked of them."""
    path = str(tmp_path / "t")
    spark.range(400).select(F.lit("d").alias("k"), F.col("id").alias("t"), (F.col("id") * 37 % 101).alias("ms")).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.read.parquet(path)
    df = df.mapInArrow(count, df.schema)
    s = plan_slices(df, "k", "t", 50)
    out = ts_ops.boot_segments(df, "k", "t", "ms", 10, s)
    assert out.count() == 400 and out.agg(F.max("boot_id")).first()[0] > 100
    assert seen.value <= 2 * 400


def test_log_resistance_stats(hot):
    r = ad.readings_of(hot)

    def run(slices, block=50):
        out = ts_ops.log_resistance_stats(
            r, "device_id", ["ts", "event_id"], ["value"], 12, slices, block)
        return out.withColumns({
            c: F.round(c, 9) for c in ("value_log_mean", "value_log_var")})

    assert rows(run(None)) == rows(run(sliced(r)))


def test_first_per_group_keeps_every_group(spark):
    random.seed(3)
    data = [(random.randrange(20), random.randrange(100), i) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, v int, id int")
    best = {}
    for k, v, i in data:
        best[k] = min(best.get(k, (v, i)), (v, i))
    got = first_per_group(df, "k", ["v", "id"], count="n").collect()
    assert {(r.k, r.v, r.id) for r in got} == {(k, *x) for k, x in best.items()}
    assert sum(r.n for r in got) == 2000


def test_table_sessions(spark):
    """Equal to Spark's session windows, with ties and gaps of just the length."""
    from fleetair.streaming.operators import stream_rollup

    df = spark.range(400).select(
        (F.col("id") % 3).alias("k"),
        F.timestamp_seconds(F.floor(F.col("id") / 4) * 150 % 7919).alias("ts"),
        F.col("id").cast("double").alias("v"),
    )
    edges = spark.createDataFrame([(9, t, 1.0) for t in (0, 300, 601, 602)], "k long, t long, v double")
    df = df.unionByName(edges.select("k", F.timestamp_seconds("t").alias("ts"), "v"))
    spark_own = df.groupBy("k", F.session_window("ts", "5 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("v").alias("v_mean")
    ).select("k", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "v_mean")

    def ours(slices=None):
        return stream_rollup(df, "k", "ts", ["v"], "session", gap="5 minutes", watermark=None, slices=slices)

    assert rows(ours()) == rows(spark_own)
    assert rows(ours(plan_slices(df, "k", "ts", 20))) == rows(spark_own)
