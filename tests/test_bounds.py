"""Nothing is cut: tiny and huge values, many bands, many labels, odd numbers in lines."""

import math

import pytest
from pyspark.sql import functions as F

from fleetair.operators import asof, ml
from fleetair.operators import timeseries as ts_ops
from fleetair.sources import logs


def test_trailing_means_of_any_magnitude(spark):
    values = [1e-300, 3e-300, 1e300, None, float("nan"), -2.5, 7.25e-9, 1e26, float("inf"), 2e26, 4e-320, 123456.789, 1.5e308]
    rows = [("d", i * 10, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.s: r for r in ts_ops.trailing_means(df, "k", "ts", {"v": {"m": 10, "now": 0, "more": 35}}).collect()}
    good = lambda v: v is not None and math.isfinite(v)
    for i in range(len(values)):
        for name, back in (("m", 1), ("now", 0), ("more", 3)):
            window = [x for x in values[max(0, i - back) : i + 1] if good(x)]
            want = math.fsum(window) / len(window) if window else None
            assert got[i * 10][name] == (pytest.approx(want, rel=1e-12, abs=1e-330) if want is not None else None)


def test_many_bands(spark):
    bands = spark.range(100_000).select(
        F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"),
        (F.col("id") * 2).alias("index_lo"), (F.col("id") * 2 + 2).alias("index_hi"))
    df = spark.createDataFrame([(0.5,), (1499.75,), (99_999.5,), (100_000.0,), (-1.0,), (None,)], "x double")
    got = [r.aqi for r in ts_ops.aqi_band(df, "x", bands).collect()]
    assert got == [1.0, 2999.5, 199_999.0, None, None, None]
    gaps = bands.where("lo % 10 <> 3")
    assert [r.aqi for r in ts_ops.aqi_band(df.where("x > 0 AND x < 4").union(spark.createDataFrame([(3.5,), (13.0,)], "x double")), "x", gaps).collect()] == [1.0, None, None]
    assert ts_ops.aqi_band(df, "x", bands.where("false")).where("aqi IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="bands overlap"):
        ts_ops.aqi_band(df, "x", bands.union(bands.where("lo = 7"))).collect()


@pytest.mark.parametrize("limit", [1 << 27, 0])
def test_bands_are_not_copied_for_each_row(spark, monkeypatch, limit):
    """Rows times bands would be terabytes; sent to the executors or shuffled, bands give the same."""
    monkeypatch.setattr(ts_ops, "MAX_BROADCAST_BYTES", limit)
    bands = spark.range(200_000).select(
        "id", F.col("id").alias("lo"), F.when(F.col("id") == 199_999, float("inf")).otherwise(F.col("id") + 0.5).alias("hi"),
        F.col("id").alias("index_lo"), (F.col("id") + 1).alias("index_hi"))
    df = spark.range(400_000).select("id", (F.col("id") / 2.0 + 0.25).alias("x")).repartition(4)
    found = ts_ops.aqi_band(df, "x", bands)
    assert found.columns == ["id", "x", "aqi"]
    in_band, wrong = found.agg(
        F.count("aqi"), F.count(F.when(~F.col("aqi").eqNullSafe(F.when(F.col("id") % 2 == 0, F.col("id") / 2 + 0.5)), 1))).first()
    # The last band has no end, and its share of it is none.
    assert (in_band, wrong) == (200_001, 2)
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,), (0.0,), (-0.0,), (1e300,), (64.0,)], "x double").coalesce(1)
    got = {str(r.x): r.aqi for r in ts_ops.aqi_band(odd, "x", bands).collect()}
    assert got == {"nan": None, "-inf": None, "None": None, "0.0": 0.0, "-0.0": 0.0, "1e+300": 199_999.0, "64.0": 64.0}
    pages_apart = bands.withColumn("hi", F.when(F.col("id") == 63, 64.5).otherwise(F.col("hi")))
    with pytest.raises(Exception, match="bands overlap"):
        ts_ops.aqi_band(odd, "x", pages_apart).collect()


def test_no_row_carries_the_table_of_bands(spark):
    bands = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0), (1.0, 2.0, 1.0, 2.0)], "lo double, hi double, index_lo double, index_hi double")

    def kinds(plan):
        return [plan.schema().simpleString(), *(k for i in range(plan.children().size()) for k in kinds(plan.children().apply(i)))]

    found = ts_ops.aqi_band(spark.range(3).select(F.col("id").cast("double").alias("x")), "x", bands)
    assert [k for k in kinds(found._jdf.queryExecution().optimizedPlan()) if "array<" in k] == []
    assert [r.aqi for r in found.collect()] == [0.0, 1.0, None]


def test_many_labels(spark):
    df = spark.range(36_000).select("id", (F.col("id") % 12_000).alias("label"))
    sizes = ml.assign_split(df, "id", "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t"))
    assert sizes.where("n = 3 and t = 1").count() == 12_000


def test_building_a_plan_starts_no_job(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("label"), F.col("id").cast("double").alias("x"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    params = ml.fit_scaler(df, ["x"])
    plans = [
        ml.assign_split(df, "id", "label"), ml.standardise(df, ["x"], params),
        ml.score_readings(df, params, [{"w": [[1.0], [2.0]], "b": [0.0, 0.0], "act": "softmax"}], ["x"]),
    ]
    assert list(tracker.getJobIdsForGroup("plans")) == []
    assert all(p.count() == 100 for p in plans)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_missing_parameters_end_the_query(spark):
    df = spark.range(3).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    with pytest.raises(Exception, match="no parameters for y"):
        ml.standardise(df, ["x", "y"], ml.fit_scaler(df, ["x"])).collect()


def test_lines_with_nan_and_inf(spark):
    fields = ["1", "5", "nan", "3", "-inf", "6", "7", "8", "Infinity", "1e3", "-nan", "12", "13", "14", "0", "1", "2"]
    bad = [*fields[:4], "12d", *fields[5:]]
    early = ["1.0", *fields[1:]]
    df = spark.createDataFrame([(",".join(x) + "\r\n",) for x in (fields, bad, early)], "line string")
    got = logs.parse_output_lines(df).collect()
    assert len(got) == 1
    r = got[0]
    names = ("iaq", "static_iaq", "humidity", "pressure", "gas_resistance", "status")
    assert [repr(getattr(r, n)) for n in names] == ["nan", "-inf", "inf", "1000.0", "nan", "2"]


def test_repeated_calibration_does_not_multiply(spark):
    raw = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, adc int")
    calib = spark.createDataFrame([("a", 7), ("a", 5), ("c", 1)], "k string, par int")
    got = asof.with_calibration(raw, calib, "k").select("adc", "calib.par").collect()
    assert sorted(map(tuple, got)) == [(1, 5), (2, 5)]
    registry = spark.createDataFrame([("a", 0x6320), ("a", 0x6320), ("b", 1)], "k string, pid int")
    ok, rest = asof.registry_check(raw, registry, "k", 0x6320)
    assert ok.count() == 2 and rest.count() == 1
