"""Hand-computed values, and properties checked against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetair.functions import codes, decode, scoring
from fleetair.operators import asof, metrics, ml, pairing, quality, reshape
from fleetair.operators import timeseries as ts_ops
from fleetair.schema import FEATURES, OUTPUT_IDS, SCAN_OUTPUT_IDS
from fleetair.sources import logs


def emits(seq):
    """Positions at which a row completes a pair, walking with two flags."""
    a = b = False
    for i, s in enumerate(seq, 1):
        a, b = a or s == "A", b or s == "B"
        if a and b:
            yield i
            a = b = False


def pair_positions(spark, sequences):
    rows = [(k, i, s) for k, seq in enumerate(sequences) for i, s in enumerate(seq, 1)]
    df = spark.createDataFrame(rows, "k int, i long, side string")
    df = df.withColumns({"a": F.col("i"), "b": F.col("i")})
    out = pairing.pair_latest(df, "k", "i", "side", ["a"], ["b"])
    found = {k: [] for k in range(len(sequences))}
    for r in out.orderBy("k", "i").collect():
        assert max(r.a, r.b) == r.i
        seq = sequences[r.k]
        assert r.a == max(j for j in range(1, r.i + 1) if seq[j - 1] == "A")
        assert r.b == max(j for j in range(1, r.i + 1) if seq[j - 1] == "B")
        found[r.k].append(r.i)
    return found


@pytest.mark.parametrize("seq, want", [
    ("AB", [2]), ("AABBA", [3, 5]), ("ABAB", [2, 4]), ("ABAAB", [2, 5]), ("AAAA", []),
])
def test_pair_fixture(seq, want):
    assert list(emits(seq)) == want


def test_pair_latest_equals_walk(spark):
    random.seed(11)
    sequences = ["AB", "AABBA", "ABAB", "ABAAB", "AAAA"]
    sequences += ["".join(p) for n in range(1, 8) for p in itertools.product("AB", repeat=n)]
    sequences += ["".join(random.choices("AB", k=random.randrange(1, 60))) for _ in range(300)]
    got = pair_positions(spark, sequences)
    assert got == {k: list(emits(s)) for k, s in enumerate(sequences)}


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_gas_resistance(spark):
    r = one(spark, a=decode.gas_resistance(F.lit(512), F.lit(0)),
            b=decode.gas_resistance(F.lit(512), F.lit(4)))
    assert (r.a, r.b) == (64_000_000, 4_000_000)


def test_rmox(spark):
    r = one(spark, x=decode.rmox_array(F.lit([900, 1000, 3000, 4000, 2000]), F.lit(10), F.lit(1000), F.lit(3000)))
    assert r.x == [100, 100, 1e12, 1e12, 10_000]


def frames(spark, *data):
    return spark.createDataFrame([(bytes(x),) for x in data], "frame binary")


def test_ambient(spark):
    out = decode.ambient_hs3(frames(
        spark, [0, 0, 0, 0], [0xFF, 0xFF, 0xFF, 0xFC], [1, 2, 3, 1], [1, 2, 3])).collect()
    assert [(r.humidity, r.temperature) for r in out] == [(0, -40), (100, 125)]


def bit_crc(data):
    crc = 0xFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = ((crc << 1) ^ (0x11D if crc & 0x80 else 0)) & 0x1FF
    return crc & 0xFF


def test_crc(spark):
    assert bit_crc(b"123456789") == 0xB4
    assert one(spark, c=decode.crc8(F.hex(F.lit("123456789")), 9)).c == 0xB4
    random.seed(5)
    data = [bytes(random.randrange(256) for _ in range(4)) for _ in range(500)]
    good = [d + bytes([bit_crc(d)]) for d in data]
    bad = [d[:4] + bytes([d[4] ^ 1]) for d in good]
    assert decode.ambient_hs4(frames(spark, *good)).count() == 500
    assert decode.ambient_hs4(frames(spark, *bad)).count() == 0


def test_three_frames(spark):
    data = bytes(range(51))
    out = decode.split_frames(frames(spark, data)).orderBy("slot").collect()
    assert [bytes(r.frame) for r in out] == [data[0:17], data[17:34], data[34:51]]


def test_decode_frame_bytes(spark):
    f = [0x83, 7, 1, 2, 3, 4, 5, 6, 7, 8, 0, 0, 0, 0, 0, 0xAB, 0x40 | 0x20 | 0x10 | 0x05]
    r = decode.decode_frame(frames(spark, f, [1, 2])).collect()
    assert (r[0].status, r[0].gas_index, r[0].meas_index) == (0xB0, 3, 7)
    assert (r[0].adc_p, r[0].adc_t, r[0].adc_h) == (0x010203, 0x040506, 0x0708)
    assert (r[0].adc_g, r[0].gas_range) == (0xAB * 4 + 1, 5)
    assert r[1].adc_p is None


def test_sequence_wraps(spark):
    for slots in itertools.permutations([255, 0, 1]):
        df = spark.createDataFrame(
            [("d", 1, i, s, True) for i, s in enumerate(slots)] + [("d", 1, 9, 77, False)],
            "k string, read long, slot long, idx int, fresh boolean")
        out = ts_ops.order_by_sequence(df, "k", "idx", "read", "slot", "fresh").orderBy("seq_pos")
        assert [r.idx for r in out.collect()] == [255, 0, 1, 77]


def test_argmax_ties(spark):
    best, confidence = scoring.argmax_class(F.lit([0.4, 0.4, 0.2]))
    r = one(spark, c=best, p=confidence)
    assert (r.c, r.p) == (0, 0.4)


def test_fit_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in ml.fit_scaler(df, ["a", "b"]).collect()] == [("a", 2, 1), ("b", 5, 1)]


def test_class_name(spark):
    r = one(spark, a=codes.class_name(F.lit(-1)), b=codes.class_name(F.lit(3)), c=codes.class_name(F.lit(2)))
    assert tuple(r) == ("UNKNOWN", "UNKNOWN", "HIGH")


def test_error_event(spark):
    r = one(spark, a=codes.error_event(F.lit(0xC0)), b=codes.error_event(F.lit(0x40)), c=codes.error_event(F.lit(0)))
    assert tuple(r) == ("POR_EVENT", "ACCESS_CONFLICT", "OK")


def test_asof_before_anything(spark):
    rows = spark.createDataFrame([("d", 1)], "k string, t long")
    none = spark.createDataFrame([], "k string, t long, label tinyint, event_name string")
    r = asof.label_asof(rows, none, "k", "t").first()
    assert (r.label, r.event_name, r.label_source) == (0, "unlabeled", "default")
    none = spark.createDataFrame([("d", 0, None, 1.0)], "k string, t long, temperature double, humidity double")
    r = asof.ambient_asof(rows, none, "k", "t").first()
    assert (r.ambient_temperature, r.ambient_humidity) == (-300, 50)


def test_command_at_the_same_time_applies(spark):
    rows = spark.createDataFrame([("d", 5), ("d", 4)], "k string, t long")
    c = spark.createDataFrame([("d", 5, 1, "MODERATE", 1), ("d", 5, 2, "HIGH", 2)],
                              "k string, t long, label int, event_name string, n int")
    out = asof.label_asof(rows, c, "k", "t", "n").orderBy("t").collect()
    assert [(r.t, r.label) for r in out] == [(4, 0), (5, 2)]


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "line string")


def test_output_lines(spark):
    full = "0,12,50.5,3,1,2,3,21.5,40.25,101325,1e5,9,600,0.5,1,1,0\r\n"
    ten = "0,12,50.5,3,1,2,3,21.5,40.25,101325"
    nine = "0,12,50.5,3,1,2,3,21.5,40.25"
    broken = "0,12,bad,3,1,2,3,21.5,40.25,101325,1,2"
    out = logs.parse_output_lines(lines(spark, full, ten, nine, broken, "", None)).collect()
    assert len(out) == 2
    assert (out[0].timestamp_ms, out[0].temperature, out[0].humidity, out[0].status) == (12000, 21.5, 40.25, 0)
    assert (out[1].pressure, out[1].gas_resistance, out[1].status) == (101325, None, None)
    kept = logs.parse_output_lines(lines(spark, full, nine, "", None), keep_bad=True).collect()
    assert [r.line_ok for r in kept] == [True, False, False, False]


def test_boot_segments(spark):
    df = spark.createDataFrame(
        [("d", 1, 100), ("d", 2, 200), ("d", 3, 50), ("d", 4, 2**32 - 5), ("d", 5, 3)],
        "k string, i long, ms long")
    out = ts_ops.boot_segments(df, "k", "i", "ms").orderBy("i").collect()
    assert [r.boot_id for r in out] == [1, 1, 2, 2, 2]
    assert [r.boot_ms for r in out] == [100, 200, 50, 2**32 - 5, 2**32 + 3]


@pytest.mark.parametrize("g3, passed, ratio", [(24.0, True, 6), (11.0, False, 2)])
def test_self_test(spark, g3, passed, ratio):
    gas = [1.0, 1.0, 1.0, g3, 20.0, g3]
    df = spark.createDataFrame(
        [("d", 1, i, 25.0, 100000.0, 50.0, 0xB0, g) for i, g in enumerate(gas)],
        "device_id string, run int, seq int, temperature double, pressure double, "
        "humidity double, status int, gas_resistance double")
    r = quality.self_test(df).first()
    assert (r.passed, r.ratio, r.failures) == (passed, ratio, 0 if passed else 1)


def test_null_confidence_before_a_model_is_complete(spark):
    """A missing feature gives no class, not an unset confidence."""
    row = {n: 1.0 for n in FEATURES}
    df = spark.createDataFrame([(1, *row.values()), (2, *[None if n == "iaq" else 1.0 for n in FEATURES])],
                               "id int, " + ", ".join(f"{n} double" for n in FEATURES))
    params = spark.createDataFrame([(n, 0.0, 1.0) for n in FEATURES], "feature string, mean double, scale double")
    layers = [{"w": [[0.1] * 16, [0.2] * 16, [0.0] * 16], "b": [0, 0, 0], "act": "softmax"}]
    out = ml.score_readings(df, params, layers).orderBy("id").collect()
    assert (out[0].predicted, out[0].predicted_name) == (1, "MODERATE")
    assert (out[1].predicted, out[1].confidence, out[1].predicted_name) == (None, None, "UNKNOWN")


def test_layers_from_table(spark):
    rows = [(0, 1, [3.0, 4.0], 1.0, "relu"), (0, 0, [1.0, 2.0], 0.5, "relu"), (1, 0, [1.0, -1.0], 0.0, "linear")]
    df = spark.createDataFrame(rows, "layer int, unit int, weights array<double>, bias double, act string")
    layers = ml.layers_from_table(df)
    assert layers[0]["w"] == [[1.0, 2.0], [3.0, 4.0]]
    x = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    assert ml.dense_score(x, ["a", "b"], layers).first().probs == [3.5 - 8.0]


def test_long_to_wide(spark):
    df = spark.createDataFrame(
        [("d", 1, 10, 1, 7.0, 2), ("d", 1, 11, 1, 8.0, 3), ("d", 1, 12, 5, 9.0, 0), ("d", 1, 9, 6, 1.0, 1)],
        "k string, step int, time_ns long, sensor_id int, signal double, accuracy int")
    r = reshape.to_wide(df, ["k", "step"]).first()
    assert (r.iaq, r.iaq_accuracy, r.raw_temp, r.time_ns, r.breath_voc) == (8.0, 3, 1.0, 11, None)
    r = reshape.to_wide(df, ["k", "step"], fill=0).first()
    assert (r.breath_voc, set(OUTPUT_IDS.values()) <= set(r.asDict())) == (0.0, True)


def test_regression_outputs_share_the_estimates(spark):
    df = spark.createDataFrame(
        [("d", 10, 27, 0.25, 3), ("d", 10, 26, 4.0, 0)],
        "k string, time_ns long, sensor_id int, signal double, accuracy int")
    r = reshape.to_wide(df, "k", SCAN_OUTPUT_IDS).first()
    assert (r.gas_estimate_1, r.gas_accuracy_1, r.raw_gas_index) == (0.25, 3, 4.0)


def test_constant_mask_prunes_columns(spark):
    df = spark.createDataFrame([(1, 20.0, 50.0, 1e5, 0)], "id int, temperature double, humidity double, pressure double, status int")
    out = reshape.to_long(df, 0b100).collect()
    assert [(r.sensor_id, r.signal) for r in out] == [(3, 20.0)]


def test_split_counts_and_disjoint(spark):
    df = spark.range(997).withColumn("label", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 333 == 2, 2).otherwise(0))
    train, test = ml.stratified_split(df, "id", "label")
    n = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    k = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    assert k == {c: math.ceil(0.2 * m) for c, m in n.items()}
    assert train.count() + test.count() == 997
    assert train.join(test, "id").count() == 0


def test_split_does_not_depend_on_the_digits(spark):
    df = spark.range(5000).withColumn("label", (F.col("id") % 2).cast("int"))
    got = [
        {r.id for r in ml.assign_split(df, "id", "label", 0.3, 7, digits).where("is_test").collect()}
        for digits in (1, 2, 4, 32)
    ]
    assert len(got[0]) == 1500 and all(g == got[0] for g in got)


def test_report_on_empty_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, p int")
    out = {r["class"]: r for r in metrics.classification_report(df, "y", "p", [0, 1, 2]).collect()}
    assert (out["2"].precision, out["2"].recall, out["2"].f1, out["2"].support) == (0, 0, 0, 0)
    assert out["accuracy"].f1 == pytest.approx(2 / 3)
    m = metrics.confusion_matrix(df, "y", "p", [0, 1, 2]).collect()
    assert [tuple(r) for r in m] == [(0, 1, 1, 0), (1, 0, 1, 0), (2, 0, 0, 0)]


def test_drop_report_conserves_rows(spark):
    df = spark.range(100).withColumn("reason", F.when(F.col("id") % 3 == 0, "invalid"))
    out = quality.drop_report(df, "reason").collect()
    assert sum(r.rows for r in out) == 100


def test_trailing_means_brute_force(spark):
    random.seed(2)
    rows = [("d", random.randrange(0, 2000), random.choice([None, random.random() * 1e6])) for _ in range(300)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, s long, v double, id int")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.m for r in ts_ops.trailing_means(df, "k", "ts", {"v": {"m": 60}}).collect()}
    for i, (_, s, _) in enumerate(rows):
        window = [v for _, t, v in rows if s - 60 <= t <= s and v is not None]
        assert got[i] == (pytest.approx(sum(window) / len(window)) if window else None)


def test_scaler_parameters_come_from_training_rows_only(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    test = spark.createDataFrame([(100.0,)], "x double")
    assert ml.standardise(test, ["x"], ml.fit_scaler(train, ["x"])).first().x == 99.0


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, t long, side string, a double, b double")
    assert pairing.pair_latest(df, "k", "t", "side", ["a"], ["b"]).count() == 0
    assert ts_ops.label_intervals(df, "k", "t", "side").count() == 0
