"""Pairing, as-of and quality queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetair.functions.codes import (
    GAS_SENSOR_CODES,
    SIGNAL_CODES,
    class_name,
    error_event,
    map_commands,
    status_flags,
)
from fleetair.operators import asof, metrics, pairing, quality
from fleetair.operators import timeseries as ts_ops
from fleetair.plans.timeline import Slices, plan_slices
from fleetair.schema import UNLABELED
from fleetair.sources import adapters as ad


def label_commands(commands):
    return map_commands(commands).where("action = 'label'")


def paired(readings, slices: Slices | None = None):
    a = readings.withColumns({"value_a": F.col("value"), "value_b": F.col("value")})
    return pairing.pair_latest(
        a, "device_id", ["ts", "event_id"], "side", ["value_a"], ["value_b"], slices=slices
    )


def j1(spark, d):
    return paired(ad.readings(spark, d))


def j1_sliced(spark, d):
    """Every device above thirty rows is cut."""
    r = ad.readings(spark, d)
    return paired(r, plan_slices(r, "device_id", "ts", 30))


# Independent of the window form: walks each device row by row with both flags.
PAIRED_SQL = f"""
WITH RECURSIVE r AS ({ad.READINGS_SQL}),
n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS i FROM r),
walk AS (
  SELECT device_id, i, ts, event_id,
         CASE WHEN side = 'A' THEN value END AS va, CASE WHEN side = 'A' THEN ts END AS ta,
         CASE WHEN side = 'B' THEN value END AS vb, CASE WHEN side = 'B' THEN ts END AS tb,
         side = 'A' AS fa, side = 'B' AS fb, FALSE AS emit
  FROM n WHERE i = 1
  UNION ALL
  SELECT n.device_id, n.i, n.ts, n.event_id,
         CASE WHEN n.side = 'A' THEN n.value ELSE w.va END,
         CASE WHEN n.side = 'A' THEN n.ts ELSE w.ta END,
         CASE WHEN n.side = 'B' THEN n.value ELSE w.vb END,
         CASE WHEN n.side = 'B' THEN n.ts ELSE w.tb END,
         CASE WHEN n.side = 'A' THEN NOT w.fb ELSE w.fa AND NOT w.fa END,
         CASE WHEN n.side = 'B' THEN NOT w.fa ELSE w.fb AND NOT w.fb END,
         (n.side = 'A' AND w.fb) OR (n.side = 'B' AND w.fa)
  FROM walk w JOIN n ON n.device_id = w.device_id AND n.i = w.i + 1
)
SELECT device_id, greatest(ta, tb) AS ts, event_id, va AS value_a, vb AS value_b
FROM walk WHERE emit
"""


def j2(spark, d):
    e = ad.events(spark, d)
    out = asof.label_asof(
        ad.readings_of(e), label_commands(ad.commands_of(e)), "device_id", "ts", "event_id"
    )
    return out.withColumn("label", F.col("label").cast("int"))


LABEL_CASE = "CASE code WHEN 3 THEN -1 ELSE code END"
NAME_CASE = "CASE code WHEN 0 THEN 'LOW' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'HIGH' ELSE 'unlabeled' END"
LABELLED_SQL = f"""
WITH r AS ({ad.READINGS_SQL}),
c AS (SELECT device_id, ts, {LABEL_CASE} AS label, {NAME_CASE} AS event_name FROM ({ad.COMMANDS_SQL}))
SELECT r.device_id, r.event_id, r.ts, r.side, r.value,
       CAST(coalesce(c.label, 0) AS INTEGER) AS label,
       coalesce(c.event_name, 'unlabeled') AS event_name,
       CASE WHEN c.label IS NULL THEN 'default' ELSE 'command' END AS label_source
FROM r ASOF LEFT JOIN c ON r.device_id = c.device_id AND r.ts >= c.ts
"""


def flagship(spark, d):
    """Pair both sides, attach the label in force, count per device and label."""
    e = ad.events(spark, d)
    readings = ad.readings_of(e)
    # Measured once: pairs are a subset of the readings.
    slices = plan_slices(readings, "device_id", "ts")
    labels = asof.label_asof(
        paired(readings, slices), label_commands(ad.commands_of(e)), "device_id", "ts",
        "event_id", slices,
    )
    return labels.groupBy("device_id", F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("value_a"), 6).alias("mean_a"),
        F.round(F.avg("value_b"), 6).alias("mean_b"),
    )


FLAGSHIP_SQL = f"""
WITH p AS ({PAIRED_SQL}),
c AS (SELECT device_id, ts, {LABEL_CASE} AS label FROM ({ad.COMMANDS_SQL}))
SELECT p.device_id, CAST(coalesce(c.label, 0) AS INTEGER) AS label, count(*) AS rows,
       round(avg(value_a), 6) AS mean_a, round(avg(value_b), 6) AS mean_b
FROM p ASOF LEFT JOIN c ON p.device_id = c.device_id AND p.ts >= c.ts
GROUP BY ALL
"""


def j3(spark, d):
    """Clicks need ambient values; purchases supply them, cheap ones failed."""
    e = ad.readings_of(ad.events(spark, d))
    ok = F.col("value") >= 5
    ambient = e.where("side = 'B'").select(
        "device_id", "ts", F.when(ok, F.col("value")).alias("temperature"),
        F.when(ok, F.col("value") / 2).alias("humidity"),
    )
    return asof.ambient_asof(e.where("side = 'A'").drop("side"), ambient, "device_id", "ts")


AMBIENT_SQL = f"""
WITH r AS ({ad.READINGS_SQL}), b AS (SELECT * FROM r WHERE side = 'B' AND value >= 5)
SELECT a.device_id, a.event_id, a.ts, a.value,
       coalesce(b.value, -300) AS ambient_temperature,
       coalesce(b.value / 2, 50) AS ambient_humidity
FROM (SELECT * FROM r WHERE side = 'A') a
ASOF LEFT JOIN b ON a.device_id = b.device_id AND a.ts >= b.ts
"""


def w9(spark, d):
    r = ad.readings(spark, d).select(
        "device_id", "event_id", "ts", F.when(F.col("side") == "A", F.col("value")).alias("value_a"),
        F.when(F.col("side") == "B", F.col("value")).alias("value_b"),
    )
    return asof.hold_last(r, "device_id", ["ts", "event_id"], ["value_a", "value_b"])


HELD_SQL = f"""
SELECT device_id, event_id, ts,
  last_value(CASE WHEN side = 'A' THEN value END IGNORE NULLS) OVER w AS value_a,
  last_value(CASE WHEN side = 'B' THEN value END IGNORE NULLS) OVER w AS value_b
FROM ({ad.READINGS_SQL})
WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
"""


def calibration_of(suppliers):
    s = F.col("s_suppkey")
    return suppliers.select(
        s.alias("device_id"),
        (26000 + s % 50).cast("int").alias("par_t2"), (s % 7).cast("int").alias("par_t3"),
        (s % 3).cast("int").alias("par_t1"),
    )


def j4(spark, d):
    raw = ad.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("device_id"), "l_orderkey", F.col("l_partkey").alias("adc"))
    out = asof.with_calibration(raw, calibration_of(ad.table(spark, d, "supplier")), "device_id")
    return out.select("device_id", "l_orderkey", "adc", "calib.*")


CALIBRATION_SQL = """
SELECT s_suppkey AS device_id, CAST(26000 + s_suppkey % 50 AS INTEGER) AS par_t2,
       CAST(s_suppkey % 7 AS INTEGER) AS par_t3, CAST(s_suppkey % 3 AS INTEGER) AS par_t1
FROM supplier
"""
WITH_CALIBRATION_SQL = f"""
SELECT c.device_id, l_orderkey, l_partkey AS adc, par_t2, par_t3, par_t1
FROM lineitem JOIN ({CALIBRATION_SQL}) c ON l_suppkey = c.device_id
"""


def j4_uncalibrated(spark, d):
    raw = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("device_id"))
    calib = calibration_of(ad.table(spark, d, "supplier")).where("device_id % 4 <> 1")
    return asof.uncalibrated(raw, calib, "device_id")


def j5(spark, d):
    registry = ad.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("device_id"),
        F.when(F.col("s_nationkey") % 3 == 0, 0x6320).otherwise(F.col("s_nationkey")).alias("pid"),
    )
    raw = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("device_id"), "l_quantity")
    marked = asof.registry_flag(raw, registry, "device_id")
    return marked.groupBy("device_id", "accepted").agg(F.count(F.lit(1)).alias("rows"))


REGISTRY_SQL = """
SELECT l_suppkey AS device_id,
       EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey % 3 = 0) AS accepted,
       count(*) AS rows
FROM lineitem GROUP BY ALL
"""


def j6(spark, d):
    pred = ad.table(spark, d, "documents").select(
        "doc_id", (F.col("n_chars") % 2).cast("int").alias("predicted"))
    truth = ad.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return asof.score_vs_label(pred, truth, "doc_id")


SCORE_VS_LABEL_SQL = """
SELECT doc_id, CAST(n_chars % 2 AS INTEGER) AS predicted, quality AS label
FROM documents JOIN labels USING (doc_id)
"""


# --- quality -----------------------------------------------------------------

def coded(spark, d):
    code = F.get(F.lit([0, 1, -102]), (F.col("event_id") % 3).cast("int"))
    return ad.events(spark, d).select(
        F.col("user_id").alias("device_id"), "event_id", "ts", "value",
        (F.col("event_id") % 256).cast("int").alias("status"), code.alias("code"),
    )


CODED_SQL = """
SELECT user_id AS device_id, event_id, ts, value, CAST(event_id % 256 AS INTEGER) AS status,
       CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -102 END AS code
FROM events
"""


def f2(spark, d):
    e = ad.events(spark, d).select(
        "event_id",
        F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0).alias("temperature"),
        F.when(F.col("event_type") == "view", F.col("value")).otherwise(0.0).alias("humidity"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("pressure"),
        F.when(F.col("event_id") % 5 == 0, "B").alias("source"),
    )
    return quality.classify_source(e, "source").select("event_id", "side")


CLASSIFY_SQL = """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'B'
  WHEN event_type IN ('click', 'view', 'error') AND value <> 0 THEN 'A' ELSE 'B' END AS side
FROM events
"""


def f5(spark, d):
    kept, counts = quality.valid_results(coded(spark, d), "code")
    per_code = counts.select(F.col("code").alias("code"), "rows", F.lit("count").alias("part"))
    kept_rows = kept.groupBy("code").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "part", F.lit("kept"))
    return per_code.unionByName(kept_rows)


VALID_SQL = f"""
SELECT code, count(*) AS rows, 'count' AS part FROM ({CODED_SQL}) GROUP BY code
UNION ALL
SELECT code, count(*), 'kept' FROM ({CODED_SQL}) WHERE code = 0 GROUP BY code
"""


def f6(spark, d):
    c = coded(spark, d).withColumn("boot_id", F.col("event_id") % 2)
    return quality.drop_warmup(c, 10, ["device_id", "boot_id"], ["ts", "event_id"]).select(
        "device_id", "boot_id", "event_id")


WARMUP_SQL = """
SELECT device_id, boot_id, event_id FROM (
  SELECT user_id AS device_id, event_id % 2 AS boot_id, event_id,
         row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS n
  FROM events) WHERE n > 10
"""


def f7(spark, d):
    c = coded(spark, d).withColumns({
        "signal": (F.col("event_id") % 147 - 41).cast("int"),
        "gas": (-(F.col("event_id") % 12)).cast("int"),
    }).select("event_id", "signal", "gas")
    return quality.decode_codes(quality.decode_codes(c, "signal", SIGNAL_CODES), "gas", GAS_SENSOR_CODES)


def _values(codes):
    return ", ".join(f"({c}, '{n}')" for c, n in sorted(codes.items()))


CODES_SQL = f"""
WITH e AS (SELECT event_id, CAST(event_id % 147 - 41 AS INTEGER) AS signal,
                  CAST(-(event_id % 12) AS INTEGER) AS gas FROM events),
s(code, name) AS (VALUES {_values(SIGNAL_CODES)}), g(code, name) AS (VALUES {_values(GAS_SENSOR_CODES)})
SELECT event_id, signal, gas, s.name AS signal_name,
       CASE sign(signal) WHEN -1 THEN 'error' WHEN 0 THEN 'ok' ELSE 'warning' END AS signal_severity,
       g.name AS gas_name,
       CASE sign(gas) WHEN -1 THEN 'error' WHEN 0 THEN 'ok' ELSE 'warning' END AS gas_severity
FROM e LEFT JOIN s ON s.code = signal LEFT JOIN g ON g.code = gas
"""


def f12(spark, d):
    """Arrival order is event_id; clocks read whole 10-minute steps."""
    e = ad.events(spark, d).select(
        F.col("user_id").alias("device_id"), "event_id",
        F.when(F.col("event_id") % 11 == 0, 0).otherwise(
            F.floor(F.col("event_id") / 400)).cast("long").alias("step"),
    )
    return quality.timestamp_check(e, "device_id", "step", order="event_id")


TS_CHECK_SQL = """
WITH e AS (SELECT user_id AS device_id, event_id,
                  CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id // 400 END AS step FROM events),
l AS (SELECT *, lag(step) OVER (PARTITION BY device_id ORDER BY event_id) AS prev FROM e)
SELECT device_id, event_id, step, CASE WHEN step = prev THEN 'repeat'
  WHEN step < prev THEN 'backwards' ELSE 'ok' END AS ts_check
FROM l
"""


def f12_sensors(spark, d):
    """An order is a step and a line number a sensor, which repeats in it."""
    rows = ad.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("device_id"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("sensor_id"),
        F.xxhash64("l_partkey", "l_suppkey", "l_quantity").alias("arrival"))
    marked = quality.duplicate_sensors(rows, "device_id", "step", "sensor_id", "arrival")
    return marked.groupBy("device_id", "step", "sensor_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("duplicate_sensor"), 1)).alias("errors"))


SENSORS_SQL = """
SELECT l_orderkey % 50 AS device_id, l_orderkey AS step, l_linenumber AS sensor_id, count(*) AS rows, count(*) - 1 AS errors
FROM lineitem GROUP BY ALL
"""


def f12_drop(spark, d):
    e = ad.events(spark, d).select(
        F.col("user_id").alias("device_id"), "event_id",
        F.floor(F.col("event_id") / 400).cast("long").alias("step"), "value")
    return quality.timestamp_check(e, "device_id", "step", "drop", "event_id")


TS_DROP_SQL = """
SELECT user_id AS device_id, event_id, event_id // 400 AS step, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_id // 400 ORDER BY event_id) = 1
"""


def a8(spark, d):
    """Each order's first six items are one self-test run."""
    q = F.col("l_quantity")
    rows = ad.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("device_id"), F.col("l_orderkey").alias("run"),
        F.col("l_linenumber").alias("n"), "l_extendedprice", "l_quantity", "l_partkey",
    ).groupBy("run", "n").agg(
        F.max("l_extendedprice").alias("gas_resistance"), F.max("l_quantity").alias("q"),
        F.max("l_partkey").alias("k"),
    ).select(
        "run", (F.col("n") - 1).alias("seq"), (F.col("q") * 1.5).alias("temperature"),
        (85000.0 + F.col("k")).alias("pressure"), (F.col("q") * 2).alias("humidity"),
        F.when(F.col("k") % 8 == 0, 0x10).otherwise(0xA0).alias("status"), "gas_resistance",
    )
    return quality.self_test(rows, "run")


SELF_TEST_SQL = """
WITH i AS (SELECT l_orderkey AS run, l_linenumber - 1 AS seq, max(l_extendedprice) AS g,
                  max(l_quantity) AS q, max(l_partkey) AS k
           FROM lineitem GROUP BY ALL),
r AS (SELECT run, count(*) AS rows,
   coalesce(max(CASE WHEN seq = 0 THEN (q * 1.5 NOT BETWEEN 0 AND 60)::INT
     + (85000 + k NOT BETWEEN 90000 AND 110000)::INT + (q * 2 NOT BETWEEN 20 AND 80)::INT END), 3) AS o,
   sum((k % 8 = 0)::INT) AS bad,
   max(CASE seq WHEN 3 THEN g END) AS g3, max(CASE seq WHEN 4 THEN g END) AS g4,
   max(CASE seq WHEN 5 THEN g END) AS g5
  FROM i WHERE seq < 6 GROUP BY run),
f AS (SELECT run, rows, o + bad AS partial,
  CASE WHEN rows = 6 THEN CAST(floor(5e0 * (g3 + g5) / (2 * g4)) AS BIGINT) ELSE 0 END AS ratio FROM r)
SELECT run, rows, ratio, CAST(partial + (ratio < 6)::INT AS BIGINT) AS failures,
       partial + (ratio < 6)::INT = 0 AS passed
FROM f
"""


def a9(spark, d):
    c = coded(spark, d)
    counted = ts_ops.sample_counter(c, "device_id", ["ts", "event_id"])
    reason = (
        F.when(F.col("code") == -102, "damaged").when(F.col("code") == 1, "stabilising")
        .when(F.col("sample_no") <= 10, "warm-up")
    )
    return quality.drop_report(counted.withColumn("reason", reason), "reason")


DROP_REPORT_SQL = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS i FROM ({CODED_SQL}))
SELECT CASE WHEN code = -102 THEN 'damaged' WHEN code = 1 THEN 'stabilising'
       WHEN i <= 10 THEN 'warm-up' ELSE 'kept' END AS reason, count(*) AS rows
FROM n GROUP BY ALL
"""

QUERIES = {
    "flagship_labelled_pairs": flagship,
    "j1_pair_latest": j1,
    "j1_pair_latest_sliced": j1_sliced,
    "j2_label_asof": j2,
    "j3_ambient_asof": j3,
    "j4_with_calibration": j4,
    "j4_uncalibrated": j4_uncalibrated,
    "f12_duplicate_sensors": f12_sensors,
    "j5_registry_check": j5,
    "j6_score_vs_label": j6,
    "w9_hold_last": w9,
    "f2_classify_source": f2,
    "f3_status_flags": lambda s, d: status_flags(coded(s, d)).select(
        "event_id", "status", "new_data", "gas_valid", "heater_stable"),
    "f4_gas_valid": lambda s, d: quality.gas_valid(coded(s, d)).select("event_id", "status", "value"),
    "f5_valid_results": f5,
    "f6_drop_warmup": f6,
    "f7_decode_codes": f7,
    "f8_error_event": lambda s, d: coded(s, d).select(
        "event_id", error_event(F.col("status")).alias("event")),
    "f9_accuracy_filter": lambda s, d: quality.accuracy_filter(
        coded(s, d).select("event_id", (F.col("event_id") % 4).cast("int").alias("iaq_accuracy")), 2),
    "f10_map_commands": lambda s, d: map_commands(
        ad.events(s, d).select("event_id", F.get(
            F.lit(["0", "1", "2", "x", "X", "d", "C", "s", "\n", "\r", "q"]),
            (F.col("event_id") % 11).cast("int")).alias("cmd"))
    ).select("event_id", "action", F.col("label").cast("int").alias("label"), "event_name"),
    "f11_class_name": lambda s, d: ad.table(s, d, "embeddings").select(
        "vec_id", class_name(F.col("label") - 1).alias("name")),
    "f12_timestamp_check": f12,
    "f12_timestamp_check_drop": f12_drop,
    "a8_self_test": a8,
    "a9_drop_report": a9,
    "a1_label_distribution": lambda s, d: metrics.label_distribution(j2(s, d)),
}

SQL = {
    "flagship_labelled_pairs": FLAGSHIP_SQL,
    "j1_pair_latest": PAIRED_SQL,
    "j1_pair_latest_sliced": PAIRED_SQL,
    "j2_label_asof": LABELLED_SQL,
    "j3_ambient_asof": AMBIENT_SQL,
    "j4_with_calibration": WITH_CALIBRATION_SQL,
    "j4_uncalibrated": """
SELECT l_suppkey AS device_id, count(*) AS rows FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 1) GROUP BY ALL""",
    "f12_duplicate_sensors": SENSORS_SQL,
    "j5_registry_check": REGISTRY_SQL,
    "j6_score_vs_label": SCORE_VS_LABEL_SQL,
    "w9_hold_last": HELD_SQL,
    "f2_classify_source": CLASSIFY_SQL,
    "f3_status_flags": f"""
SELECT event_id, status, status & 128 <> 0 AS new_data, status & 32 <> 0 AS gas_valid,
       status & 16 <> 0 AS heater_stable FROM ({CODED_SQL})""",
    "f4_gas_valid": f"SELECT event_id, status, value FROM ({CODED_SQL}) WHERE status & 32 <> 0",
    "f5_valid_results": VALID_SQL,
    "f6_drop_warmup": WARMUP_SQL,
    "f7_decode_codes": CODES_SQL,
    "f8_error_event": f"""
SELECT event_id, CASE WHEN status >= 128 THEN 'POR_EVENT' WHEN status >= 64 THEN 'ACCESS_CONFLICT'
       ELSE 'OK' END AS event FROM ({CODED_SQL})""",
    "f9_accuracy_filter": """
SELECT event_id, CAST(event_id % 4 AS INTEGER) AS iaq_accuracy,
       CASE event_id % 4 WHEN 2 THEN 'MEDIUM_ACCURACY' ELSE 'HIGH_ACCURACY' END AS accuracy_name
FROM events WHERE event_id % 4 >= 2""",
    "f10_map_commands": """
SELECT event_id,
  CASE WHEN event_id % 11 <= 4 THEN 'label' WHEN event_id % 11 = 5 THEN 'dump'
       WHEN event_id % 11 = 6 THEN 'clear' WHEN event_id % 11 = 7 THEN 'status'
       WHEN event_id % 11 <= 9 THEN 'ignored' ELSE 'unknown' END AS action,
  CAST(CASE WHEN event_id % 11 <= 2 THEN event_id % 11 WHEN event_id % 11 <= 4 THEN -1 END AS INTEGER) AS label,
  CASE event_id % 11 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'HIGH'
       WHEN 3 THEN 'unlabeled' WHEN 4 THEN 'unlabeled' END AS event_name
FROM events""",
    "f11_class_name": """
SELECT vec_id, CASE label WHEN 1 THEN 'LOW' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'HIGH'
       ELSE 'UNKNOWN' END AS name FROM embeddings""",
    "f12_timestamp_check": TS_CHECK_SQL,
    "f12_timestamp_check_drop": TS_DROP_SQL,
    "a8_self_test": SELF_TEST_SQL,
    "a9_drop_report": DROP_REPORT_SQL,
    "a1_label_distribution": f"""
SELECT label, count(*) AS rows FROM ({LABELLED_SQL}) GROUP BY label""",
}
