"""Decoding and reshaping queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetair.functions import decode
from fleetair.operators import decoding, reshape
from fleetair.schema import ACCURACY_COLUMNS, OUTPUT_IDS, SCAN_OUTPUT_IDS
from fleetair.sources import adapters as ad

ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def items(spark, d, *more):
    return ad.table(spark, d, "lineitem").select(*ID, "l_quantity", *more)


def _hex(c, n_bytes):
    return F.lpad(F.hex(c.cast("long")), 2 * n_bytes, "0")


def captured(spark, d):
    """Line items packed into 17-byte frames."""
    c = F.col
    adc_g = c("l_partkey") % 1024
    last = (
        (adc_g % 4) * 64 + (c("l_linenumber") % 2) * 32
        + F.when(c("l_linenumber") % 3 == 0, 16).otherwise(0)
        + c("l_quantity").cast("long") % 16
    )
    frame = F.concat(
        _hex((c("l_partkey") % 2) * 128 + c("l_linenumber"), 1),
        _hex(c("l_orderkey") % 256, 1),
        _hex(c("l_partkey") * 7919 % 16777216, 3),
        _hex(c("l_orderkey") * 104729 % 16777216, 3),
        _hex(c("l_suppkey") * 57 % 65536, 2),
        F.lit("0000000000"),
        _hex(F.floor(adc_g / 4), 1), _hex(last, 1),
    )
    return items(spark, d).withColumn("frame", F.unhex(frame)).drop("l_quantity")


FRAMES_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST((l_partkey % 2) * 128 + (l_linenumber % 2) * 32
       + CASE WHEN l_linenumber % 3 = 0 THEN 16 ELSE 0 END AS INTEGER) AS status,
  CAST(l_linenumber % 16 AS INTEGER) AS gas_index, CAST(l_orderkey % 256 AS INTEGER) AS meas_index,
  CAST(l_partkey * 7919 % 16777216 AS INTEGER) AS adc_p,
  CAST(l_orderkey * 104729 % 16777216 AS INTEGER) AS adc_t,
  CAST(l_suppkey * 57 % 65536 AS INTEGER) AS adc_h, CAST(l_partkey % 1024 AS INTEGER) AS adc_g,
  CAST(CAST(l_quantity AS BIGINT) % 16 AS INTEGER) AS gas_range
FROM lineitem
"""


def coefficient_bytes(spark, d):
    s = F.col("s_suppkey")
    data = F.concat(*[_hex((s * (i + 3) + i * 17) % 256, 1) for i in range(42)])
    return ad.table(spark, d, "supplier").select(
        s.alias("device_id"), F.unhex(data).alias("coeff"))


def d2(spark, d):
    return decode.decode_calibration(coefficient_bytes(spark, d)).drop("coeff")


def _b(i):
    return f"((s_suppkey * {i + 3} + {i * 17}) % 256)"


def _u16(lo):
    return f"({_b(lo + 1)} * 256 + {_b(lo)})"


def _sgn(e, bits):
    return f"(CASE WHEN {e} >= {1 << (bits - 1)} THEN {e} - {1 << bits} ELSE {e} END)"


COEFFICIENTS_BY_NAME = {
    "par_t1": _u16(31), "par_t2": _u16(0), "par_t3": _sgn(_b(2), 8),
    "par_p1": _sgn(_u16(10), 16), "par_p2": _u16(12), "par_p3": _sgn(_b(14), 8),
    "par_p4": _sgn(_b(15), 8), "par_p5": _sgn(_u16(4), 16), "par_p6": _sgn(_u16(6), 16),
    "par_p7": _sgn(_b(8), 8), "par_p8": _sgn(_b(9), 8), "par_p9": _sgn(_u16(18), 16),
    "par_p10": _sgn(_b(20), 8), "par_p11": _sgn(_b(21), 8),
    "par_h1": f"({_b(25)} * 16 + {_b(24)} % 16)", "par_h2": _sgn(_b(26), 8), "par_h3": _b(28),
    "par_h4": _sgn(_b(27), 8), "par_h5": f"({_b(23)} * 16 + {_b(24)} // 16)", "par_h6": _b(29),
    "par_g1": _sgn(_b(35), 8), "par_g2": _sgn(_u16(33), 16), "par_g3": _sgn(_b(36), 8),
    "res_heat_val": _sgn(_b(37), 8), "res_heat_range": f"({_b(39)} // 16 % 4)",
    "range_sw_err": _sgn(f"({_b(41)} // 16)", 4),
}
COEFFICIENTS_SQL = "SELECT s_suppkey AS device_id, " + ", ".join(
    f"CAST({e} AS INTEGER) AS {n}" for n, e in COEFFICIENTS_BY_NAME.items()) + " FROM supplier"


def calibration(spark, d):
    """Plausible coefficients from the supplier key."""
    s = F.col("s_suppkey")
    values = {
        "par_t1": 19000 + s % 50, "par_t2": 26000 + s % 100, "par_t3": s % 7 - 3,
        "par_p1": 100 + s % 9, "par_p2": 20 + s % 5, "par_p3": s % 11 - 5, "par_p4": s % 5 - 2,
        "par_p5": 18000 + s % 60, "par_p6": 16000 + s % 70, "par_p7": s % 9 - 4, "par_p8": s % 3 - 1,
        "par_p9": 300 + s % 20, "par_p10": s % 13 - 6, "par_p11": s % 4 - 2,
        "par_h1": 300 + s % 30, "par_h2": s % 21 - 10, "par_h3": s % 6, "par_h4": s % 15 - 7,
        "par_h5": 200 + s % 40, "par_h6": 30 + s % 10,
    }
    return ad.table(spark, d, "supplier").select(
        s.alias("l_suppkey"), *[v.cast("int").alias(n) for n, v in values.items()])


CALIBRATION_SQL = """
SELECT s_suppkey, 19000 + s % 50 AS t1, 26000 + s % 100 AS t2, s % 7 - 3 AS t3,
  100 + s % 9 AS p1, 20 + s % 5 AS p2, s % 11 - 5 AS p3, s % 5 - 2 AS p4, 18000 + s % 60 AS p5,
  16000 + s % 70 AS p6, s % 9 - 4 AS p7, s % 3 - 1 AS p8, 300 + s % 20 AS p9, s % 13 - 6 AS p10,
  s % 4 - 2 AS p11, 300 + s % 30 AS h1, s % 21 - 10 AS h2, s % 6 AS h3, s % 15 - 7 AS h4,
  200 + s % 40 AS h5, 30 + s % 10 AS h6
FROM (SELECT s_suppkey, s_suppkey AS s FROM supplier)
"""
# Each value as its own formula, with powers written out.
PHYSICAL_SQL = f"""
WITH raw AS (
  SELECT {", ".join(ID)}, 4900000 + l_partkey * 37 % 900000 AS adc_t,
         300000 + l_orderkey * 13 % 90000 AS adc_p, 20000 + l_partkey % 9000 AS adc_h,
         CAST(l_partkey % 1024 AS DOUBLE) AS adc_g, l_linenumber AS gas_range FROM lineitem),
t AS (SELECT *, (adc_t - 256 * t1) * t2 / pow(2e0, 30) + pow(adc_t - 256e0 * t1, 2) * t3 / pow(2e0, 48) AS temp
      FROM raw JOIN ({CALIBRATION_SQL}) ON l_suppkey = s_suppkey),
h AS (SELECT *, (adc_h - (64 * h1 + h2 / pow(2e0, 14) * (5120 * temp - 76800))) * h5 / pow(2e0, 16)
   * (1 + h4 / pow(2e0, 26) * (5120 * temp - 76800) + h4 * h3 / pow(2e0, 52) * pow(5120 * temp - 76800, 2)) AS s FROM t)
SELECT {", ".join(ID)}, temp AS temperature,
  (8 * p1 + p2 / 64e0 * temp + p3 / 256e0 * temp * temp + p4 / 32768e0 * pow(temp, 3))
  + adc_p * ((p5 - 16384) / pow(2e0, 20) + (p6 - 16384) / pow(2e0, 29) * temp
             + p7 / pow(2e0, 32) * temp * temp + p8 / pow(2e0, 37) * pow(temp, 3))
  + pow(adc_p, 2e0) * (p9 + p10 * temp) / pow(2e0, 48) + pow(adc_p, 3e0) * p11 / pow(2e0, 65) AS pressure,
  s * (1 - h6 / pow(2e0, 19) * s) AS humidity,
  1e6 * (262144 >> gas_range) / (4096 + 3 * (adc_g - 512)) AS gas_resistance
FROM h
"""


def physical(spark, d):
    raw = items(spark, d).select(
        *ID, (4900000 + F.col("l_partkey") * 37 % 900000).alias("adc_t"),
        (300000 + F.col("l_orderkey") * 13 % 90000).alias("adc_p"),
        (20000 + F.col("l_partkey") % 9000).alias("adc_h"),
        (F.col("l_partkey") % 1024).alias("adc_g"), F.col("l_linenumber").alias("gas_range"),
    )
    return decoding.compensate(raw, calibration(spark, d), "l_suppkey")


def one_value(name, digits):
    def query(spark, d):
        return physical(spark, d).select(*ID, F.round(name, digits).alias(name))
    return query


def one_value_sql(name, digits):
    return f"SELECT {', '.join(ID)}, round({name}, {digits}) AS {name} FROM ({PHYSICAL_SQL})"


def d7(spark, d):
    e = ad.table(spark, d, "embeddings")
    adcs = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int"))
    rmox = decode.rmox_array(adcs, F.col("vec_id") % 20 + 1, F.lit(50), F.lit(300))
    return e.select("vec_id", F.posexplode(rmox).alias("pos", "rmox")).withColumn(
        "rmox", F.round("rmox", 3))


RMOX_SQL = """
WITH x AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings),
a AS (SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS INTEGER) AS adc FROM x)
SELECT vec_id, pos, round(CASE WHEN adc <= 50 THEN 1e2 WHEN adc >= 300 THEN 1e12
  ELSE greatest(1e2, least(1e12, (vec_id % 20 + 1) * 1e3 * (adc - 50) / (300 - adc))) END, 3) AS rmox
FROM a
"""


def ambient_frames(spark, d, n_bytes):
    v = F.col("event_id") * 2654435761 % 4294967296
    hexed = _hex(v, 4)
    if n_bytes == 5:
        hexed = F.concat(hexed, _hex(F.col("event_id") % 256, 1))
    return ad.events(spark, d).select("event_id", F.unhex(hexed).alias("frame"))


def d8(spark, d):
    return decode.ambient_hs3(ambient_frames(spark, d, 4)).select(
        "event_id", F.round("humidity", 6).alias("humidity"),
        F.round("temperature", 6).alias("temperature"))


def d9(spark, d):
    return decode.ambient_hs4(ambient_frames(spark, d, 5)).select(
        "event_id", F.round("humidity", 6).alias("humidity"),
        F.round("temperature", 6).alias("temperature"))


HS3_SQL = """
WITH v AS (SELECT event_id, event_id * 2654435761 % 4294967296 AS v FROM events)
SELECT event_id, round(100e0 * ((v >> 16) & 16383) / 16383, 6) AS humidity,
       round(165e0 * ((v & 65535) >> 2) / 16383 - 40, 6) AS temperature
FROM v WHERE v & 1 = 0
"""
# The checksum one bit at a time.
HS4_SQL = """
WITH v AS (SELECT event_id, event_id * 2654435761 % 4294967296 AS v FROM events),
c AS (SELECT *, list_reduce([255::BIGINT] || range(32), lambda acc, k:
       xor((acc << 1) & 255, CASE WHEN xor(acc >> 7, (v >> (31 - k)) & 1) = 1 THEN 29 ELSE 0 END)) AS crc FROM v)
SELECT event_id, round(100e0 * ((v >> 16) & 16383) / 16383, 6) AS humidity,
       round(165e0 * (v & 16383) / 16383 - 40, 6) AS temperature
FROM c WHERE crc = event_id % 256
"""


def d10(spark, d):
    e = ad.events(spark, d).select(
        "event_id", (F.col("event_id") * 123456789).alias("t_ns"), (F.col("event_id") % 977).alias("t_s"),
        "value", (F.col("value") * 100).alias("centi"), (F.col("value") * 1000).alias("milli"))
    out = decode.scale_units(e, {
        "t_ns": decode.NS_TO_S, "t_s": decode.S_TO_MS, "value": decode.OHM_TO_KOHM,
        "centi": decode.CENTI_DEGREE, "milli": decode.MILLI_PERCENT})
    return out.withColumns({c: F.round(c, 6) for c in ("value", "centi", "milli")})


UNITS_SQL = """
SELECT event_id, event_id * 123456789 // 1000000000 AS t_ns, event_id % 977 * 1000 AS t_s,
  round(value / 1000, 6) AS value, round(value * 100 / 100, 6) AS centi,
  round(value * 1000 / 1000, 6) AS milli
FROM events
"""


def r1(spark, d):
    k = F.col("event_id") % 3
    wide = ad.events(spark, d).select(
        "event_id", F.col("value").alias("temperature"), (F.col("value") / 2).alias("humidity"),
        (F.col("value") * 1000).alias("pressure"), (F.col("value") + 5).alias("gas_resistance"),
        (F.col("event_id") % 10).alias("gas_index"), F.lit(0.5).alias("heat_source"),
        (F.col("event_id") % 256).cast("int").alias("status"),
        F.when(k == 0, 15).when(k == 1, 15 + 2**13 + 2**23).otherwise(2**23 + 4).alias("mask"),
    )
    return reshape.to_long(wide, "mask", F.col("event_id") % 2 == 0).select(
        "event_id", "sensor_id", F.round("signal", 6).alias("signal"))


LONG_SQL = """
WITH e AS (SELECT event_id, value, event_id % 256 AS status, event_id % 3 AS k FROM events),
l AS (
  SELECT event_id, 3 AS sensor_id, value AS signal FROM e
  UNION ALL SELECT event_id, 2, value / 2 FROM e WHERE k < 2
  UNION ALL SELECT event_id, 1, value * 1000 FROM e WHERE k < 2
  UNION ALL SELECT event_id, 4, value + 5 FROM e WHERE k < 2 AND status & 32 <> 0
  UNION ALL SELECT event_id, 14, 0.5 FROM e WHERE k = 1
  UNION ALL SELECT event_id, 24, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 10 END
            FROM e WHERE k > 0 AND status & 32 <> 0)
SELECT event_id, sensor_id, round(CAST(signal AS DOUBLE), 6) AS signal FROM l
"""


def r2(spark, d):
    """A step is an order; of repeated outputs the dearest wins."""
    long = ad.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("sensor_id"),
        F.col("l_extendedprice").alias("signal"),
        (F.col("l_extendedprice") * 100).cast("long").alias("time_ns"),
        (F.floor("l_extendedprice") % 4).cast("int").alias("accuracy"),
    )
    return reshape.to_wide(long, "step", OUTPUT_IDS, order="time_ns")


def _wide_sql():
    present = ", ".join(
        f"max(CASE WHEN sensor_id = {i} THEN signal END) AS {n}" for i, n in OUTPUT_IDS.items())
    return f"""
WITH l AS (SELECT l_orderkey AS step, l_linenumber AS sensor_id, l_extendedprice AS signal FROM lineitem)
SELECT step, max(CASE WHEN sensor_id <> 5 THEN CAST(trunc(signal * 100) AS BIGINT) END) AS time_ns, {present},
  CAST(floor(max(CASE WHEN sensor_id = 1 THEN signal END)) % 4 AS INTEGER) AS iaq_accuracy
FROM l WHERE sensor_id <> 5 GROUP BY step
"""


#: Ids of every output of either kind, and one that is none.
ALL_IDS = [*dict.fromkeys([*OUTPUT_IDS, *SCAN_OUTPUT_IDS]), 5]


def wide_of_all(ids):
    """An order's lines as outputs of all ids; of repeated ones the dearest wins."""
    def query(spark, d):
        number = (F.col("l_linenumber") + F.col("l_partkey")) % len(ALL_IDS)
        long = ad.table(spark, d, "lineitem").select(
            F.floor(F.col("l_orderkey") / 8).cast("long").alias("step"), F.get(F.lit(ALL_IDS), number.cast("int")).alias("sensor_id"),
            F.col("l_extendedprice").alias("signal"), (F.col("l_extendedprice") * 100).cast("long").alias("time_ns"),
            (F.floor("l_extendedprice") % 4).cast("int").alias("accuracy"))
        return reshape.to_wide(long, "step", ids, order="time_ns")
    return query


def wide_of_all_sql(ids):
    columns = []
    for name in dict.fromkeys(ids.values()):
        of = ", ".join(str(i) for i, n in ids.items() if n == name)
        signal = f"max(signal) FILTER (sensor_id IN ({of}))"
        columns.append(f"{signal} AS {name}")
        if name in ACCURACY_COLUMNS:
            columns.append(f"CAST(floor({signal}) % 4 AS INTEGER) AS {ACCURACY_COLUMNS[name]}")
    return f"""
WITH l AS (SELECT l_orderkey // 8 AS step, list_extract({ALL_IDS}, CAST((l_linenumber + l_partkey) % {len(ALL_IDS)} AS INT) + 1) AS sensor_id,
             l_extendedprice AS signal FROM lineitem)
SELECT step, max(CAST(trunc(signal * 100) AS BIGINT)) AS time_ns, {', '.join(columns)}
FROM l WHERE sensor_id IN ({', '.join(map(str, ids))}) GROUP BY step
"""


def split(spark, d):
    """Three frames of seventeen bytes in one capture, spelled as numbers."""
    frames = [F.unhex(F.lpad(F.hex(F.col("l_orderkey") * 1000 + F.col("l_partkey") * 3 + i), 34, "0")) for i in range(3)]
    captures = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(*frames).alias("frame"))
    return decode.split_frames(captures).withColumn("frame", F.hex("frame"))


SPLIT_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(slot AS INTEGER) AS slot,
       lpad(hex(l_orderkey * 1000 + l_partkey * 3 + slot), 34, '0') AS frame
FROM lineitem, range(3) AS s(slot)
"""

QUERIES = {
    "d1_split_frames": split,
    "r2_to_wide_all_outputs": wide_of_all(OUTPUT_IDS),
    "r2_to_wide_scan": wide_of_all(SCAN_OUTPUT_IDS),
    "d1_decode_frame": lambda s, d: decode.decode_frame(captured(s, d)).drop("frame"),
    "d2_decode_calibration": d2,
    "d3_comp_temperature": one_value("temperature", 6),
    "d4_comp_pressure": one_value("pressure", 3),
    "d5_comp_humidity": one_value("humidity", 5),
    "d6_gas_resistance": one_value("gas_resistance", 3),
    "d7_rmox_array": d7,
    "d8_ambient_hs3": d8,
    "d9_ambient_hs4": d9,
    "d10_scale_units": d10,
    "r1_to_long": r1,
    "r2_to_wide": r2,
}
SQL = {
    "d1_decode_frame": FRAMES_SQL,
    "d1_split_frames": SPLIT_SQL,
    "r2_to_wide_all_outputs": wide_of_all_sql(OUTPUT_IDS),
    "r2_to_wide_scan": wide_of_all_sql(SCAN_OUTPUT_IDS),
    "d2_decode_calibration": COEFFICIENTS_SQL,
    "d3_comp_temperature": one_value_sql("temperature", 6),
    "d4_comp_pressure": one_value_sql("pressure", 3),
    "d5_comp_humidity": one_value_sql("humidity", 5),
    "d6_gas_resistance": one_value_sql("gas_resistance", 3),
    "d7_rmox_array": RMOX_SQL,
    "d8_ambient_hs3": HS3_SQL,
    "d9_ambient_hs4": HS4_SQL,
    "d10_scale_units": UNITS_SQL,
    "r1_to_long": LONG_SQL,
    "r2_to_wide": _wide_sql(),
}
