"""Time-series queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetair.checks.core import LABEL_CASE, label_commands
from fleetair.operators import timeseries as ts_ops
from fleetair.plans.timeline import plan_slices
from fleetair.sources import adapters as ad

ORDER = ["ts", "event_id"]


def by_device(spark, d):
    return ad.events(spark, d).select(
        F.col("user_id").alias("device_id"), "event_id", "ts", "value")


def w1(spark, d, slices=lambda e: None):
    """Three events are one capture."""
    e = ad.events(spark, d).select(
        F.col("user_id").alias("device_id"), "event_id",
        F.floor(F.col("event_id") / 3).cast("long").alias("read"),
        (F.col("event_id") % 3).alias("slot"), (F.col("event_id") * 7 % 256).cast("int").alias("idx"),
        (F.col("event_id") % 4 != 0).alias("fresh"))
    out = ts_ops.order_by_sequence(e, "device_id", "idx", "read", "slot", "fresh", slices(e))
    return out.withColumn("seq_pos", F.col("seq_pos").cast("long"))


SEQUENCE_SQL = """
WITH e AS (SELECT user_id AS device_id, event_id, event_id // 3 AS read, event_id % 3 AS slot,
                  CAST(event_id * 7 % 256 AS INTEGER) AS idx, event_id % 4 <> 0 AS fresh FROM events),
p AS (SELECT *, lag(idx) OVER (PARTITION BY device_id ORDER BY read, slot) AS prev FROM e WHERE fresh),
s AS (SELECT event_id, CAST(sum(coalesce((idx - prev + 384) % 256 - 128, idx)) OVER (
        PARTITION BY device_id ORDER BY read, slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq_index FROM p)
SELECT e.*, seq_index, row_number() OVER (
  PARTITION BY device_id, read ORDER BY seq_index NULLS LAST, slot) AS seq_pos
FROM e LEFT JOIN s USING (event_id)
"""


def w5(spark, d):
    e = ad.readings(spark, d).select(
        "device_id", "event_id", "ts", F.when(F.col("side") == "A", F.col("value")).alias("o3"),
        F.when(F.col("side") == "B", F.col("value")).alias("no2"))
    out = ts_ops.trailing_means(e, "device_id", "ts", {
        "o3": {"o3_1min": 60, "o3_1h": 3600, "o3_8h": 28800},
        "no2": {"no2_1min": 60, "no2_1h": 3600}})
    names = ["o3_1min", "o3_1h", "o3_8h", "no2_1min", "no2_1h"]
    return out.select("device_id", "event_id", *[F.round(n, 6).alias(n) for n in names])


def _trailing(side, seconds, name):
    return f"""round(avg(CASE WHEN side = '{side}' THEN value END) OVER (PARTITION BY device_id
      ORDER BY epoch_us(ts) RANGE BETWEEN {seconds}000000 PRECEDING AND CURRENT ROW), 6) AS {name}"""


TRAILING_SQL = f"""
SELECT device_id, event_id, {_trailing('A', 60, 'o3_1min')}, {_trailing('A', 3600, 'o3_1h')},
  {_trailing('A', 28800, 'o3_8h')}, {_trailing('B', 60, 'no2_1min')}, {_trailing('B', 3600, 'no2_1h')}
FROM ({ad.READINGS_SQL})
"""


def w6(spark, d):
    out = ts_ops.log_resistance_stats(by_device(spark, d), "device_id", ORDER, ["value"], 32)
    return out.select("event_id", F.round("value_log_mean", 6).alias("value_log_mean"),
                      F.round("value_log_var", 6).alias("value_log_var"))


# A zero has no logarithm and is left out of both.
LOG_STATS_SQL = """
SELECT event_id, round(avg(CASE WHEN value > 0 THEN ln(value) END) OVER w, 6) AS value_log_mean,
       round(var_pop(CASE WHEN value > 0 THEN ln(value) END) OVER w, 6) AS value_log_var
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)
"""


def w7(spark, d, slices=lambda e: None):
    e = ad.events(spark, d).select(
        F.col("user_id").alias("device_id"), "event_id", "ts",
        (F.col("event_id") * 97654321 % 4294967296).alias("ms"))
    return ts_ops.boot_segments(e, "device_id", ORDER, "ms", 1 << 30, slices(e)).drop("ts")


BOOT_SQL = """
WITH e AS (SELECT user_id AS device_id, event_id, ts, event_id * 97654321 % 4294967296 AS ms FROM events),
l AS (SELECT *, lag(ms) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS prev FROM e),
f AS (SELECT *, coalesce(ms < prev, FALSE) AS dropped,
        coalesce(ms < prev AND prev >= 3221225472 AND ms < 1073741824, FALSE) AS wrapped FROM l),
b AS (SELECT *, 1 + sum((dropped AND NOT wrapped)::INT) OVER (
        PARTITION BY device_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS boot FROM f)
SELECT device_id, event_id, ms, CAST(boot AS BIGINT) AS boot_id,
  CAST(ms + 4294967296 * sum(wrapped::INT) OVER (
    PARTITION BY device_id, boot ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS boot_ms
FROM b
"""


def w8(spark, d):
    """Bands from the nation table; gaps between them give NULL."""
    n = F.col("n_nationkey")
    bands = ad.table(spark, d, "nation").select(
        (n * 20).alias("lo"), (n * 20 + 18).alias("hi"),
        (n * 2).alias("index_lo"), (n * 2 + 1.5).alias("index_hi"))
    out = ts_ops.aqi_band(ad.events(spark, d).select("event_id", "value"), "value", bands)
    return out.select("event_id", F.round("aqi", 6).alias("aqi"))


AQI_SQL = """
SELECT event_id, round(n_nationkey * 2 + (value - n_nationkey * 20) / 18e0 * 1.5e0, 6) AS aqi
FROM events LEFT JOIN nation ON value >= n_nationkey * 20 AND value < n_nationkey * 20 + 18
"""


def w10(spark, d, slices=lambda c: None):
    c = label_commands(ad.commands(spark, d)).withColumn("label", F.col("label").cast("int"))
    return ts_ops.label_intervals(c, "device_id", ORDER, "label", slices=slices(c))


INTERVALS_SQL = f"""
WITH c AS (SELECT device_id, event_id, ts, CAST({LABEL_CASE} AS INTEGER) AS label FROM ({ad.COMMANDS_SQL})),
l AS (SELECT *, lag(label) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS prev FROM c),
i AS (SELECT *, CAST(sum((prev IS NULL OR prev <> label)::INT) OVER (
        PARTITION BY device_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS interval_no FROM l)
SELECT device_id, interval_no, any_value(label) AS label, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS rows
FROM i GROUP BY device_id, interval_no
"""


CADENCE_SQL = f"""
WITH RECURSIVE n AS (
  SELECT device_id, event_id, ts, value, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS i FROM ({ad.READINGS_SQL})),
walk AS (
  SELECT n.*, us + 18000000000 AS next_call, TRUE AS taken FROM n WHERE i = 1
  UNION ALL
  SELECT n.*, CASE WHEN n.us >= next_call THEN n.us + 18000000000 ELSE next_call END, n.us >= next_call
  FROM walk w JOIN n ON n.device_id = w.device_id AND n.i = w.i + 1)
SELECT device_id, event_id, ts, value FROM walk WHERE taken
"""


def violations(spark, d):
    return ts_ops.cadence_violations(by_device(spark, d), "device_id", "ts", 3600, 1800, ORDER)


VIOLATIONS_SQL = """
WITH l AS (SELECT user_id AS device_id, event_id, ts, value,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap_s FROM events)
SELECT * FROM l WHERE abs(gap_s - 3600) > 1800
"""

#: Rows of a device above which the sliced queries cut it.
CUT_ROWS = 30


def cut(df, pos="ts", tie=None):
    return plan_slices(df, "device_id", pos, CUT_ROWS, tie)


def w1_sliced(spark, d):
    return w1(spark, d, lambda e: cut(e, "read", "slot"))


def w7_sliced(spark, d):
    return w7(spark, d, cut)


def w10_sliced(spark, d):
    return w10(spark, d, cut)


def w3_exact(spark, d):
    r = ad.readings(spark, d).select("device_id", "event_id", "ts", "value")
    return ts_ops.cadence_exact(r, "device_id", "ts", 18000, ORDER, cut(r))


def w8_many(spark, d):
    """A band per customer, with gaps between them."""
    n = F.col("c_custkey")
    bands = ad.table(spark, d, "customer").select(
        (n / 8).alias("lo"), (n / 8 + 0.1).alias("hi"), n.alias("index_lo"), (n + 0.5).alias("index_hi"))
    out = ts_ops.aqi_band(ad.events(spark, d).select("event_id", "value"), "value", bands)
    return out.select("event_id", F.round("aqi", 6).alias("aqi"))


MANY_BANDS_SQL = """
SELECT event_id, round(c_custkey + (value - c_custkey / 8e0) / ((c_custkey / 8e0 + 0.1e0) - c_custkey / 8e0) * 0.5e0, 6) AS aqi
FROM events LEFT JOIN customer ON value >= c_custkey / 8e0 AND value < c_custkey / 8e0 + 0.1e0
"""

QUERIES = {
    "w1_order_by_sequence": w1,
    "w1_order_by_sequence_sliced": w1_sliced,
    "w3_cadence_exact_table": w3_exact,
    "w7_boot_segments_sliced": w7_sliced,
    "w8_aqi_many_bands": w8_many,
    "w10_label_intervals_sliced": w10_sliced,
    "w2_sample_counter": lambda s, d: ts_ops.sample_counter(by_device(s, d), "device_id", ORDER),
    "w3_cadence_sample": lambda s, d: ts_ops.cadence_sample(
        by_device(s, d), "device_id", "ts", 18000, ORDER),
    "w4_cadence_violations": violations,
    "w4_cadence_summary": lambda s, d: ts_ops.cadence_summary(violations(s, d), "device_id"),
    "w5_trailing_means": w5,
    "w6_log_resistance_stats": w6,
    "w7_boot_segments": w7,
    "w8_aqi_band": w8,
    "w10_label_intervals": w10,
}
SQL = {
    "w1_order_by_sequence": SEQUENCE_SQL,
    "w1_order_by_sequence_sliced": SEQUENCE_SQL,
    "w3_cadence_exact_table": CADENCE_SQL,
    "w7_boot_segments_sliced": BOOT_SQL,
    "w8_aqi_many_bands": MANY_BANDS_SQL,
    "w10_label_intervals_sliced": INTERVALS_SQL,
    "w2_sample_counter": """
SELECT user_id AS device_id, event_id, ts, value,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample_no FROM events""",
    "w3_cadence_sample": """
SELECT user_id AS device_id, event_id, ts, value, epoch_us(ts) // 18000000000 AS grid FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 18000000000 ORDER BY ts, event_id) = 1""",
    "w4_cadence_violations": VIOLATIONS_SQL,
    "w4_cadence_summary": f"""
SELECT device_id, count(*) AS violations, min(gap_s) AS min_gap_s, max(gap_s) AS max_gap_s
FROM ({VIOLATIONS_SQL}) GROUP BY device_id""",
    "w5_trailing_means": TRAILING_SQL,
    "w6_log_resistance_stats": LOG_STATS_SQL,
    "w7_boot_segments": BOOT_SQL,
    "w8_aqi_band": AQI_SQL,
    "w10_label_intervals": INTERVALS_SQL,
}
