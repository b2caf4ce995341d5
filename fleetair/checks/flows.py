"""Source, sink and stream queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetair.checks import models
from fleetair.checks.core import LABEL_CASE, LABELLED_SQL, NAME_CASE, PAIRED_SQL, calibration_of, label_commands
from fleetair.checks.series import CADENCE_SQL
from fleetair.operators import ml
from fleetair.plans.losses import Losses
from fleetair.plans.scratch import scratch_path
from fleetair.schema import FEATURES, LOG, SCAN_LINE_FIELDS
from fleetair.sources import adapters as ad
from fleetair.sources import logs
from fleetair.streaming import operators as st

# --- text lines ----------------------------------------------------------------


def output_lines(spark, d, n_fields):
    """Text lines from events: every seventh is cut to 9 fields, others to 10,
    and two more in seven have a bad field."""
    k, v = F.col("event_id"), F.col("value")
    values = [k % 3, k * 3, v, k % 4, v + 1, v + 2, v + 3, v + 4, v + 5, v * 1000, v + 6,
              v + 7, v + 8, v + 9, k % 2, k % 2, k % 5]
    if n_fields == 16:
        values = [k % 3, k * 3, v, v + 1, v + 2, v + 3, k % 4, k % 3, k % 2, k % 4, v * 1000,
                  v + 4, v + 5, v + 6, k % 10, k % 5]
    parts = [x.cast("string") for x in values]
    parts[4] = F.when(k % 7 == 3, "x").otherwise(parts[4])
    parts[11] = F.when(k % 7 == 2, "bad").otherwise(parts[11])
    cut = F.when(k % 7 == 0, 9).when(k % 7 == 1, 10).otherwise(n_fields)
    line = F.concat(F.array_join(F.slice(F.array(*parts), 1, cut), ","), F.lit("\r\n"))
    return ad.events(spark, d).select("event_id", line.alias("line"))


def rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


OUTPUT_DOUBLES = ["temperature", "humidity", "pressure", "iaq", "static_iaq", "co2_equiv",
                  "breath_voc", "gas_resistance", "raw_temp", "raw_hum", "gas_pct", "stab", "runin"]


def s2(spark, d):
    return rounded(logs.parse_output_lines(output_lines(spark, d, 17)), OUTPUT_DOUBLES)


def s3(spark, d):
    doubles = [n for n, kind in SCAN_LINE_FIELDS if kind == "double"]
    return rounded(logs.parse_scan_lines(output_lines(spark, d, 16)), doubles)


# Of the accepted lines, kind 1 has ten fields and kind 2 eleven good ones.
_FULL = "event_id % 7 NOT IN (1, 2)"


def _num(e, when="TRUE"):
    return f"CASE WHEN {when} THEN round(CAST({e} AS DOUBLE), 6) END"


def _int(e, kind, when="TRUE"):
    return f"CAST(CASE WHEN {when} THEN {e} END AS {kind})"


OUTPUT_LINES_SQL = f"""
SELECT event_id, {_int('event_id % 3', 'SMALLINT')} AS sens_no, event_id * 3000 AS timestamp_ms,
  {_num('value + 4')} AS temperature, {_num('value + 5')} AS humidity, {_num('value * 1000')} AS pressure,
  {_num('value')} AS iaq, {_int('event_id % 4', 'SMALLINT')} AS iaq_accuracy, {_num('value + 1')} AS static_iaq,
  {_num('value + 8', _FULL)} AS co2_equiv, {_num('value + 9', _FULL)} AS breath_voc,
  {_num('value + 6', 'event_id % 7 <> 1')} AS gas_resistance, {_num('value + 2')} AS raw_temp,
  {_num('value + 3')} AS raw_hum, {_num('value + 7', _FULL)} AS gas_pct,
  {_num('event_id % 2', _FULL)} AS stab, {_num('event_id % 2', _FULL)} AS runin,
  {_int('event_id % 5', 'INTEGER', _FULL)} AS status
FROM events WHERE event_id % 7 NOT IN (0, 3)
"""
SCAN_LINES_SQL = f"""
SELECT event_id, {_int('event_id % 3', 'SMALLINT')} AS sens_no, event_id * 3000 AS timestamp_ms,
  {_num('value')} AS estimate_1, {_num('value + 1')} AS estimate_2, {_num('value + 2')} AS estimate_3,
  {_num('value + 3')} AS estimate_4, {_int('event_id % 4', 'SMALLINT')} AS accuracy_1,
  {_int('event_id % 3', 'SMALLINT')} AS accuracy_2, {_int('event_id % 2', 'SMALLINT')} AS accuracy_3,
  {_int('event_id % 4', 'SMALLINT')} AS accuracy_4,
  {_num('value * 1000', 'event_id % 7 <> 1')} AS pressure, {_num('value + 4', _FULL)} AS temp,
  {_num('value + 5', _FULL)} AS hum, {_num('value + 6', _FULL)} AS gas,
  {_int('event_id % 10', 'SMALLINT', _FULL)} AS gas_index, {_int('event_id % 5', 'INTEGER', _FULL)} AS status
FROM events WHERE event_id % 7 NOT IN (0, 3)
"""

# --- logs ----------------------------------------------------------------------


# Ids that folder names, numbers and CSV would change; users 0 to 8 have them.
DEVICE_NAMES = ["007", "1e3", "AA:BB:CC", "a+b", "x%y", "d(1)", "é1", "a,b", None]


def device_name(user: Column) -> Column:
    odd = F.get(F.array(*[F.lit(x) for x in DEVICE_NAMES]), (user % 20).cast("int"))
    return F.when(user % 20 < len(DEVICE_NAMES), odd).otherwise(F.concat(F.lit("dev "), user))


def log_rows(spark, d):
    """Events in the shape of the log: the value scaled per column."""
    scaled = {
        f.name: (F.col("value") / (i + 1)).cast("double")
        for i, f in enumerate(LOG.fields) if f.dataType == T.FloatType()
    }
    columns = {
        **scaled, "timestamp_ms": F.col("event_id") * 1000,
        "iaq_accuracy": (F.col("event_id") % 4).cast("short"),
        "label": (F.col("event_id") % 3).cast("tinyint"), "event_name": F.col("event_type"),
    }
    return ad.events(spark, d).select(
        device_name(F.col("user_id")).alias("device_id"), "ts",
        *[columns[f.name].alias(f.name) for f in LOG.fields])


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "device_id", (F.col("timestamp_ms") / 1000).cast("long").alias("event_id"),
        F.col("temperature").cast("double").alias("temperature"),
        F.round(F.col("iaq").cast("double"), 1).alias("iaq"),
        F.round(F.col("o3_ppb").cast("double"), 3).alias("o3_ppb"),
        F.col("label").cast("int").alias("label"), "event_name",
    ).withColumn("temperature", F.round("temperature", 2))


def _dec(e, n):
    return f"CAST(round(CAST({e} AS DECIMAL(28, 12)), {n}) AS DOUBLE)"


_NAMES = ", ".join("NULL" if x is None else f"'{x}'" for x in DEVICE_NAMES)
DEVICE_SQL = (f"CASE WHEN user_id % 20 < {len(DEVICE_NAMES)} THEN list_extract([{_NAMES}], CAST(user_id % 20 AS INT) + 1) "
              "ELSE 'dev ' || user_id END")
LOG_SQL = f"""
SELECT {DEVICE_SQL} AS device_id, event_id, {_dec('value / 2', 2)} AS temperature,
       {_dec('value / 5', 1)} AS iaq, {_dec('value / 11', 3)} AS o3_ppb,
       CAST(event_id % 3 AS INTEGER) AS label, event_type AS event_name
FROM events
"""


def s1(spark, d):
    """Written as CSV logs, one folder per device, and read back."""
    path = scratch_path(spark, "csv-log")
    logs.write_sensor_log(log_rows(spark, d), path, fmt="csv")
    return _shown(logs.scan_sensor_log(spark, path))


def s4(spark, d):
    """Two appends make one log."""
    path = scratch_path(spark, "log")
    rows = log_rows(spark, d)
    half = F.col("timestamp_ms") % 2000 == 0
    logs.write_sensor_log(rows.where(half), path)
    logs.write_sensor_log(rows.where(~half), path)
    return _shown(logs.read_log(spark, path))


def s5(spark, d):
    """One device starts again with other values; the rest stay."""
    path = scratch_path(spark, "log")
    rows = log_rows(spark, d)
    logs.write_sensor_log(rows, path)
    for device in ("AA:BB:CC", "a+b", None):
        logs.replace_log(rows.withColumn("temperature", F.lit(1.5)), path, device)
    return _shown(logs.read_log(spark, path))


def s6(spark, d):
    path, out = scratch_path(spark, "log"), scratch_path(spark, "export")
    logs.write_sensor_log(log_rows(spark, d), path)
    logs.export_log(spark, path, out)
    kinds = {f.name: f.dataType for f in LOG.fields}
    back = spark.read.option("header", True).csv(out)
    return _shown(back.select(*[
        F.col(c).cast(kinds.get(c, T.StringType())).alias(c) for c in back.columns]))


def u1(spark, d):
    r = ad.readings(spark, d)
    return logs.union_logs(
        r.where("side = 'A'").drop("side"), r.where("side = 'B'"), ad.commands(spark, d))


UNION_SQL = f"""
SELECT device_id, event_id, ts, value, CASE WHEN side = 'B' THEN side END AS side, NULL::VARCHAR AS cmd
FROM ({ad.READINGS_SQL})
UNION ALL SELECT device_id, event_id, ts, NULL, NULL, cmd FROM ({ad.COMMANDS_SQL})
"""

# --- streams -------------------------------------------------------------------

# A row this late pushes the watermark past all others.
END_OF_STREAM = "2100-01-01 00:00:00"


def staged(spark: SparkSession, df: DataFrame, device: str = "device_id") -> DataFrame:
    """A table as a stream of files, closed by a row of a device of its own."""
    path = scratch_path(spark, "incoming")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.range(1).select(*[
        F.lit(END_OF_STREAM).cast("timestamp").alias(f.name) if f.name == "ts"
        else F.lit(-1).cast(f.dataType).alias(f.name) if f.name in (device, "event_id")
        else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields
    ])
    df.unionByName(end).write.parquet(path)
    return logs.stream_readings(spark, path, df.schema)


def collected(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Run a stream over everything that has arrived and read its output."""
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    q = (
        df.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def s7(spark, d):
    out = collected(spark, staged(spark, ad.readings(spark, d)))
    return _ntz(out.where("device_id >= 0"), "ts")


def t1(spark, d):
    r = ad.readings(spark, d).withColumns({"value_a": F.col("value"), "value_b": F.col("value")})
    # The closing row needs a side to take part.
    r = staged(spark, r).fillna({"side": "A"})
    pairs = st.stream_pair(
        r, "device_id", "ts", "event_id", "side", ["value_a"], ["value_b"], "0 seconds")
    return _ntz(collected(spark, pairs), "ts")


def t2(spark, d):
    e = ad.events(spark, d)
    readings = staged(spark, ad.readings_of(e))
    commands = label_commands(staged(spark, ad.commands_of(e)).fillna({"cmd": "0"}))
    out = collected(spark, st.stream_label(
        readings, commands, "device_id", "ts", "event_id", "0 seconds"))
    out = out.where("device_id >= 0").withColumn("label", F.col("label").cast("int"))
    return _ntz(out, "ts")


#: A network over the two values of a pair.
PAIR_LAYERS = [{"w": [[0.8, -0.3], [0.1, 0.4], [-0.6, 0.2]], "b": [0.1, 0.0, -0.1], "act": "softmax"}]
PAIR_PARAMS = [("value_a", 50.0, 40.0), ("value_b", 60.0, 50.0)]


def logged_stream(spark, d):
    """Pairs, the label in force, the score and the log as one streaming query."""
    e = ad.events(spark, d)
    r = staged(spark, ad.readings_of(e).withColumns({"value_a": F.col("value"), "value_b": F.col("value")})).fillna({"side": "A"})
    commands = label_commands(staged(spark, ad.commands_of(e)).fillna({"cmd": "0"}))
    pairs = st.chained_pair(r, "device_id", "ts", "event_id", "side", ["value_a"], ["value_b"], "0 seconds")
    labelled = st.chained_label(pairs, commands, "device_id", "ts", "event_id", "0 seconds")
    params = spark.createDataFrame(PAIR_PARAMS, "feature string, mean double, scale double")
    out, checkpoint = (scratch_path(spark, n) for n in ("scored", "checkpoint"))
    st.stream_score(labelled, params, PAIR_LAYERS, out, checkpoint, ["value_a", "value_b"], available_now=True).awaitTermination()
    scored = spark.read.parquet(out).where("device_id >= 0")
    return _ntz(scored.select(
        "device_id", "event_id", "ts", "value_a", "value_b", F.col("label").cast("int").alias("label"), "event_name",
        "predicted", F.round("confidence", 6).alias("confidence")), "ts")


_Z = [f"({w[0]}e0 * (value_a - 50e0) / 40e0 + {w[1]}e0 * (value_b - 60e0) / 50e0 + {b}e0)"
      for w, b in zip(PAIR_LAYERS[0]["w"], PAIR_LAYERS[0]["b"])]
LOGGED_SQL = f"""
WITH p AS ({PAIRED_SQL}),
c AS (SELECT device_id, ts, {LABEL_CASE} AS label, {NAME_CASE} AS event_name FROM ({ad.COMMANDS_SQL})),
l AS (SELECT p.*, CAST(coalesce(c.label, 0) AS INTEGER) AS label, coalesce(c.event_name, 'unlabeled') AS event_name,
             [exp({_Z[0]}), exp({_Z[1]}), exp({_Z[2]})] AS z
      FROM p ASOF LEFT JOIN c ON p.device_id = c.device_id AND p.ts >= c.ts)
SELECT device_id, event_id, ts, value_a, value_b, label, event_name,
       CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS predicted, round(list_max(z) / list_sum(z), 6) AS confidence
FROM l
"""


def losses(spark, d):
    """Lines, readings and a late stream, with every row accounted for."""
    found = Losses()
    lines = found.watch(logs.parse_output_lines(output_lines(spark, d, 17), keep_bad=True), "parse", {"bad_line": ~F.col("line_ok")})
    lines.where("line_ok").write.parquet(scratch_path(spark, "parsed"))
    raw = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("device_id"))
    calib = calibration_of(ad.table(spark, d, "supplier")).where("device_id % 10 <> 0").withColumn("known", F.lit(True))
    joined = raw.join(calib.select("device_id", "known"), "device_id", "left")
    found.watch(joined, "calibrate", {"no_calibration": F.col("known").isNull()}).where("known").write.parquet(scratch_path(spark, "calibrated"))

    # A file is one batch. The watermark that the first one leaves behind holds from the third on.
    path = scratch_path(spark, "incoming")
    e = ad.events(spark, d).select(
        "event_id", F.when(F.col("event_id") % 13 != 0, F.col("ts").cast("timestamp")).alias("ts"))
    for part in ("event_id % 2 = 1", "event_id % 4 = 2", "event_id % 4 = 0"):
        e.where(part).coalesce(1).write.mode("append").parquet(path)
    found.listen(spark)
    stream = found.watch(logs.stream_readings(spark, path, e.schema, files_per_batch=1), "stream", {"no_time": F.col("ts").isNull()})
    timed = st.stream_dedup(stream.where("ts IS NOT NULL"), "event_id", "ts", "3 days")
    query = (
        timed.writeStream.format("parquet").option("path", scratch_path(spark, "out"))
        .option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start())
    found.finish(query)
    found.stop(spark)
    return found.report(spark)


LOSSES_SQL = """
WITH e AS (SELECT *, event_id % 13 = 0 AS untimed FROM events),
f AS (SELECT max(ts) - INTERVAL 3 DAY AS past FROM e WHERE event_id % 2 = 1 AND NOT untimed),
s AS (SELECT count(*) AS n, count(*) FILTER (untimed) AS untimed,
             count(*) FILTER (NOT untimed AND event_id % 4 = 0 AND epoch_ms(ts) <= epoch_ms(past)) AS late FROM e, f)
SELECT 'parse' AS stage, 'in' AS reason, count(*) AS rows FROM events
UNION ALL SELECT 'parse', 'kept', count(*) FROM events WHERE event_id % 7 NOT IN (0, 3)
UNION ALL SELECT 'parse', 'bad_line', count(*) FROM events WHERE event_id % 7 IN (0, 3)
UNION ALL SELECT 'calibrate', 'in', count(*) FROM lineitem
UNION ALL SELECT 'calibrate', 'kept', count(*) FROM lineitem WHERE l_suppkey % 10 <> 0
UNION ALL SELECT 'calibrate', 'no_calibration', count(*) FROM lineitem WHERE l_suppkey % 10 = 0
UNION ALL SELECT 'stream', 'in', n FROM s
UNION ALL SELECT 'stream', 'kept', n - untimed - late FROM s
UNION ALL SELECT 'stream', 'no_time', untimed FROM s
UNION ALL SELECT 'stream', 'late', late FROM s
"""


def w3_stream(spark, d):
    r = ad.readings(spark, d).select("device_id", "event_id", "ts", "value")
    out = collected(spark, st.stream_cadence(
        staged(spark, r), "device_id", "ts", "event_id", 18000, "0 seconds"))
    return _ntz(out.where("device_id >= 0"), "ts")


def rollup(kind, **options):
    def query(spark, d):
        r = staged(spark, ad.readings(spark, d))
        out = collected(spark, st.stream_rollup(
            r, "device_id", "ts", ["value"], kind, watermark="0 seconds", **options))
        out = out.withColumn("value_mean", F.round("value_mean", 6))
        return _ntz(out.where("device_id >= 0"), "start", "end")
    return query


def table_sessions(spark, d):
    r = ad.readings(spark, d)
    out = st.stream_rollup(
        r, "device_id", "ts", ["value"], "session", gap="5 hours", watermark=None)
    return out.withColumn("value_mean", F.round("value_mean", 6))


TUMBLING_SQL = f"""
SELECT device_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end",
       count(*) AS rows, round(avg(value), 6) AS value_mean
FROM ({ad.READINGS_SQL}) GROUP BY ALL
"""
SLIDING_SQL = f"""
WITH w AS (SELECT device_id, value, time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL (i * 20) MINUTE AS start
           FROM ({ad.READINGS_SQL}), (VALUES (0), (1), (2)) o(i))
SELECT device_id, start, start + INTERVAL 1 HOUR AS "end", count(*) AS rows, round(avg(value), 6) AS value_mean
FROM w GROUP BY ALL
"""
SESSION_SQL = f"""
WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 18000000000, TRUE) AS fresh
           FROM ({ad.READINGS_SQL}) WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY device_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT device_id, min(ts) AS start, max(ts) + INTERVAL 5 HOUR AS "end", count(*) AS rows,
       round(avg(value), 6) AS value_mean
FROM s GROUP BY device_id, n
"""


def t4(spark, d):
    rows = models.with_gaps(spark, d)
    incoming, out, checkpoint = (scratch_path(spark, n) for n in ("incoming", "scored", "checkpoint"))
    rows.write.parquet(incoming)
    stream = logs.stream_readings(spark, incoming, rows.schema)
    st.stream_score(
        stream, ml.fit_scaler(rows, FEATURES), models.LAYERS, out, checkpoint, available_now=True
    ).awaitTermination()
    return spark.read.parquet(out).select(
        "row_id", "label", "predicted", F.round("confidence", 6).alias("confidence"), "predicted_name")


def t5(spark, d):
    """Clocks that read whole hours repeat within a device."""
    r = ad.readings(spark, d).select("device_id", "event_id", F.date_trunc("hour", "ts").alias("ts"))
    out = collected(spark, st.stream_dedup(
        staged(spark, r).select("device_id", "ts"), "device_id", "ts", "1 hour"))
    return _ntz(out.where("device_id >= 0"), "ts")


QUERIES = {
    "s1_scan_sensor_log": s1,
    "s2_parse_output_lines": s2,
    "s3_parse_scan_lines": s3,
    "s4_write_sensor_log": s4,
    "s5_replace_log": s5,
    "s6_export_log": s6,
    "s7_stream_readings": s7,
    "u1_union_logs": u1,
    "t1_stream_pair": t1,
    "t2_stream_label": t2,
    "t3_stream_rollup_tumbling": rollup("tumbling", width="1 hour"),
    "t3_stream_rollup_sliding": rollup("sliding", width="1 hour", slide="20 minutes"),
    "t3_stream_rollup_session": rollup("session", gap="5 hours"),
    "t3_table_sessions": table_sessions,
    "t4_stream_score": t4,
    "t5_stream_dedup": t5,
    "w3_cadence_exact_stream": w3_stream,
    "t124_logged_stream": logged_stream,
    "a9_losses": losses,
}
SQL = {
    "s1_scan_sensor_log": LOG_SQL,
    "s2_parse_output_lines": OUTPUT_LINES_SQL,
    "s3_parse_scan_lines": SCAN_LINES_SQL,
    "s4_write_sensor_log": LOG_SQL,
    "s5_replace_log": f"""
SELECT * REPLACE (CASE WHEN device_id IN ('AA:BB:CC', 'a+b') OR device_id IS NULL THEN 1.5e0 ELSE temperature END AS temperature) FROM ({LOG_SQL})""",
    "s6_export_log": LOG_SQL,
    "s7_stream_readings": ad.READINGS_SQL,
    "u1_union_logs": UNION_SQL,
    "t1_stream_pair": PAIRED_SQL,
    "t2_stream_label": LABELLED_SQL,
    "t3_stream_rollup_tumbling": TUMBLING_SQL,
    "t3_stream_rollup_sliding": SLIDING_SQL,
    "t3_stream_rollup_session": SESSION_SQL,
    "t3_table_sessions": SESSION_SQL,
    "t4_stream_score": models.SCORED_SQL,
    "w3_cadence_exact_stream": CADENCE_SQL,
    "t124_logged_stream": LOGGED_SQL,
    "a9_losses": LOSSES_SQL,
    "t5_stream_dedup": f"SELECT DISTINCT device_id, date_trunc('hour', ts) AS ts FROM ({ad.READINGS_SQL})",
}
