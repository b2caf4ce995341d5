"""The driver's tables in the shape of sensor data.

Events of the kinds click and view play the environmental side (A), purchase and
signup the gas side (B), and error events the operator's commands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def side_of(event_type: Column) -> Column:
    return (
        F.when(event_type.isin("click", "view"), "A")
        .when(event_type.isin("purchase", "signup"), "B")
    )


def readings_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("event_type") != "error").select(
        F.col("user_id").alias("device_id"), "event_id", "ts",
        side_of(F.col("event_type")).alias("side"), "value",
    )


def commands_of(df: DataFrame) -> DataFrame:
    chars = F.get(F.lit(["0", "1", "2", "x"]), (F.col("event_id") % 4).cast("int"))
    return df.where(F.col("event_type") == "error").select(
        F.col("user_id").alias("device_id"), "event_id", "ts", chars.alias("cmd")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(events(spark, sf_dir))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands_of(events(spark, sf_dir))


READINGS_SQL = """
SELECT user_id AS device_id, event_id, ts, value,
       CASE WHEN event_type IN ('click', 'view') THEN 'A' ELSE 'B' END AS side
FROM events WHERE event_type <> 'error'
"""

COMMANDS_SQL = """
SELECT user_id AS device_id, event_id, ts, (event_id % 4) AS code,
       CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE 'x' END AS cmd
FROM events WHERE event_type = 'error'
"""
