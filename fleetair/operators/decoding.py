"""Frames and calibration to readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetair.functions.decode import (
    comp_humidity,
    comp_pressure,
    comp_temperature,
    gas_resistance,
)
from fleetair.operators.asof import with_calibration


def compensate(df: DataFrame, calib: DataFrame, key) -> DataFrame:
    """Physical values of decoded frames, each with its own device's coefficients."""
    c = F.col("calib")
    return (
        with_calibration(df, calib, key)
        .withColumn("temperature", comp_temperature(F.col("adc_t"), c))
        .withColumns({
            "pressure": comp_pressure(F.col("adc_p"), F.col("temperature"), c),
            "humidity": comp_humidity(F.col("adc_h"), F.col("temperature"), c),
            "gas_resistance": gas_resistance(F.col("adc_g"), F.col("gas_range")),
        })
        .drop("calib")
    )
