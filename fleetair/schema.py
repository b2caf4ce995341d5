"""Schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the sensor log, in file order.
LOG_COLUMNS = [
    ("timestamp_ms", T.LongType()),
    ("temperature", T.FloatType()),
    ("humidity", T.FloatType()),
    ("pressure", T.FloatType()),
    ("iaq", T.FloatType()),
    ("iaq_accuracy", T.ShortType()),
    ("static_iaq", T.FloatType()),
    ("co2_equiv", T.FloatType()),
    ("breath_voc", T.FloatType()),
    ("gas_resistance", T.FloatType()),
    ("o3_ppb", T.FloatType()),
    ("no2_ppb", T.FloatType()),
    ("oaq_index", T.FloatType()),
    ("rmox_0", T.FloatType()),
    ("rmox_1", T.FloatType()),
    ("rmox_2", T.FloatType()),
    ("rmox_3", T.FloatType()),
    ("label", T.ByteType()),
    ("event_name", T.StringType()),
]
LOG = T.StructType([T.StructField(name, kind) for name, kind in LOG_COLUMNS])
READINGS = T.StructType([T.StructField("device_id", T.StringType()), *LOG.fields])

# Everything that is measured: the log without clock, label and label name.
FEATURES = [name for name, _ in LOG_COLUMNS[1:17]]
ENVIRONMENT_COLUMNS = FEATURES[:9]
GAS_COLUMNS = FEATURES[9:]

# Decimals written per log column.
LOG_DECIMALS = {
    "temperature": 2, "humidity": 2, "pressure": 2, "breath_voc": 2,
    "iaq": 1, "static_iaq": 1, "co2_equiv": 1, "gas_resistance": 1, "oaq_index": 1,
    "o3_ppb": 3, "no2_ppb": 3,
    "rmox_0": 3, "rmox_1": 3, "rmox_2": 3, "rmox_3": 3,
}

# Fields of the two text output lines, in line order.
OUTPUT_LINE_FIELDS = [
    ("sens_no", "short"), ("timestamp_s", "long"), ("iaq", "double"),
    ("iaq_accuracy", "short"), ("static_iaq", "double"), ("raw_temp", "double"),
    ("raw_hum", "double"), ("comp_temp", "double"), ("comp_hum", "double"),
    ("pressure", "double"), ("gas", "double"), ("gas_pct", "double"),
    ("co2", "double"), ("voc", "double"), ("stab", "double"),
    ("runin", "double"), ("status", "int"),
]
SCAN_LINE_FIELDS = [
    ("sens_no", "short"), ("timestamp_s", "long"),
    ("estimate_1", "double"), ("estimate_2", "double"),
    ("estimate_3", "double"), ("estimate_4", "double"),
    ("accuracy_1", "short"), ("accuracy_2", "short"),
    ("accuracy_3", "short"), ("accuracy_4", "short"),
    ("pressure", "double"), ("temp", "double"), ("hum", "double"),
    ("gas", "double"), ("gas_index", "short"), ("status", "int"),
]

# Labels, their names and the state before any command.
CLASS_NAMES = ["LOW", "MODERATE", "HIGH"]
UNKNOWN_CLASS = "UNKNOWN"
UNLABELED = -1
UNLABELED_NAME = "unlabeled"
DEFAULT_LABEL = 0
EVENT_NAME_CHARS = 15

# Ambient conditions assumed before the first good reading.
DEFAULT_AMBIENT = {"temperature": -300.0, "humidity": 50.0}

# Physical input ids of the long form.
INPUT_IDS = {
    "pressure": 1, "humidity": 2, "temperature": 3, "gas_resistance": 4,
    "heat_source": 14, "gas_index": 24,
}

# Virtual output ids of the long form and their wide names.
OUTPUT_IDS = {
    1: "iaq", 2: "static_iaq", 3: "co2_equiv", 4: "breath_voc",
    6: "raw_temp", 7: "raw_pressure", 8: "raw_humidity", 9: "raw_gas",
    12: "stabilization_status", 13: "run_in_status",
    14: "comp_temp", 15: "comp_humidity", 21: "gas_percentage",
}
# Gas-scan outputs, and the regression outputs that fill the same estimates.
SCAN_OUTPUT_IDS = {
    6: "raw_temp", 7: "raw_pressure", 8: "raw_humidity", 9: "raw_gas",
    22: "gas_estimate_1", 23: "gas_estimate_2", 24: "gas_estimate_3",
    25: "gas_estimate_4", 26: "raw_gas_index",
    27: "gas_estimate_1", 28: "gas_estimate_2", 29: "gas_estimate_3",
    30: "gas_estimate_4",
}
# Outputs whose accuracy is kept, and the column it goes to.
ACCURACY_COLUMNS = {
    "iaq": "iaq_accuracy",
    "gas_estimate_1": "gas_accuracy_1", "gas_estimate_2": "gas_accuracy_2",
    "gas_estimate_3": "gas_accuracy_3", "gas_estimate_4": "gas_accuracy_4",
}

# Status bits of a decoded frame.
NEW_DATA_BIT = 0x80
GAS_VALID_BIT = 0x20
HEATER_STABLE_BIT = 0x10
FRAME_BYTES = 17
CALIBRATION_BYTES = 42

# Result codes of the gas-side algorithm.
RESULT_OK = 0
RESULT_STABILISING = 1
RESULT_DAMAGED = -102
WARMUP_SAMPLES = 50

# Product id expected from the gas sensor.
EXPECTED_PID = 0x6320

# Accuracy levels 0-3.
ACCURACY_NAMES = ["UNRELIABLE", "LOW_ACCURACY", "MEDIUM_ACCURACY", "HIGH_ACCURACY"]
