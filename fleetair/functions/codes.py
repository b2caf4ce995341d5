"""Codes, flags and names as column expressions and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetair.schema import (
    ACCURACY_NAMES,
    CLASS_NAMES,
    EVENT_NAME_CHARS,
    GAS_VALID_BIT,
    HEATER_STABLE_BIT,
    NEW_DATA_BIT,
    UNKNOWN_CLASS,
    UNLABELED,
    UNLABELED_NAME,
)

# Status codes of the signal algorithm, without the prefix that the
# vendor puts before every name.
SIGNAL_CODES = {
    0: "OK",
    -1: "E_DOSTEPS_INVALIDINPUT",
    -2: "E_DOSTEPS_VALUELIMITS",
    4: "W_DOSTEPS_TSINTRADIFFOUTOFRANGE",
    -6: "E_DOSTEPS_DUPLICATEINPUT",
    2: "I_DOSTEPS_NOOUTPUTSRETURNABLE",
    3: "W_DOSTEPS_EXCESSOUTPUTS",
    5: "W_DOSTEPS_GASINDEXMISS",
    -10: "E_SU_WRONGDATARATE",
    -12: "E_SU_SAMPLERATELIMITS",
    -13: "E_SU_DUPLICATEGATE",
    -14: "E_SU_INVALIDSAMPLERATE",
    -15: "E_SU_GATECOUNTEXCEEDSARRAY",
    -16: "E_SU_SAMPLINTVLINTEGERMULT",
    -17: "E_SU_MULTGASSAMPLINTVL",
    -18: "E_SU_HIGHHEATERONDURATION",
    10: "W_SU_UNKNOWNOUTPUTGATE",
    11: "W_SU_MODINNOULP",
    12: "I_SU_SUBSCRIBEDOUTPUTGATES",
    13: "I_SU_GASESTIMATEPRECEDENCE",
    14: "W_SU_SAMPLERATEMISMATCH",
    -32: "E_PARSE_SECTIONEXCEEDSWORKBUFFER",
    -33: "E_CONFIG_FAIL",
    -34: "E_CONFIG_VERSIONMISMATCH",
    -35: "E_CONFIG_FEATUREMISMATCH",
    -36: "E_CONFIG_CRCMISMATCH",
    -37: "E_CONFIG_EMPTY",
    -38: "E_CONFIG_INSUFFICIENTWORKBUFFER",
    -40: "E_CONFIG_INVALIDSTRINGSIZE",
    -41: "E_CONFIG_INSUFFICIENTBUFFER",
    -100: "E_SET_INVALIDCHANNELIDENTIFIER",
    -104: "E_SET_INVALIDLENGTH",
    100: "W_SC_CALL_TIMING_VIOLATION",
    101: "W_SC_MODEXCEEDULPTIMELIMIT",
    102: "W_SC_MODINSUFFICIENTWAITTIME",
}

# Status codes of the gas sensor.
GAS_SENSOR_CODES = {
    0: "OK",
    -1: "INIT_OUT_OF_RANGE",
    -2: "GAS_TIMEOUT",
    -3: "I2C",
    -4: "SENSOR_UNSUPPORTED",
    -5: "CONFIG_MISSING",
    -6: "ACCESS_CONFLICT",
    -7: "POR_EVENT",
    -8: "CLEANING",
    -9: "NULL_PTR",
}


def code_table(spark: SparkSession, codes: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted(codes.items()), "code int, name string")


def severity(code: Column) -> Column:
    """Sign rule: below zero an error, zero fine, above zero a warning."""
    return F.when(code < 0, "error").when(code == 0, "ok").when(code > 0, "warning")


def status_flags(df: DataFrame, col: str = "status") -> DataFrame:
    def bit(mask: int) -> Column:
        return F.col(col).bitwiseAND(F.lit(mask)) != 0

    return df.withColumns({
        "new_data": bit(NEW_DATA_BIT),
        "gas_valid": bit(GAS_VALID_BIT),
        "heater_stable": bit(HEATER_STABLE_BIT),
    })


def error_event(c: Column) -> Column:
    """Event byte to a name; a power-on reset hides an access conflict."""
    return (
        F.when(c.bitwiseAND(F.lit(0x80)) != 0, GAS_SENSOR_CODES[-7])
        .when(c.bitwiseAND(F.lit(0x40)) != 0, GAS_SENSOR_CODES[-6])
        .when(c.isNotNull(), GAS_SENSOR_CODES[0])
    )


def accuracy_name(level: Column) -> Column:
    return F.get(F.lit(ACCURACY_NAMES), level.cast("int"))


def class_name(c: Column) -> Column:
    return F.coalesce(F.get(F.lit(CLASS_NAMES), c.cast("int")), F.lit(UNKNOWN_CLASS))


def map_commands(df: DataFrame, col: str = "cmd") -> DataFrame:
    """One-character operator commands to an action, a label and its name.

    Only action ``label`` changes the label; ``label`` and ``event_name`` are NULL
    on every other row.
    """
    c = F.col(col)
    lower = F.lower(c)
    known = c.isin("0", "1", "2")
    label = F.when(known, c.try_cast("int")).when(lower == "x", F.lit(UNLABELED))
    name = F.when(known, F.get(F.lit(CLASS_NAMES), c.try_cast("int"))).when(
        lower == "x", F.lit(UNLABELED_NAME)
    )
    action = (
        F.when(known | (lower == "x"), "label")
        .when(lower == "d", "dump")
        .when(lower == "c", "clear")
        .when(lower == "s", "status")
        .when(c.isin("\n", "\r"), "ignored")
        .otherwise("unknown")
    )
    return df.withColumns({
        "action": action,
        "label": label.cast("tinyint"),
        "event_name": F.substring(name, 1, EVENT_NAME_CHARS),
    })
