"""Row selection, checks and what they drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetair.functions.codes import accuracy_name, code_table, severity
from fleetair.plans.timeline import Slices, Timeline, as_list, first_per_group
from fleetair.schema import FEATURES, GAS_VALID_BIT, RESULT_OK, WARMUP_SAMPLES


def select_features(df: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """The model inputs in their fixed order."""
    return df.select(*names)


def classify_source(df: DataFrame, source: str | None = None) -> DataFrame:
    """Which side a row is from: 'A' if any of T, H, P is non-zero, else 'B'.

    The rule reads a true zero reading of A as B, so a ``source`` column wins
    where it is filled.
    """
    any_set = F.lit(False)
    for name in ("temperature", "humidity", "pressure"):
        any_set = any_set | (F.coalesce(F.col(name), F.lit(0.0)) != 0)
    guess = F.when(any_set, "A").otherwise("B")
    return df.withColumn("side", F.coalesce(F.col(source), guess) if source else guess)


def gas_valid(df: DataFrame, col: str = "status") -> DataFrame:
    return df.where(F.col(col).bitwiseAND(F.lit(GAS_VALID_BIT)) != 0)


def valid_results(df: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """(rows with result code 0, row count per code)."""
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("rows"))
    return df.where(F.col(code) == RESULT_OK), counts


def drop_warmup(
    df: DataFrame, n: int = WARMUP_SAMPLES, key=("device_id", "boot_id"),
    order=("ts",), slices: Slices | None = None,
) -> DataFrame:
    """Drop the first ``n`` samples after each (re)start."""
    line = Timeline(df, key, order, slices).scan(total={"_n": F.lit(1)})
    return line.df.where(F.col("_n") > n).select(*df.columns)


def decode_codes(df: DataFrame, col: str, codes: dict[int, str] | DataFrame) -> DataFrame:
    """Add the name (NULL if unknown) and the severity of a status code.

    A given mapping is a few dozen rows; a given table (code, name) is left to
    the optimiser.
    """
    if isinstance(codes, dict):
        table = F.broadcast(code_table(df.sparkSession, codes))
    else:
        table = codes
    table = table.select(F.col("code").alias("_code"), F.col("name").alias(f"{col}_name"))
    return (
        df.join(table, F.col(col) == F.col("_code"), "left")
        .drop("_code")
        .withColumn(f"{col}_severity", severity(F.col(col)))
    )


def accuracy_filter(df: DataFrame, min_level: int, col: str = "iaq_accuracy") -> DataFrame:
    """Keep rows at or above an accuracy level and name the level."""
    return df.where(F.col(col) >= min_level).withColumn(
        "accuracy_name", accuracy_name(F.col(col))
    )


def timestamp_check(
    df: DataFrame, key, ts: str, mode: str = "flag", order=None,
    slices: Slices | None = None,
) -> DataFrame:
    """Time stamps must increase, in arrival ``order``, within a key.

    ``flag`` adds ``ts_check``: ok, repeat (same as the row before) or backwards.
    ``drop`` keeps the first arrival of each time stamp.
    """
    key, order = as_list(key), as_list(order or ts)
    if mode == "drop":
        return first_per_group(df, [*key, ts], order)
    if mode != "flag":
        raise ValueError(f"mode must be 'flag' or 'drop', not {mode!r}")
    line = Timeline(df, key, order, slices).scan(lag={"_prev": F.col(ts)})
    check = (
        F.when(F.col(ts) == F.col("_prev"), "repeat")
        .when(F.col(ts) < F.col("_prev"), "backwards")
        .otherwise("ok")
    )
    return line.with_columns(ts_check=check).result("_prev")


def duplicate_sensors(df: DataFrame, key, step: str, sensor: str, order, slices: Slices | None = None) -> DataFrame:
    """Mark rows whose sensor has a row in the same step already, which is an error.

    Adds ``duplicate_sensor``; of the rows of a sensor in a step the first by ``order`` is right.
    """
    group = [*as_list(key), step, sensor]
    line = Timeline(df, group, order, slices).scan(total={"_nth": F.lit(1)})
    return line.with_columns(duplicate_sensor=F.col("_nth") > 1).result("_nth")


# Limits of the built-in self-test.
SELF_TEST_LIMITS = {
    "temperature": (0.0, 60.0),
    "pressure": (90000.0, 110000.0),
    "humidity": (20.0, 80.0),
}
SELF_TEST_ROWS = 6
SELF_TEST_MIN_RATIO = 6


def self_test(df: DataFrame, key=("device_id", "run"), seq: str = "seq") -> DataFrame:
    """Verdict per run of six measurements (``seq`` 0-5).

    Counts one failure for each first-row value outside its limits, each row
    without valid gas, and a centre ratio under the minimum.
    """
    first = F.col(seq) == 0

    def gas(i: int):
        return F.max(F.when(F.col(seq) == i, F.col("gas_resistance")))

    outside = [
        F.max(F.when(first, F.when(F.col(c).between(lo, hi), 0).otherwise(1)))
        for c, (lo, hi) in SELF_TEST_LIMITS.items()
    ]
    invalid = F.sum(
        F.when(F.col("status").bitwiseAND(F.lit(GAS_VALID_BIT)) != 0, 0).otherwise(1)
    )
    per_run = df.where(F.col(seq) < SELF_TEST_ROWS).groupBy(*as_list(key)).agg(
        F.count(F.lit(1)).alias("rows"),
        sum(outside[1:], outside[0]).alias("_outside"),
        invalid.alias("_invalid"),
        F.try_divide(5.0 * (gas(3) + gas(5)), 2.0 * gas(4)).alias("_ratio"),
    )
    # A run cut short has no ratio, which counts as zero.
    ratio = F.when(F.col("rows") == SELF_TEST_ROWS, F.floor("_ratio"))
    ratio = F.coalesce(ratio, F.lit(0)).cast("long")
    failures = (
        F.coalesce(F.col("_outside"), F.lit(len(SELF_TEST_LIMITS)))
        + F.col("_invalid")
        + F.when(ratio < SELF_TEST_MIN_RATIO, 1).otherwise(0)
    )
    return per_run.select(
        *as_list(key), "rows", ratio.alias("ratio"),
        failures.cast("long").alias("failures"), (failures == 0).alias("passed"),
    )


def drop_report(df: DataFrame, reason: str) -> DataFrame:
    """Rows kept (NULL reason) and lost per reason; the counts add up to the input."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias(reason)).agg(
        F.count(F.lit(1)).alias("rows")
    )
