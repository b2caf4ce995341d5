"""Between the wide form (a column per signal) and the long form (a row per signal)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.plans.timeline import as_list
from fleetair.schema import ACCURACY_COLUMNS, GAS_VALID_BIT, INPUT_IDS, OUTPUT_IDS

# Inputs that only count when the frame carries valid gas data.
_NEEDS_GAS = ("gas_resistance", "gas_index")


def to_long(
    df: DataFrame, mask: int | str | Column, forced: bool | Column = False,
    status: str = "status",
) -> DataFrame:
    """One row (sensor_id, signal) per requested physical input.

    ``mask`` is the request: input ``i`` is wanted when bit ``i - 1`` is set. A
    constant mask prunes the unwanted columns from the scan. In forced mode the
    gas index reads 0. Input columns that ``df`` lacks are not emitted.
    """
    inputs = {n: i for n, i in INPUT_IDS.items() if n in df.columns}
    if isinstance(mask, int):
        inputs = {n: i for n, i in inputs.items() if mask >> (i - 1) & 1}
        wanted = F.lit(True)
    else:
        mask = F.col(mask) if isinstance(mask, str) else mask
        df = df.withColumn("_mask", mask.cast("long"))
        bit = F.call_function("shiftright", F.col("_mask"), F.col("sensor_id") - 1)
        wanted = bit.bitwiseAND(F.lit(1)) == 1
    forced = F.lit(forced) if isinstance(forced, bool) else forced
    values = {n: F.col(n).cast("double") for n in inputs}
    if "gas_index" in values:
        values["gas_index"] = F.when(forced, F.lit(0.0)).otherwise(values["gas_index"])
    rest = [c for c in df.columns if c not in INPUT_IDS]
    wide = df.select(*rest, *[v.alias(f"_in_{n}") for n, v in values.items()])
    by_name = F.create_map(
        *[x for n, i in inputs.items() for x in (F.lit(f"_in_{n}"), F.lit(i))]
    )
    long = wide.unpivot(rest, [f"_in_{n}" for n in inputs], "_name", "signal")
    long = long.withColumn("sensor_id", by_name[F.col("_name")])
    gas_ids = [INPUT_IDS[n] for n in _NEEDS_GAS]
    has_gas = F.col(status).bitwiseAND(F.lit(GAS_VALID_BIT)) != 0
    return long.where(wanted & (~F.col("sensor_id").isin(gas_ids) | has_gas)).select(
        *[c for c in rest if c != "_mask"], "sensor_id", "signal"
    )


def to_wide(
    df: DataFrame, key, ids: Mapping[int, str] = OUTPUT_IDS, fill: float | None = None,
    order: str = "time_ns",
) -> DataFrame:
    """One row per ``key`` with a column per virtual output.

    If an output occurs more than once, the last by ``order`` wins. The row's
    time is that of the last known output; ids not in ``ids`` are skipped.
    Accuracy is kept for the index and the gas estimates only. A single grouped
    aggregate with fixed columns: no pass to find the ids, and partial sums
    before the exchange.
    """
    key = as_list(key)
    names = list(dict.fromkeys(ids.values()))
    has_accuracy = "accuracy" in df.columns
    aggs = [F.max(order).alias(order)]
    for name in names:
        is_it = F.col("sensor_id").isin([i for i, n in ids.items() if n == name])
        at = F.when(is_it, F.col(order))
        signal = F.max_by(F.col("signal"), at)
        aggs.append((F.coalesce(signal, F.lit(fill)) if fill is not None else signal).alias(name))
        if has_accuracy and name in ACCURACY_COLUMNS:
            level = F.max_by(F.col("accuracy"), at)
            if fill is not None:
                level = F.coalesce(level, F.lit(int(fill)).cast(df.schema["accuracy"].dataType))
            aggs.append(level.alias(ACCURACY_COLUMNS[name]))
    return df.where(F.col("sensor_id").isin(list(ids))).groupBy(*key).agg(*aggs)
