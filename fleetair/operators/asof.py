"""State in force at a time, and joins of readings to small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetair.plans.timeline import Slices, Timeline, as_list
from fleetair.schema import (
    DEFAULT_AMBIENT,
    DEFAULT_LABEL,
    EXPECTED_PID,
    UNLABELED_NAME,
)


def last_before(
    df: DataFrame,
    updates: DataFrame,
    key,
    ts: str,
    values: list[str],
    tie: str | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Attach the ``values`` of the last update at or before each row's time.

    Both tables go through one exchange as a union; an update sorts before a row
    of the same time. ``tie`` orders updates that share a time. The attached
    struct is ``_state``, NULL before the first update.
    """
    key = as_list(key)
    # Keys and time stay columns of their own: what follows can rely on the
    # partitioning by key.
    rest = [c for c in df.columns if c not in (*key, ts)]
    rows = df.select(
        *key, ts, F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_tie"),
        F.struct(F.lit(True).alias("_"), *rest).alias("_row"), F.lit(None).alias("_value"),
    )
    states = updates.select(
        *key, ts, F.lit(0).alias("_kind"),
        (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("_tie"),
        F.lit(None).alias("_row"), F.struct(*values).alias("_value"),
    )
    line = Timeline(rows.unionByName(states), key, [ts, "_kind", "_tie"], slices)
    line = line.scan(last={"_state": F.col("_value")})
    columns = [F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns]
    return line.df.where("_kind = 1").select(*columns, "_state")


def label_asof(
    df: DataFrame, commands: DataFrame, key, ts: str, tie: str | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Attach the label in force: that of the last command at or before the row.

    Before any command the label is 0 under the name "unlabeled", and
    ``label_source`` tells the two apart.
    """
    joined = last_before(df, commands, key, ts, ["label", "event_name"], tie, slices)
    given = F.col("_state").isNotNull()
    return joined.withColumns({
        "label": F.coalesce(F.col("_state.label"), F.lit(DEFAULT_LABEL)).cast("tinyint"),
        "event_name": F.coalesce(F.col("_state.event_name"), F.lit(UNLABELED_NAME)),
        "label_source": F.when(given, "command").otherwise("default"),
    }).drop("_state")


def ambient_asof(
    df: DataFrame, ambient: DataFrame, key, ts: str,
    defaults: dict[str, float] | None = None, tie: str | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Attach the last good ambient reading; a reading with a NULL failed."""
    defaults = defaults or DEFAULT_AMBIENT
    names = list(defaults)
    good = ambient.dropna(subset=names)
    joined = last_before(df, good, key, ts, names, tie, slices)
    return joined.withColumns({
        f"ambient_{n}": F.coalesce(F.col(f"_state.{n}"), F.lit(defaults[n])) for n in names
    }).drop("_state")


def hold_last(
    df: DataFrame, key, order, cols: list[str], slices: Slices | None = None
) -> DataFrame:
    """Replace each column by its last non-null value so far."""
    line = Timeline(df, key, order, slices)
    held = line.scan(last={f"_held_{c}": F.col(c) for c in cols})
    names = df.columns
    return held.df.select(
        *[F.col(f"_held_{c}").alias(c) if c in cols else F.col(c) for c in names]
    )


def _coefficients(calib: DataFrame, key: list[str]) -> DataFrame:
    packed = F.struct(*[c for c in calib.columns if c not in key])
    return calib.groupBy(*key).agg(F.min(packed).alias("calib"))


def with_calibration(df: DataFrame, calib: DataFrame, key) -> DataFrame:
    """Join each raw row to its device's coefficients, kept in struct ``calib``.

    A device with several rows of coefficients gets the smallest of them, so that
    readings never multiply; readings of a device without any are left out, see
    ``uncalibrated``.
    """
    key = as_list(key)
    return df.join(_coefficients(calib, key), key, "inner")


def uncalibrated(df: DataFrame, calib: DataFrame, key) -> DataFrame:
    """The devices whose readings ``with_calibration`` leaves out, with how many these are.

    Readings are counted per device before they meet the coefficients. A NULL device has none.
    """
    key = as_list(key)
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(calib.select(*key).distinct(), key, "left_anti")


def registry_flag(
    df: DataFrame, registry: DataFrame, key, pid: int = EXPECTED_PID, out: str = "accepted"
) -> DataFrame:
    """Mark the rows of devices whose registered product id is ``pid``, in one pass."""
    key = as_list(key)
    good = registry.where(F.col("pid") == pid).select(*key).distinct().withColumn(out, F.lit(True))
    return df.join(good, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def registry_check(
    df: DataFrame, registry: DataFrame, key, pid: int = EXPECTED_PID
) -> tuple[DataFrame, DataFrame]:
    """(rows of devices whose registered product id is ``pid``, all others).

    Two results cost two passes; ``registry_flag`` tells them apart in one.
    """
    flagged = registry_flag(df, registry, key, pid, "_accepted")
    return flagged.where("_accepted").drop("_accepted"), flagged.where("NOT _accepted").drop("_accepted")


def score_vs_label(pred: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """Prediction next to the true label."""
    return pred.join(labels, id, "inner")
