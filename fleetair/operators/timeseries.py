"""Ordered and windowed functions over sensor time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetair.plans.joins import MAX_BROADCAST_BYTES
from fleetair.plans.scratch import written
from fleetair.plans.timeline import (
    Slices,
    Timeline,
    as_list,
    first_per_group,
    position,
)

_US = 1_000_000


def order_by_sequence(
    df: DataFrame, key, idx: str, read: str, slot: str, fresh: str,
    slices: Slices | None = None,
) -> DataFrame:
    """Order frames by an 8-bit index that wraps from 255 to 0.

    ``read`` orders the captures of a device and ``slot`` the frames in one.
    Adds ``seq_index``, the index with the wraps undone (each fresh frame moves
    it by the shorter way round the circle), and ``seq_pos``, the place within
    the capture: fresh frames first, oldest first. Stale frames have no index.
    """
    key = as_list(key)
    value = F.when(F.col(fresh), F.col(idx).cast("long"))
    step = F.pmod(value - F.col("_prev") + 128, F.lit(256)) - 128
    line = Timeline(df, key, [read, slot], slices).walk(
        prev={"_prev": value}, among=value.isNotNull(),
        derive={"_step": F.coalesce(step, value)}, total={"_seq": F.col("_step")})
    line = line.with_columns(seq_index=F.when(F.col(fresh), F.col("_seq")))
    w = Window.partitionBy(*key, read).orderBy(F.col("seq_index").asc_nulls_last(), slot)
    return line.with_columns(seq_pos=F.row_number().over(w)).result("_prev", "_step", "_seq")


def sample_counter(
    df: DataFrame, key, order, name: str = "sample_no", slices: Slices | None = None
) -> DataFrame:
    """Number the samples of each key from 1."""
    return Timeline(df, key, order, slices).scan(total={name: F.lit(1)}).result()


def cadence_sample(df: DataFrame, key, ts: str, seconds: int, order=None) -> DataFrame:
    """The first row of each key in every interval of a fixed grid."""
    key = as_list(key)
    grid = F.floor(position(df, ts) / F.lit(seconds * _US)).cast("long")
    gridded = df.withColumn("grid", grid)
    return first_per_group(gridded, [*key, "grid"], as_list(order or ts))


def cadence_exact(
    df: DataFrame, key, ts: str, seconds: float, order=None, slices: Slices | None = None
) -> DataFrame:
    """Take a row only once its time has reached the next call, ``seconds`` after the last row taken.

    What is taken depends on all that went before, yet no device is walked row by row.
    Every row points to the first row that could be taken after it. The pointers are composed with
    themselves, so that each time they reach twice as far, and the rows known to be taken
    pass them on: after k rounds the first 2^k are known. Rows are joined by
    device and number, so a hot device is spread like any other. Rows without a time are not taken.
    """
    key, order = as_list(key), as_list(order or ts)
    step = round(seconds * _US)
    numbered = Timeline(df.where(F.col(ts).isNotNull()), key, order, slices).scan(total={"_n": F.lit(1)}).result()
    numbered = written(numbered.withColumn("_us", position(numbered, ts)), "numbered")
    # How many rows lie before the next call, which stands before a row of its own time.
    moves = F.array(*[F.struct(at.alias("_at"), F.lit(kind).alias("_kind")) for at, kind in ((F.col("_us"), 1), (F.col("_us") + step, 0))])
    events = numbered.select(*key, "_n", F.explode(moves).alias("_m")).select(*key, "_n", "_m.*")
    line = Timeline(events, key, ["_at", "_kind", "_n"]).scan(total={"_rows": F.when(F.col("_kind") == 1, 1)})
    jump = written(line.df.where("_kind = 0").select(*key, "_n", (F.coalesce("_rows", F.lit(0)) + 1).alias("_next")), "jump")

    def follow(rows: DataFrame, at: str, jumps: DataFrame, *keep: str) -> DataFrame:
        """Rows whose column ``at`` is a row with a pointer, and where that leads."""
        b = jumps.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_n").alias("_from"), F.col("_next").alias("_to"))
        same = rows[at] == b["_from"]
        for i, k in enumerate(key):
            same = same & rows[k].eqNullSafe(b[f"_k{i}"])
        return rows.join(b, same).select(*key, *keep, F.col("_to"))

    taken = [numbered.where("_n = 1").select(*key, "_n")]
    while True:
        reached = reduce(DataFrame.union, taken)
        more = written(follow(reached, "_n", jump).withColumnRenamed("_to", "_n"), "taken")
        if more.isEmpty():
            break
        taken.append(more)
        jump = written(follow(jump, "_next", jump, "_n").withColumnRenamed("_to", "_next"), "jump")
    chosen = reached.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_n").alias("_taken"))
    same = numbered["_n"] == chosen["_taken"]
    for i, k in enumerate(key):
        same = same & numbered[k].eqNullSafe(chosen[f"_k{i}"])
    return numbered.join(chosen, same, "left_semi").select(*df.columns)


def cadence_violations(
    df: DataFrame, key, ts: str, seconds: float, tol: float,
    order=None, slices: Slices | None = None,
) -> DataFrame:
    """Rows whose gap to the one before differs from ``seconds`` by more than ``tol``."""
    line = Timeline(df, key, as_list(order or ts), slices)
    line = line.with_columns(_us=position(df, ts)).scan(lag={"_prev": F.col("_us")})
    gap = (F.col("_us") - F.col("_prev")) / F.lit(float(_US))
    line = line.with_columns(gap_s=gap)
    return line._with(line.df.where(F.abs(F.col("gap_s") - seconds) > tol)).result("_us", "_prev")


def cadence_summary(violations: DataFrame, key) -> DataFrame:
    """Violations per key with the shortest and longest gap."""
    return violations.groupBy(*as_list(key)).agg(
        F.count(F.lit(1)).alias("violations"),
        F.min("gap_s").alias("min_gap_s"),
        F.max("gap_s").alias("max_gap_s"),
    )


def trailing_means(df: DataFrame, key, ts: str, widths: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Means over the trailing ``[t - width, t]`` of each row.

    ``widths`` maps a column to {output name: seconds}. A sliding frame sums its whole
    content again for every row, which for eight hours of three-second samples is ten
    thousand additions per row. Here time is cut into blocks of a width each. The
    window that ends at t has the rows of t's block up to t, a sum that runs
    forwards in the block, and the rows of the block before from t - width on, a sum that runs
    backwards there. Both are sums of rows of the window alone: nothing is subtracted, so values
    of any size can follow each other, and a row costs the same whatever the width. A device
    is cut at its blocks, however hot. Values that are not finite count as missing; rows without a
    time have no mean.
    """
    key = as_list(key)
    all_widths = sorted({s for outs in widths.values() for s in outs.values()})
    rest = [c for c in df.columns if c not in key]
    finite = {c: F.col(c).cast("double") for c in widths}
    rows = df.select(
        *key, F.struct(*rest).alias("_row"), position(df, ts).alias("_t"), F.monotonically_increasing_id().alias("_id"),
        *[F.when(F.abs(v) < float("inf"), v).alias(f"_v_{c}") for c, v in finite.items()],
    )
    t = F.col("_t")
    # A row stands in its own block, and where its window begins a probe in the block before.
    # A block is a microsecond longer than the width, since a window has both its ends.
    events = F.array(*[
        F.struct(F.lit(s).alias("w"), block.alias("block"), at.alias("at"), F.lit(own).alias("own"))
        for s in all_widths for start in [t - F.pmod(t, F.lit(s * _US + 1))]
        for block, at, own in ((start, t, True), (start - (s * _US + 1), t - s * _US, False))
    ])
    spread = rows.select("*", F.posexplode(events).alias("_i", "_e")).select(
        *key, "_id", "_e.*", F.when(F.col("_i") == 0, F.col("_row")).alias("_row"),
        *[F.when(F.col("_e.own"), F.col(f"_v_{c}")).alias(f"_v_{c}") for c in widths],
    )
    w = Window.partitionBy(*key, "w", "block")
    sums = {}
    for c in widths:
        for name, what in (("s", F.sum), ("n", F.count)):
            forward, back = (what(f"_v_{c}").over(w.orderBy(at)) for at in (F.col("at"), F.col("at").desc()))
            sums[f"_{name}_{c}"] = F.when(F.col("own"), forward).otherwise(back)
    parts = spread.withColumns(sums).groupBy(*key, "_id").agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.first("at", ignorenulls=True).alias("_any"),
        *[F.sum(F.when(F.col("w") == s, F.col(f"_{k}_{c}"))).alias(f"_{k}_{c}_{s}")
          for c, outs in widths.items() for s in set(outs.values()) for k in "sn"],
    )
    means = [
        F.when(F.col("_any").isNotNull() & (F.col(f"_n_{c}_{s}") > 0), F.col(f"_s_{c}_{s}") / F.col(f"_n_{c}_{s}")).alias(name)
        for c, outs in widths.items() for name, s in outs.items()
    ]
    columns = [F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns]
    return parts.select(*columns, *means)


# How many rows a block of a re-cut hot key holds.
BLOCK_ROWS = 100_000


def log_resistance_stats(
    df: DataFrame, key, order, cols: Sequence[str], rows: int,
    slices: Slices | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean and variance of ln(resistance) over the last ``rows`` rows.

    Values without a logarithm (zero, negative, NULL) are left out of both.

    Hot keys are numbered and re-cut into blocks, each of which also receives
    the ``rows - 1`` rows before it, so a frame never leaves its block.
    """
    key, order = as_list(key), as_list(order)
    line = Timeline(df, key, order, slices)
    if line.hot:
        block = max(block_rows, rows)
        numbered = line.scan(total={"_n": F.lit(1)}).result()
        own = F.floor((F.col("_n") - 1) / F.lit(block)).cast("long")
        tail = (F.col("_n") - 1) % block >= block - (rows - 1)
        copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
        table = numbered.withColumn("_block", F.explode(copies)).withColumn(
            "_context", F.col("_block") != own
        )
        frame = Window.partitionBy(*key, "_block").orderBy("_n")
    else:
        table = df.withColumn("_context", F.lit(False))
        frame = Window.partitionBy(*key).orderBy(*order)
    frame = frame.rowsBetween(-(rows - 1), Window.currentRow)
    logs = {c: F.when(F.col(c) > 0, F.ln(F.col(c))) for c in cols}
    out = table.withColumns({
        **{f"{c}_log_mean": F.avg(v).over(frame) for c, v in logs.items()},
        **{f"{c}_log_var": F.var_pop(v).over(frame) for c, v in logs.items()},
    })
    return out.where(~F.col("_context")).drop("_context", "_block", "_n")


CLOCK_RANGE = 1 << 32


def boot_segments(
    df: DataFrame, key, order, ms: str, margin_ms: int = 3_600_000,
    slices: Slices | None = None,
) -> DataFrame:
    """Undo the resets of a 32-bit since-boot clock.

    A drop starts a new boot, unless it goes from the last ``margin_ms`` of the
    range to the first, which is the clock wrapping. Adds ``boot_id`` from 1 and
    ``boot_ms``, which only grows within a boot.
    """
    drop = F.coalesce(F.col(ms) < F.col("_prev"), F.lit(False))
    wrap = drop & (F.col("_prev") >= CLOCK_RANGE - margin_ms) & (F.col(ms) < margin_ms)
    line = Timeline(df, key, order, slices).walk(
        prev={"_prev": F.col(ms)},
        derive={"_wrap": wrap.cast("long"), "_boot": (drop & ~wrap).cast("long")},
        total={"_boots": F.col("_boot"), "_wraps": F.col("_wrap")},
        snap={"_base": (F.col("_boot") == 1, "_wraps")},
    )
    wraps = F.col("_wraps") - F.coalesce(F.col("_base"), F.lit(0))
    line = line.with_columns(
        boot_id=F.col("_boots") + 1, boot_ms=F.col(ms) + wraps * F.lit(CLOCK_RANGE)
    )
    return line.result("_prev", "_wrap", "_boot", "_boots", "_wraps", "_base")


# Bits of the number of bands in a page: a row is compared with the bands of one page.
PAGE_BITS = 6


def _paged(breakpoints: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The bands in their order with the number of their page, and each page's number and first ``lo``."""
    names = ["lo", "hi", "index_lo", "index_hi"]
    bands = breakpoints.select(*[F.col(c).cast("double").alias(c) for c in names]).where("lo < hi").orderBy(*names)
    # Numbers ascend with the order, and a partition's begin where a page does.
    bands = written(bands.withColumn("_of", F.shiftright(F.monotonically_increasing_id(), PAGE_BITS)), "bands")
    pages = bands.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("b"))
    overlap = F.exists(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.get("b", i)["hi"] > F.get("b", i + 1)["lo"])
    found = pages.select(
        "_of", F.get("b", F.lit(0))["lo"].alias("lo"), F.element_at("b", -1)["hi"].alias("hi"),
        F.coalesce(overlap, F.lit(False)).alias("overlap")).toArrow().sort_by("_of")
    lo, hi = found["lo"].to_numpy(), found["hi"].to_numpy()
    # What is not a number is above all numbers.
    if found["overlap"].to_numpy().any() or not (hi[:-1] <= lo[1:]).all():
        raise ValueError("bands overlap")
    return bands, found["_of"].to_numpy(), lo


def aqi_band(df: DataFrame, value: str, breakpoints: DataFrame, out: str = "aqi") -> DataFrame:
    """Index of a concentration by a table of bands, linear inside each.

    ``breakpoints`` has lo, hi, index_lo, index_hi; a band covers lo <= x < hi. Bands that
    overlap end the query, those that cover nothing are left out. The bands are sorted and cut into pages;
    the driver has where each page begins, a row finds its page by binary search and is joined
    with the one band in it that covers it. Rows do not move unless the bands are
    too many to be sent to every executor. NULL outside every band.
    """
    bands, pages, starts = _paged(breakpoints)

    @F.arrow_udf("long")
    def page(x: pa.Array) -> pa.Array:
        at = np.searchsorted(starts, x.to_numpy(zero_copy_only=False), "right") - 1
        return pa.array(pages[at] if len(pages) else at, mask=at < 0)

    bands = bands.select("_of", *[F.col(c).alias(f"_{c}") for c in ("lo", "hi", "index_lo", "index_hi")])
    # The rows of a broadcast table have eight bytes for each column and as many for themselves and their place.
    if (len(pages) << PAGE_BITS) * 64 <= MAX_BROADCAST_BYTES:
        bands = F.broadcast(bands)
    x = F.col("_x")
    rows = df.withColumn("_x", F.col(value).cast("double")).withColumn("_page", F.when(x.isNotNull(), page(x)))
    joined = rows.join(bands, (F.col("_page") == F.col("_of")) & (x >= F.col("_lo")) & (x < F.col("_hi")), "left")
    share = (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    index = F.col("_index_lo") + share * (F.col("_index_hi") - F.col("_index_lo"))
    return joined.withColumn(out, index).drop("_x", "_page", *bands.columns)


def label_intervals(
    df: DataFrame, key, order, label: str, ts: str | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Collapse a label history into intervals with their first and last time."""
    key, order = as_list(key), as_list(order)
    ts = ts or order[0]
    line = Timeline(df.select(*dict.fromkeys([*key, *order, label, ts])), key, order, slices)
    # The first row has no row before it; any other has one, if with a NULL label.
    starts = F.col("_prev").isNull() | ~F.col(label).eqNullSafe(F.col("_prev.label"))
    line = line.walk(
        prev={"_prev": F.struct(F.col(label).alias("label"))},
        derive={"_start": starts.cast("long")}, total={"interval_no": F.col("_start")})
    return line.df.groupBy(*key, "interval_no").agg(
        F.max(label).alias(label),
        F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"),
        F.count(F.lit(1)).alias("rows"),
    )
