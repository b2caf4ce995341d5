"""The batch operators on streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetair.functions.scoring import Layer
from fleetair.operators.ml import fetched, score_readings
from fleetair.plans.timeline import Slices, Timeline, as_list
from fleetair.schema import DEFAULT_LABEL, FEATURES, UNLABELED_NAME
from fleetair.streaming.ordered import ordered_stream
from fleetair.streaming.stateful import in_order


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def stream_pair(
    df: DataFrame, key, ts: str, id: str, side: str, a_cols: list[str], b_cols: list[str],
    watermark: str = "1 minute",
) -> DataFrame:
    """``pair_latest`` on a stream; a pair comes out once the watermark passes it."""
    keys = as_list(key)

    def step(rows: pd.DataFrame, carried: pd.DataFrame | None):
        # The carried rows (latest of each side) precede; they emit nothing new.
        n_old = 0 if carried is None else len(carried)
        streak = np.zeros(n_old, dtype=np.int64) if carried is None else carried["_streak"].to_numpy()
        table = rows if carried is None else pd.concat([carried.drop(columns="_streak"), rows], ignore_index=True)
        sides = table[side].to_numpy()
        at = np.arange(len(table))
        # Position within the streak of side changes; 0 on a row that keeps its side.
        change = np.concatenate([[False], sides[1:] != sides[:-1]])
        change[:n_old] = False
        kept = np.where(change, -1, at)
        if n_old:
            kept[n_old - 1] = n_old - 1 - streak[-1]
        kept = np.maximum.accumulate(kept)
        position = at - kept
        emits = change & (position % 2 == 1)
        latest_a = np.maximum.accumulate(np.where(sides == "A", at, -1))
        latest_b = np.maximum.accumulate(np.where(sides == "B", at, -1))
        hit = np.flatnonzero(emits)
        a, b = table.iloc[latest_a[hit]], table.iloc[latest_b[hit]]
        out = table.iloc[hit][[*keys, id]].reset_index(drop=True)
        out[ts] = np.maximum(a[ts].to_numpy(), b[ts].to_numpy())
        for c in a_cols:
            out[c] = a[c].to_numpy()
        for c in b_cols:
            out[c] = b[c].to_numpy()
        last = sorted(i for i in {latest_a[-1], latest_b[-1]} if i >= 0)
        keep = table.iloc[last].copy()
        keep["_streak"] = position[-1] % 2
        return out, keep

    needed = list(dict.fromkeys([*keys, ts, id, side, *a_cols, *b_cols]))
    rows = df.where(F.col(side).isin("A", "B")).select(*needed)
    output = T.StructType(_fields(df, [*keys, ts, id, *a_cols, *b_cols]))
    return ordered_stream(rows, keys, ts, [id], watermark, step, output)


def stream_label(
    df: DataFrame, commands: DataFrame, key, ts: str, id: str, watermark: str = "1 minute"
) -> DataFrame:
    """``label_asof`` on a stream of readings and a stream of commands.

    ``id`` orders rows of one time in both; a command goes before a reading.
    """
    keys = as_list(key)
    own = [c for c in df.columns if c not in ("label", "event_name")]
    default_label, default_name = DEFAULT_LABEL, UNLABELED_NAME

    def step(rows: pd.DataFrame, carried: pd.DataFrame | None):
        table = rows if carried is None else pd.concat([carried, rows], ignore_index=True)
        is_command = (table["_kind"] == 0).to_numpy()
        at = np.maximum.accumulate(np.where(is_command, np.arange(len(table)), -1))
        hit = np.flatnonzero(~is_command)
        given = at[hit] >= 0
        state = table.iloc[np.maximum(at[hit], 0)]
        out = table.iloc[hit][own].reset_index(drop=True)
        out["label"] = np.where(given, state["label"].to_numpy(), default_label).astype("int8")
        out["event_name"] = np.where(given, state["event_name"].to_numpy(), default_name)
        out["label_source"] = np.where(given, "command", "default")
        return out, table.iloc[[at[-1]]] if at[-1] >= 0 else table.iloc[:0]

    readings = df.select(*own).withColumns({
        "label": F.lit(None).cast("tinyint"), "event_name": F.lit(None).cast("string"),
        "_kind": F.lit(1),
    })
    labels = commands.select(*keys, ts, id, "label", "event_name").withColumn("_kind", F.lit(0))
    both = readings.unionByName(labels, allowMissingColumns=True)
    output = T.StructType([
        *_fields(df, own), T.StructField("label", T.ByteType()),
        T.StructField("event_name", T.StringType()), T.StructField("label_source", T.StringType()),
    ])
    return ordered_stream(both, keys, ts, ["_kind", id], watermark, step, output)


def chained_pair(
    df: DataFrame, key, ts: str, id: str, side: str, a_cols: list[str], b_cols: list[str],
    watermark: str | None = "1 minute",
) -> DataFrame:
    """``stream_pair`` row by row, so that another stateful operator can follow it.

    What is kept of a device is the latest row of each side and whether it is used up.
    """
    keys = as_list(key)
    needed = list(dict.fromkeys([*keys, ts, id, side, *a_cols, *b_cols]))
    fields = [*_fields(df, [*keys, id]), T.StructField("_us", T.LongType()), *_fields(df, [*a_cols, *b_cols])]

    def step(row, carried):
        a, b, new_a, new_b = carried or (None, None, False, False)
        if row[side] == "A":
            a, new_a = tuple(row[c] for c in a_cols), True
        else:
            b, new_b = tuple(row[c] for c in b_cols), True
        if not (new_a and new_b):
            return [], (a, b, new_a, new_b)
        # This row is the later one, so the pair has its time.
        return [(*(row[k] for k in keys), row[id], row["_us"], *a, *b)], (a, b, False, False)

    sides = [T.StructType(_fields(df, cols)) if cols else T.StructType().add("_", "int") for cols in (a_cols, b_cols)]
    carried = T.StructType([
        T.StructField("a", sides[0]), T.StructField("b", sides[1]),
        T.StructField("new_a", T.BooleanType()), T.StructField("new_b", T.BooleanType())])
    rows = df.where(F.col(side).isin("A", "B")).select(*needed)
    return in_order(rows, keys, ts, [id], step, carried, T.StructType(fields), watermark)


def chained_label(
    df: DataFrame, commands: DataFrame, key, ts: str, id: str, watermark: str | None = "1 minute"
) -> DataFrame:
    """``stream_label`` row by row; ``df`` may be the result of ``chained_pair``.

    ``watermark`` is that of the commands; ``df`` has its own. What is kept of a device is the command in force.
    """
    keys = as_list(key)
    own = [c for c in df.columns if c not in ("label", "event_name", ts)]
    default = (DEFAULT_LABEL, UNLABELED_NAME, "default")

    def step(row, carried):
        if row["_kind"] == 0:
            return [], (row["label"], row["event_name"])
        given = (*carried, "command") if carried else default
        return [(*(row[c] for c in own), row["_us"], *given)], carried

    readings = df.select(*own, ts).withColumns({
        "label": F.lit(None).cast("tinyint"), "event_name": F.lit(None).cast("string"), "_kind": F.lit(1)})
    timed = commands.withWatermark(ts, watermark) if watermark else commands
    labels = timed.select(*keys, ts, id, "label", "event_name").withColumn("_kind", F.lit(0))
    both = readings.unionByName(labels, allowMissingColumns=True)
    output = T.StructType([
        *_fields(df, own), T.StructField("_us", T.LongType()), T.StructField("label", T.ByteType()),
        T.StructField("event_name", T.StringType()), T.StructField("label_source", T.StringType())])
    carried = T.StructType([T.StructField("label", T.ByteType()), T.StructField("event_name", T.StringType())])
    return in_order(both, keys, ts, ["_kind", id], step, carried, output, None)


def stream_cadence(
    df: DataFrame, key, ts: str, id: str, seconds: float, watermark: str = "1 minute"
) -> DataFrame:
    """Take a row only once its time has reached the next call.

    The next call is ``seconds`` after the last row taken, so what is taken
    depends on all that went before; ``cadence_sample`` is the fixed-grid form.
    """
    keys = as_list(key)
    names, wait = df.columns, pd.Timedelta(seconds=seconds)

    def step(rows: pd.DataFrame, carried: pd.DataFrame | None):
        times = rows[ts].to_numpy()
        next_call = times[0] if carried is None else (carried[ts].iloc[0] + wait).to_datetime64()
        taken, i = [], int(np.searchsorted(times, next_call))
        while i < len(times):
            taken.append(i)
            i = int(np.searchsorted(times, times[i] + wait.to_timedelta64()))
        out = rows.iloc[taken][names]
        return out, out.tail(1) if taken else carried

    output = T.StructType(_fields(df, names))
    return ordered_stream(df, keys, ts, [id], watermark, step, output)


def stream_rollup(
    df: DataFrame, key, ts: str, cols: Sequence[str], kind: str = "tumbling",
    width: str = "1 minute", slide: str | None = None, gap: str = "5 minutes",
    watermark: str | None = "1 minute", slices: Slices | None = None,
) -> DataFrame:
    """Averages per key over tumbling, sliding or session windows.

    The same on a batch table (``watermark=None``) and on a stream.
    """
    if kind == "session" and not df.isStreaming:
        return _table_sessions(df, as_list(key), ts, cols, gap, slices)
    if kind == "tumbling":
        window = F.window(ts, width)
    elif kind == "sliding":
        window = F.window(ts, width, slide or "1 minute")
    elif kind == "session":
        window = F.session_window(ts, gap)
    else:
        raise ValueError(f"kind must be tumbling, sliding or session, not {kind!r}")
    source = df.withWatermark(ts, watermark) if watermark else df
    return source.groupBy(*as_list(key), window.alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"{c}_mean") for c in cols]
    ).select(*as_list(key), F.col("w.start").alias("start"), F.col("w.end").alias("end"),
             "rows", *[f"{c}_mean" for c in cols])


def _table_sessions(
    df: DataFrame, keys: list[str], ts: str, cols: Sequence[str], gap: str,
    slices: Slices | None,
) -> DataFrame:
    """Sessions of a whole table: ``session_window`` merges all rows of a key in
    one task, which a hot key of a table, unlike one of a micro-batch, overfills."""
    length = F.expr(f"INTERVAL '{gap}'")
    fresh = F.col("_prev").isNull() | (F.col(ts) > F.col("_prev") + length)
    # Rows of one time are one session, whichever of them comes first.
    line = Timeline(df, keys, ts, slices).walk(
        prev={"_prev": F.col(ts)}, derive={"_fresh": fresh.cast("long")},
        total={"_session": F.col("_fresh")}, peers=True)
    return line.df.groupBy(*keys, "_session").agg(
        F.min(ts).alias("start"), (F.max(ts) + length).alias("end"),
        F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"{c}_mean") for c in cols],
    ).drop("_session")


def stream_score(
    df: DataFrame, params: DataFrame, layers: Sequence[Layer], path: str, checkpoint: str,
    cols: Sequence[str] = FEATURES, available_now: bool = False,
) -> StreamingQuery:
    """Score every micro-batch and append it to ``path``. ``params`` is computed once,
    before the start.

    A batch owns the folder of its number and overwrites it, so a batch that is
    run again after a failure leaves its rows once.
    """
    params = fetched(params)

    def write(batch: DataFrame, number: int) -> None:
        scored = score_readings(batch, params, layers, cols)
        scored.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_dedup(df: DataFrame, key, ts: str, watermark: str = "1 minute") -> DataFrame:
    """Drop repeated time stamps of a key that arrive within the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([*as_list(key), ts])
