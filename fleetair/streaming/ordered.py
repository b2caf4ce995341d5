"""Ordered per-key processing of a stream, in event-time order.

Rows arrive in any order within the watermark. Each key buffers its rows until
the watermark passes them, then handles them sorted; what the next rows need is
carried as a few rows. So the result does not depend on how the input was cut
into batches, and equals that of the batch operator on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetair.plans.timeline import as_list

# (rows in order, carried rows or None) -> (output rows, rows to carry)
Step = Callable[[pd.DataFrame, pd.DataFrame | None], tuple[pd.DataFrame, pd.DataFrame]]


def ordered_stream(
    df: DataFrame, key, ts: str, tie: list[str], watermark: str, step: Step,
    output: T.StructType,
) -> DataFrame:
    """Run ``step`` over each key's rows in (``ts``, ``tie``) order.

    ``step`` must be a closure over plain values: it travels to the executors by
    value. The buffer of a key holds at most one watermark delay of rows plus
    one batch. Rows without a time have no place in the order and are left out.
    """
    keys, order = as_list(key), [ts, *tie]

    def pack(rows: pd.DataFrame | None) -> bytes | None:
        if rows is None or rows.empty:
            return None
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def unpack(data: bytes | None) -> pd.DataFrame | None:
        return None if data is None else pa.ipc.open_stream(data).read_pandas()

    def advance(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, carried = state.get if state.exists else (None, None)
        parts = [unpack(pending), *batches]
        parts = [p for p in parts if p is not None and not p.empty]
        limit = state.getCurrentWatermarkMs()
        rest = None
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            # Spark drops input at or before the watermark, so this part is complete.
            done = rows[ts] <= pd.Timestamp(limit, unit="ms")
            ready, rest = rows[done].sort_values(order, kind="stable"), rows[~done]
            if not ready.empty:
                out, kept = step(ready.reset_index(drop=True), unpack(carried))
                carried = pack(kept)
                if not out.empty:
                    yield out[names]
        state.update((pack(rest), carried))
        if rest is not None and not rest.empty:
            first_ms = rest[ts].min().value // 1_000_000
            state.setTimeoutTimestamp(max(limit, first_ms - 1, 1))

    names = output.fieldNames()
    return (
        df.where(F.col(ts).isNotNull())
        .withWatermark(ts, watermark)
        .groupBy(*keys)
        .applyInPandasWithState(
            advance, output, "pending binary, carried binary", "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
