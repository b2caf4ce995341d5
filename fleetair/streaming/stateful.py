"""Ordered per-key processing that can be chained: one row at a time, state in a store.

Rows arrive in any order within the watermark and wait in the state of their key, by
slots of time. A timer of the key stands at its earliest waiting row. When the watermark passes it,
the slots are read one after the other, the rows that the watermark has passed go on in
order, and what the next rows need is left as a few values. So a key's rows are never
together: a read has the rows of one slot that still wait. What comes out has times
between two watermarks, and therefore a further stateful operator can follow in the same query.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetair.plans.timeline import as_list

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

#: Milliseconds of a slot.
SLOT_MS = 86_400_000

# (a row, carried values or None) -> (output rows, values to carry)
Step = Callable[[Row, tuple | None], tuple[list[tuple], tuple | None]]


def use_state_store(spark: SparkSession) -> None:
    """Timers and maps need the store that keeps state on disk."""
    if spark.conf.get(_STORE, None) != _ROCKSDB:
        spark.conf.set(_STORE, _ROCKSDB)


def _due(us: int) -> int:
    """The first millisecond at which a time in microseconds is past."""
    return -(-us // 1000)


def _plain(value):
    """A value from the state as the state takes it again: rows as tuples."""
    if isinstance(value, tuple):
        return tuple(_plain(v) for v in value)
    return [_plain(v) for v in value] if isinstance(value, list) else value


class InOrder(StatefulProcessor):
    """Hands a key's rows to ``step`` in the order of ``place``, column names of which the
    first is the time in microseconds. ``out`` are the output's columns; ``_us`` becomes the last, a time."""

    def __init__(self, row: T.StructType, carried: T.StructType, out: T.StructType, place: list[str], step: Step, slot_ms: int):
        self.row, self.carried_schema, self.place, self.step, self.slot_ms = row, carried, place, step, slot_ms
        self.out, self.time = Row(*out.names), out.names.index("_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", T.StructType().add("rows", T.ArrayType(self.row)))
        self.index = handle.getValueState("index", "slots array<long>, timer long")
        self.carried = handle.getValueState("carried", self.carried_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[int, list[tuple]] = {}
        for r in rows:
            fresh.setdefault(_due(r[self.place[0]]) // self.slot_ms, []).append(tuple(r[name] for name in self.row.names))
        slots, timer = self.index.get() if self.index.exists() else ([], None)
        for slot, some in fresh.items():
            held = _plain(self.waiting.getValue((slot,))[0]) if slot in slots else []
            self.waiting.updateValue((slot,), ([*held, *some],))
        at = self.row.names.index(self.place[0])
        first = min(_due(r[at]) for r in fresh[min(fresh)])
        self._set(sorted({*slots, *fresh}), timer, first if timer is None else min(first, timer))
        return iter(())

    def _set(self, slots: list[int], timer: int | None, first: int | None) -> None:
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.index.update((slots, first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit, (slots, _) = timerValues.getCurrentWatermarkInMs(), self.index.get()
        carried = _plain(self.carried.get()) if self.carried.exists() else None
        at, make, left, first = self.row.names.index(self.place[0]), Row(*self.row.names), [], None
        for slot in sorted(slots):
            if slot * self.slot_ms > limit:
                left.append(slot)
                first = slot * self.slot_ms if first is None else first
                continue
            rows = _plain(self.waiting.getValue((slot,))[0])
            rest = [r for r in rows if _due(r[at]) > limit]
            if rest:
                left.append(slot)
                first = min(_due(r[at]) for r in rest) if first is None else first
                self.waiting.updateValue((slot,), (rest,))
            else:
                self.waiting.removeKey((slot,))
            ready = [make(*r) for r in rows if _due(r[at]) <= limit]
            # NULL comes first, as in Spark's order.
            for r in sorted(ready, key=lambda r: [(r[c] is not None, 0 if r[c] is None else r[c]) for c in self.place]):
                out, carried = self.step(r, carried)
                for values in out:
                    yield self.out(*values, _EPOCH + timedelta(microseconds=values[self.time]))
        if carried is not None:
            self.carried.update(carried)
        self._set(left, None, first)

    def close(self) -> None:
        pass


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def in_order(
    df: DataFrame, key, ts: str, tie: list[str], step: Step, carried: T.StructType, output: T.StructType,
    watermark: str | None, slot_ms: int = SLOT_MS,
) -> DataFrame:
    """Run ``step`` over each key's rows of a stream in (``ts``, ``tie``) order.

    ``step`` reads the columns of ``df`` but ``ts``, which comes as microseconds in ``_us``,
    and gives tuples of ``output``, where ``_us`` is the time of the row it is at; the result has it as
    ``ts``. ``watermark`` is None where ``df`` has one already, as the result of another
    stateful operator has. A row without a time has no place in the order and is left out; callers
    count those before they get here.
    """
    use_state_store(df.sparkSession)
    timed = df.where(F.col(ts).isNotNull())
    timed = timed.withWatermark(ts, watermark) if watermark else timed
    rows = timed.withColumn("_us", micros(ts))
    row = T.StructType([f for f in rows.schema.fields if f.name != ts])
    sent = T.StructType([*output.fields, T.StructField(ts, T.TimestampType())])
    processor = InOrder(row, carried, sent, ["_us", *tie], step, slot_ms)
    return rows.groupBy(*as_list(key)).transformWithState(processor, sent, "Append", "EventTime", eventTimeColumnName=ts).drop("_us")
