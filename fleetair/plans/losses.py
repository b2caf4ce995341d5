"""Counts of what a job takes in, keeps and drops, by reason, taken while it runs.

On tables the counts are metrics of the plan itself, so they cost no pass of their own.
On streams the same metrics come with every progress report, and so does what stateful
operators dropped for being late; a listener adds them up.
"""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

IN, KEPT, LATE = "in", "kept", "late"


def _metrics(reasons: Mapping[str, Column]) -> list[Column]:
    """Rows in, and rows per reason; a row counts for the first reason that holds."""
    first = F.coalesce(*[F.when(c, F.lit(r)) for r, c in reasons.items()], F.lit(None).cast("string"))
    return [F.count(F.lit(1)).alias(IN), *[F.count(F.when(first == r, 1)).alias(r) for r in reasons]]


class Losses:
    """Watches stages of a job; the report is complete when the job is.

    ``watch`` goes where the rows that are about to be dropped still are, with the conditions
    by which they go. In every report rows in are rows kept plus rows dropped.
    """

    def __init__(self) -> None:
        self._tables: dict[str, Observation] = {}
        self._streams: set[str] = set()
        self._reasons: dict[str, list[str]] = {}
        self._listener = _Listener()

    def watch(self, df: DataFrame, stage: str, reasons: Mapping[str, Column]) -> DataFrame:
        if stage in self._reasons:
            raise ValueError(f"stage {stage!r} is watched already")
        self._reasons[stage] = list(reasons)
        if df.isStreaming:
            self._streams.add(stage)
            return df.observe(stage, *_metrics(reasons))
        self._tables[stage] = Observation(stage)
        return df.observe(self._tables[stage], *_metrics(reasons))

    def listen(self, spark: SparkSession) -> None:
        """Before a stream starts: follow what it reports."""
        spark.streams.addListener(self._listener)

    def finish(self, query: StreamingQuery) -> None:
        """Wait for a stream and for its last report."""
        query.awaitTermination()
        self._listener.ended[str(query.runId)].wait(60)

    def stop(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self._listener)

    def report(self, spark: SparkSession) -> DataFrame:
        """``stage, reason, rows``: rows in, kept, and per reason; a row each, zeros too.

        Late rows come after a stream's other reasons and count against the stage watched last before them.
        """
        rows = []
        for stage, reasons in self._reasons.items():
            found = self._listener.observed[stage] if stage in self._streams else Counter(self._tables[stage].get)
            lost = {r: found[r] for r in reasons}
            if stage in self._streams:
                lost[LATE] = self._listener.late[stage]
            rows += [(stage, IN, found[IN]), (stage, KEPT, found[IN] - sum(lost.values())), *((stage, r, n) for r, n in lost.items())]
        return spark.createDataFrame(rows, "stage string, reason string, rows long")


class _Listener(StreamingQueryListener):
    def __init__(self) -> None:
        self.observed: defaultdict[str, Counter] = defaultdict(Counter)
        self.late: Counter = Counter()
        self.ended: defaultdict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        stages = list(progress.observedMetrics)
        for stage in stages:
            self.observed[stage].update(progress.observedMetrics[stage].asDict())
        if stages:
            self.late[stages[-1]] += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()
