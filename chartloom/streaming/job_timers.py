"""Runs of jobs that do not end in time, found by event-time timers.

A run begins with a ``start`` event.  If no other start and no end of the job
follows within the limit, the run has timed out.  State keeps the starts and
ends of a job that a running timer may still ask for; it goes when a timer
has fired, so it is bounded by the events of one job within the limit, the
watermark's delay and a batch.  They are kept as packed arrays, one an input batch,
and a timer settles all runs that are due: a job costs what sorting its events costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ENDS = ["complete", "fail", "cancel"]
RESULT = "job_id long, event_id long, started_ms long, failed_ms long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events (time, id, whether a run begins, whether it has an id) that are packed into one element of the state.
PACKED = 1 << 14


class RunTimer(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "marks binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, first = [], None
        for r in rows:
            held.append((r.at, r.event_id or 0, r.event == "start", r.event_id is not None))
            first = r.at if first is None else min(first, r.at)
            if len(held) == PACKED:
                self.seen.appendValue(_packed(held))
                held = []
        if held:
            self.seen.appendValue(_packed(held))
        if first is not None:
            # an end is kept as long as the run of a start before it may be asked for
            self.handle.registerTimer(first + self.limit_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        parts = [np.frombuffer(p[0], np.int64).reshape(-1, 4) for p in self.seen.get()]
        if not parts:
            return
        # the same event in two batches counts once
        marks = np.unique(np.concatenate(parts), axis=0)
        at, event_id, begins, named = marks.T
        due = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) - self.limit_ms
        later = np.searchsorted(at, at, "right")  # the first mark after each moment
        followed = (later < len(at)) & (at[np.minimum(later, len(at) - 1)] - at <= self.limit_ms)
        settled = at <= due
        for i in np.flatnonzero(settled & (begins == 1) & ~followed).tolist():
            yield Row(job_id=key[0], event_id=int(event_id[i]) if named[i] else None, started_ms=int(at[i]), failed_ms=int(at[i]) + self.limit_ms)
        # nothing asks for these moments again
        kept = marks[~settled]
        if len(kept):
            self.seen.put([(np.ascontiguousarray(kept[i:i + PACKED]).tobytes(),) for i in range(0, len(kept), PACKED)])
            self.handle.registerTimer(int(kept[0, 0]) + self.limit_ms)
        else:
            self.seen.clear()

    def close(self) -> None:
        pass


def _packed(marks: list[tuple[int, int, bool, bool]]) -> tuple[bytes]:
    return (np.array(marks, np.int64).tobytes(),)


def time_out_runs(events: DataFrame, out_path: str, checkpoint: str, limit_seconds: int, watermark: str = "1 hour"):
    """Append (job_id, event_id, started_ms, failed_ms) of every run that timed out; returns the streaming query.

    ``events`` is a stream of event_id, job_id, ts, event.  A run is reported once
    the watermark has passed its limit.  Files and rows may come in any order
    within the watermark's delay; a row that comes later is not looked at.
    """
    spark = events.sparkSession
    rows = events.filter(F.col("event").isin("start", *ENDS)).filter("job_id IS NOT NULL AND ts IS NOT NULL").select(
        "job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event")
    rows = rows.withColumn("at", F.unix_millis("ts")).withWatermark("ts", watermark)
    late = rows.groupBy("job_id").transformWithState(RunTimer(limit_seconds * 1000), RESULT, "Append", "EventTime")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # read when the query starts
    try:
        return (late.writeStream.outputMode("append").format("parquet").option("path", out_path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
