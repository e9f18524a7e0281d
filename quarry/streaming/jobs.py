"""Jobs as a stream of their events: the state of each job, and jobs that never end.

A job is queued, runs and ends.  An event never takes a job back; of two ends the later one counts; an event that is
sent again changes nothing.  A job that has not ended by `limit` after its last event fails, by a timer in event time,
so a stream that is run again from its checkpoint tells the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ledger import JOB_STATES

OUT = "run_id string, status string, micros long, ended boolean, timed_out boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the store that keeps timers
_END = 3


def _step(status: str | None) -> int:
    """1: queued, 2: runs, 3: ended; 0 for what is no state."""
    return min(JOB_STATES.index(status) + 1, _END) if status in JOB_STATES else 0


class JobStates(StatefulProcessor):
    """One small row of state for each job: how far it is, its status, when, and its timer."""

    def __init__(self, limit: timedelta):
        self.limit = limit // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "step int, status string, micros long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.job.get() if self.job.exists() else (0, None, None, None)
        best = tuple(old[:3])
        for r in rows:
            step = _step(r["status"])
            if step and r["micros"] is not None and (best[1] is None or (step, r["micros"], r["status"]) > (best[0], best[2], best[1])):
                best = (step, r["status"], r["micros"])
        if best[1] is None or best == tuple(old[:3]):
            return
        if old[3] is not None:
            self.handle.deleteTimer(old[3])
        timer = None
        if best[0] < _END:
            timer = max((best[2] + self.limit) // 1000, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        self.job.update((*best, timer))
        yield Row(run_id=key[0], status=best[1], micros=best[2], ended=best[0] == _END, timed_out=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        step, _, micros, _ = self.job.get()
        if step < _END:
            end = micros + self.limit
            self.job.update((_END, "failed", end, None))
            yield Row(run_id=key[0], status="failed", micros=end, ended=True, timed_out=True)

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, limit: timedelta, late: str = "1 hour") -> DataFrame:
    """(run_id, status, at, ended, timed_out): each change of a job's state, from a stream of (run_id, status, at); output mode update.

    The session's state store must be RocksDB (`ROCKSDB`).  Events later than the watermark are dropped.
    """
    dealt = events.select(F.col("run_id").cast("string").alias("run_id"), "status", "at", F.unix_micros("at").alias("micros")).withWatermark("at", late).groupBy("run_id")
    changes = dealt.transformWithState(JobStates(limit), OUT, "Update", "EventTime")
    return changes.select("run_id", "status", F.timestamp_micros("micros").alias("at"), "ended", "timed_out")


def queue_places(jobs: DataFrame) -> DataFrame:
    """(queue, run_id, place): jobs of (queue, run_id, status, at) that wait, in order of arrival by queue."""
    first = Window.partitionBy("queue").orderBy("at", "run_id")
    return jobs.filter("status = 'queued'").select("queue", "run_id", F.row_number().over(first).alias("place"))
