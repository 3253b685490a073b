"""Jobs as a stream of their events: one small state per job, with timers for workers that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import Scratch
from ..sources.states import KeyedTable, newest
from ..sources.tables import apply_changes

STATE = "status string, attempts long, version long, seen long, revision long"
ROW = "job long, " + STATE


class Job(NamedTuple):
    status: str = "pending"
    attempts: int = 0
    version: int = 0
    seen: int = 0  # milliseconds of the last sign of life
    revision: int = 0  # of the rows given out, so that the newest of a batch is known


def reclaimed(job: Job, now: int, silence: int) -> Job:
    """The job as it stands at ``now``: one that ran and wasn't heard of for longer waits again."""
    return job._replace(status="pending") if job.status == "running" and now - job.seen > silence else job


def step(job: Job, event: str, version: int, now: int, silence: int) -> Job:
    """The job after an event. A newer version starts anew; of other events only those that fit the
    present status count, so what a worker says after its job was taken from it changes nothing."""
    job = reclaimed(job, now, silence)
    if event == "bump":
        return Job("pending", 0, version, now, job.revision) if version > job.version else job
    if event == "start" and job.status == "pending":
        return Job("running", job.attempts + 1, job.version, now)
    if event == "beat" and job.status == "running":
        return job._replace(seen=now)
    if event in ("done", "error") and job.status == "running":
        return job._replace(status=event, seen=now)
    if event == "retry" and job.status == "error":
        return job._replace(status="pending", seen=now)
    return job


class JobKeeper(StatefulProcessor):
    """Keeps a ``Job`` per key. A running job has one timer, a silence after its last sign of life."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _set(self, job: Job, before: Job) -> None:
        self.state.update(tuple(job))
        if (job.status, job.seen) == (before.status, before.seen):
            return
        if before.status == "running":  # its timer is told by its state
            self.handle.deleteTimer(before.seen + self.silence + 1)
        if job.status == "running":
            self.handle.registerTimer(job.seen + self.silence + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        before = job = Job(*known) if known is not None else Job()
        events = sorted(e for part in rows for e in zip(*(part[c].tolist() for c in ("ms", "seq", "event", "version"))))  # what one micro-batch has of one job
        for ms, _, event, version in events:
            job = step(job, event, int(version), int(ms), self.silence)
        job = job._replace(revision=before.revision + 1)
        self._set(job, before)
        yield pd.DataFrame([(*key, *job)], columns=["job", *Job._fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = Job(*self.state.get())
        job = reclaimed(before, expiredTimerInfo.getExpiryTimeInMs(), self.silence)
        if job != before:
            job = job._replace(revision=before.revision + 1)
            self.state.update(tuple(job))
            yield pd.DataFrame([(*key, *job)], columns=["job", *Job._fields])

    def close(self) -> None:
        pass


def kept_jobs(events: DataFrame, silence: int, late: str = "1 hour") -> DataFrame:
    """Changed jobs of a stream of events (job, seq, ts, event, version), in update mode.

    Events: start, beat, done, error, retry, bump. ``silence`` is in milliseconds. Needs the
    session's state store to be RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
    """
    feed = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return feed.groupBy("job").transformWithStateInPandas(JobKeeper(silence), ROW, "Update", "EventTime")


def jobs_table(spark: SparkSession, folder: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, folder, ROW, "job", buckets)


def keep_jobs(events: DataFrame, silence: int, folder: str, checkpoint: str, late: str = "1 hour", buckets: int = 16) -> None:
    """Drive the stream over what is there; each batch writes the jobs it changed to the keyed table in ``folder``."""
    spark, setting = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def merge(known: DataFrame, changed: DataFrame) -> DataFrame:
        last = newest(changed, "job", "revision")
        return apply_changes(known, last, last.limit(0), "job")

    def write(batch: DataFrame, batch_id: int) -> None:
        work = Scratch(batch.sparkSession)
        changed = work.keep(batch)  # read once, whole, and also where the batch was applied before: its states go with it
        jobs_table(batch.sparkSession, folder, buckets).apply(changed, merge, batch_id)
        work.clear()

    try:
        kept_jobs(events, silence, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
