"""Job leases over a stream of their events, with timers for what happens when nothing happens.

An event is (job, seq, kind, at, until): enqueue, lease and renew (until: when
the lease ends), defer (until: when it may run again), done, fail. What a job
does by itself is told too: expired when a lease runs out, ready when a
deferral ends, terminal when it has failed or expired too often.

The state of a job is one row, so it stays small whatever the number of
events. Events of a job count in order of seq: one that was seen already, or
comes after a later one, changes nothing. The result doesn't depend on how
events fall into batches: a timer that an event has passed is told before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "job string, at timestamp, change string, attempts int"
MOST_ATTEMPTS = 4
#: What an event makes of a job, if it has the right to.
_WAITS = ("running", "deferred")


@dataclass
class Job:
    status: str = "new"
    until: int = 0
    attempts: int = 0
    seq: int = -1


def advance(job: Job, now: int, most: int) -> Iterator[tuple[int, str, int]]:
    """(time, change, attempts) of what a job's own clock has done by ``now`` (milliseconds)."""
    if job.status not in _WAITS or job.until > now:
        return
    at = job.until
    if job.status == "deferred":
        job.status = "pending"
        yield at, "ready", job.attempts
    else:
        yield from _failed(job, at, "expired", most)


def _failed(job: Job, at: int, change: str, most: int) -> Iterator[tuple[int, str, int]]:
    job.attempts += 1
    job.status = "terminal" if job.attempts >= most else "pending"
    yield at, change, job.attempts
    if job.status == "terminal":
        yield at, "terminal", job.attempts


def replay(job: Job, events: Iterable[tuple[int, int, str, int | None]], most: int = MOST_ATTEMPTS) -> Iterator[tuple[int, str, int]]:
    """(time, change, attempts) of events (seq, at, kind, until) in order; times in milliseconds."""
    for seq, at, kind, until in sorted(events, key=lambda e: e[0]):
        if seq <= job.seq:
            continue
        job.seq = seq
        yield from advance(job, at, most)
        if job.status == "terminal" or job.status == "done":
            continue
        if kind == "lease" and job.status in ("new", "pending"):
            job.status, job.until = "running", until or at
            yield at, "leased", job.attempts
        elif kind == "renew" and job.status == "running":
            job.until = max(job.until, until or at)
        elif kind == "defer" and job.status != "deferred":
            job.status, job.until = "deferred", until or at
            yield at, "deferred", job.attempts
        elif kind == "done" and job.status == "running":
            job.status = "done"
            yield at, "done", job.attempts
        elif kind == "fail" and job.status == "running":
            yield from _failed(job, at, "failed", most)
        elif kind == "enqueue" and job.status == "new":
            job.status = "pending"


class Leases(StatefulProcessor):
    """replay() with the job kept between batches, and a timer at its next deadline."""

    def __init__(self, most: int = MOST_ATTEMPTS):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, until long, attempts int, seq long")

    def _job(self) -> Job:
        return Job(*self.state.get()) if self.state.exists() else Job()

    def _told(self, key: tuple, job: Job, changes: list[tuple[int, str, int]]) -> Iterator[Row]:
        self.state.update((job.status, job.until, job.attempts, job.seq))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.status in _WAITS:
            self.handle.registerTimer(job.until)
        for at, change, attempts in changes:
            yield Row(job=key[0], at=_time(at), change=change, attempts=attempts)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        job = self._job()
        events = [(r["seq"], _millis(r["at"]), r["kind"], None if r["until"] is None else _millis(r["until"])) for r in rows]
        yield from self._told(key, job, list(replay(job, events, self.most)))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        job = self._job()
        yield from self._told(key, job, list(advance(job, expiredTimerInfo.getExpiryTimeInMs(), self.most)))

    def close(self) -> None:
        pass


def _millis(t) -> int:
    return round(t.timestamp() * 1000)


def _time(ms: int):
    from datetime import datetime

    return datetime.fromtimestamp(ms / 1000)


def stream_leases(events: DataFrame, *, late: str = "10 minutes", most: int = MOST_ATTEMPTS) -> DataFrame:
    """CHANGES of a stream of events (job, seq, kind, at, until), by event time.

    A deadline is told once events ``late`` behind it can't come any more. The
    session's state store must be the one on disk (RocksDB).
    """
    keyed = events.select("job", "seq", "kind", "at", "until").withWatermark("at", late).groupBy("job")
    return keyed.transformWithState(Leases(most), CHANGES, "Append", "EventTime")


def lease_changes(events: DataFrame, now_ms: int, *, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The same of a table of events, up to ``now_ms``: deadlines until then have passed. A job's events are one small group."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        job = Job()
        rows = list(replay(job, zip(*(table.column(c).to_pylist() for c in ("seq", "at_ms", "kind", "until_ms")), strict=True), most))
        rows += advance(job, now_ms, most)
        return pa.table({"job": pa.array([keys[0].as_py()] * len(rows), pa.string()), "at_ms": pa.array([r[0] for r in rows], pa.int64()), "change": pa.array([r[1] for r in rows], pa.string()), "attempts": pa.array([r[2] for r in rows], pa.int32())})

    timed = events.select("job", "seq", "kind", F.unix_millis("at").alias("at_ms"), F.unix_millis("until").alias("until_ms"))
    told = timed.groupBy("job").applyInArrow(run, "job string, at_ms long, change string, attempts int")
    return told.select("job", F.timestamp_millis("at_ms").alias("at"), "change", "attempts")
