"""Leases over a stream of claims, heartbeats and finishes, as keyed state with event-time timers.

A claim of a free job takes it for a lease; a heartbeat in time makes the lease last from then on, a finish in time
frees the job. Nobody may act between the end of a lease and its grace; once the grace has passed too, the lease has
expired, which is what comes out. Claims of a held job, and heartbeats or finishes of one that isn't held, do nothing.

Events may come in any order and in any micro-batch. They wait in the job's state until the watermark has passed
them, and are then taken in order of time and id, so the result is a function of the events alone. A timer wakes a job
when the first event that waits is due and when a lease may have run out. A job's state is its lease and the events that wait, which
the watermark's delay bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.operators.jobs import GRACE, LEASE

CLAIM, HEARTBEAT, FINISH = "CLAIM", "HEARTBEAT", "FINISH"
EXPIRED = "job_id long, token long, claimed_us long, expires_us long, beats long"
#: Where state lives: timers need a store that can be read in order of time.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What holds a job: the claim's id and time, the end of the lease, heartbeats in time.
Held = tuple[int, int, int, int]


def step(held: Held | None, at: int, event: int, kind: str, lease: int) -> Held | None:
    """What holds the job after an event, in microseconds; a lease whose grace has passed is cleared before."""
    if kind == CLAIM:
        return held or (event, at, at + lease, 0)
    if held is None or held[2] <= at:
        return held
    if kind == HEARTBEAT:
        return (held[0], held[1], at + lease, held[3] + 1)
    return None if kind == FINISH else held


class Leases(StatefulProcessor):
    """Expired leases of each job; ``lease`` and ``grace`` are in seconds."""

    def __init__(self, lease: int, grace: int) -> None:
        self.lease, self.grace = lease * 1_000_000, grace * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "token long, claimed long, expires long, beats long")
        self.waiting = handle.getListState("waiting", "at long, event long, kind string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            new = list(zip(part["at"].tolist(), part["event_id"].tolist(), part["kind"].tolist()))
            self.waiting.appendList(new)
            if new:
                self.wake(min(new)[0])
        return iter(())

    def wake(self, at: int) -> None:
        """A timer for the first event that waits; the others' come once it has been taken."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((r[0], r[1], r[2]) for r in self.waiting.get())
        due = [e for e in events if e[0] < now]
        held = tuple(self.held.get()) if self.held.exists() else None
        out = []
        for at, event, kind in due:
            if held and held[2] + self.grace < at:
                out.append(held)
                held = None
            held = step(held, at, event, kind, self.lease)
        if held and held[2] + self.grace < now:
            out.append(held)
            held = None
        if due:
            if len(due) < len(events):
                self.waiting.put(events[len(due) :])
                self.wake(events[len(due)][0])
            else:
                self.waiting.clear()
        if held:
            self.held.update(held)
            self.handle.registerTimer((held[2] + self.grace) // 1000 + 1)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame([(key[0], *h) for h in out], columns=["job_id", "token", "claimed_us", "expires_us", "beats"])


def expired(events: DataFrame, kind: Column, job: str = "user_id", lease: int = LEASE, grace: int = GRACE, late: str = "2 hours") -> DataFrame:
    """Leases that ran out: ``job_id``, the claim's ``token`` and time, the end of the lease, and heartbeats in time.

    ``events``: a stream with ``event_id``, ``ts`` (a timestamp) and the job's column; ``kind`` gives CLAIM, HEARTBEAT or FINISH, other events are
    left out, as are those without a job, an id or a time. Events later than the watermark are dropped by Spark.
    Run it with the state store of ``STORE``.
    """
    rows = events.select(F.col(job).cast("long").alias("job_id"), F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("at"), kind.alias("kind"))
    rows = rows.where(F.col("kind").isin(CLAIM, HEARTBEAT, FINISH) & F.col("job_id").isNotNull() & F.col("event_id").isNotNull() & F.col("ts").isNotNull())
    got = rows.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(Leases(lease, grace), EXPIRED, "Append", "EventTime")
    return got.select("job_id", "token", F.timestamp_micros("claimed_us").alias("claimed_at"), F.timestamp_micros("expires_us").alias("expired_at"), "beats")
