"""Leases by timers and tables kept by batches, with events in any order and batches that come again."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import jobs
from tallyloom.streaming import leases, merges

START = datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp, user_id long, kind string, value double"


def walked(rows, lease, grace, end):
    """Expired leases, an event at a time."""
    out, held = [], {}
    for at, event, job, kind in sorted((ts, e, j, k) for e, ts, j, k, _ in rows if ts < end):
        h = held.get(job)
        if h and h[2] + grace < at:
            out.append((job, h[0], h[3]))
            h = None
        if kind == "CLAIM":
            h = h or (event, at, at + lease, 0)
        elif h and h[2] > at:
            h = (h[0], h[1], at + lease, h[3] + 1) if kind == "HEARTBEAT" else None
        held[job] = h
    return sorted(out + [(j, h[0], h[3]) for j, h in held.items() if h and h[2] + grace < end])


@pytest.fixture
def store(spark):
    before = spark.conf.get(leases.STORE[0], None)
    spark.conf.set(*leases.STORE)
    yield
    spark.conf.unset(leases.STORE[0]) if before is None else spark.conf.set(leases.STORE[0], before)


def test_timers_do_not_depend_on_order_or_batches(spark, store, tmp_path):
    rng = random.Random(4)
    rows = [(i, START + timedelta(seconds=rng.randrange(40_000)), rng.randrange(6), rng.choice(["CLAIM", "HEARTBEAT", "FINISH"]), 1.0) for i in range(150)]
    rows += [(900, START + timedelta(seconds=90_000), 99, "CLAIM", 1.0), (901, None, 1, "CLAIM", 1.0), (902, START, None, "CLAIM", 1.0), (903, START, 1, "OTHER", 1.0)]
    last, shuffled = rows[150:151], rows[:150] + rows[151:]
    rng.shuffle(shuffled)
    for k, part in enumerate((shuffled[:70], shuffled[70:], last)):  # late by up to 12 hours, which the watermark allows
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = leases.expired(stream, F.col("kind"), lease=600, grace=60, late="12 hours")
    query = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((r["job_id"], r["token"], r["beats"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    usual = [r for r in rows[:151]]
    want = walked(usual, timedelta(seconds=600), timedelta(seconds=60), START + timedelta(seconds=90_000) - timedelta(hours=12))
    assert found == want and len(want) > 10


def test_a_step_at_the_edges():
    held = leases.step(None, 100, 7, "CLAIM", 50)
    assert held == (7, 100, 150, 0)
    assert leases.step(held, 120, 8, "CLAIM", 50) == held
    assert leases.step(held, 149, 8, "HEARTBEAT", 50) == (7, 100, 199, 1)
    assert leases.step(held, 150, 8, "HEARTBEAT", 50) == held and leases.step(held, 150, 8, "FINISH", 50) == held
    assert leases.step(held, 149, 8, "FINISH", 50) is None and leases.step(None, 1, 8, "HEARTBEAT", 50) is None


def states(spark, rows):
    df = spark.createDataFrame(rows, EVENT)
    return merges.last_state(merges.job_rows(df, F.col("kind")))


def kept_rows(table):
    return sorted((r["job_id"], r["status"], r["last_event_id"], r["n_events"], float(r["total"])) for r in table.current().collect())


def plain(rows):
    out = {}
    for e, ts, j, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        out[j] = (k, e, out.get(j, (0, 0, 0, 0))[2] + 1, out.get(j, (0, 0, 0, 0.0))[3] + v)
    return sorted((j, *x) for j, x in out.items())


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, START + timedelta(seconds=rng.randrange(1000)), rng.randrange(20), rng.choice("abc"), 0.5) for i in range(200)]
    table = merges.Versions(spark, f"file://{tmp_path}/t", "job_id", merges.JOB_STATE, buckets=4)
    assert table.current().collect() == []
    for b in range(4):
        part = states(spark, rows[b * 50 : b * 50 + 50])
        table.merge(part, b, merges.last_state)
        assert kept_rows(table) == plain(rows[: b * 50 + 50])
        table.merge(part, b, merges.last_state)  # delivered again
        assert kept_rows(table) == plain(rows[: b * 50 + 50])
    table.merge(states(spark, rows[:50]), 0, merges.last_state)  # long done
    table.merge(states(spark, rows[:0]), 4, merges.last_state)
    assert kept_rows(table) == plain(rows) and all(len(v) <= 2 for v in table.versions().values())


def test_a_batch_without_its_mark_is_not_seen(spark, tmp_path):
    table = merges.Versions(spark, f"file://{tmp_path}/t", "job_id", merges.JOB_STATE, buckets=2)
    first, second = [(1, START, 1, "a", 1.0), (2, START, 2, "a", 1.0)], [(3, START + timedelta(1), 1, "b", 1.0), (4, START, None, "x", 1.0)]
    table.merge(states(spark, first), 0, merges.last_state)
    table.merge(states(spark, second), 1, merges.last_state)
    (tmp_path / "t" / "_batches" / "1").unlink()  # as if the driver was lost before the mark
    assert kept_rows(table) == plain(first)
    table.merge(states(spark, second), 1, merges.last_state)
    assert kept_rows(table) == plain(first + second[:1])


def test_logs_name_their_first_illegal_move(spark):
    moves = {1: ["QUEUED CLAIMED", "CLAIMED RUNNING", "RUNNING SUCCEEDED"], 2: ["QUEUED CLAIMED", "RUNNING FAILED", "QUEUED RUNNING"], 3: ["QUEUED RUNNING"], 4: ["QUEUED CLAIMED", "CLAIMED X"], 5: ["QUEUED CLAIMED", "CLAIMED RUNNING", "RUNNING SUCCEEDED", "SUCCEEDED QUEUED"]}
    rows = [(j, j * 10 + i, START + timedelta(seconds=i), *m.split()) for j, ms in moves.items() for i, m in enumerate(ms)] + [(6, 60, START, None, "CLAIMED")]
    got = jobs.log_violations(spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, from_status string, to_status string"))
    assert sorted((r["job_id"], r["event_id"], r["step"], r["state"], r["problem"]) for r in got.collect()) == [(2, 21, 2, "CLAIMED", "WRONG_STATE"), (3, 30, 1, "QUEUED", "NOT_ALLOWED"), (4, 41, 2, "CLAIMED", "NOT_ALLOWED"), (5, 53, 4, "SUCCEEDED", "NOT_ALLOWED"), (6, 60, 1, "QUEUED", "WRONG_STATE")]


def test_a_job_sets_one_timer_for_what_waits():
    class Handle:
        timers: list[int] = []

        def registerTimer(self, at):
            self.timers.append(at)

    class Kept:
        def appendList(self, rows):
            pass

    got = leases.Leases(10, 5)
    got.handle, got.waiting = Handle(), Kept()
    part = pd.DataFrame({"at": [9_000_500, 2_000_000, 5_000_000], "event_id": [3, 1, 2], "kind": ["FINISH", "CLAIM", "HEARTBEAT"]})
    assert list(got.handleInputRows((1,), iter([part, part.head(0)]), None)) == []
    assert Handle.timers == [2_001]
