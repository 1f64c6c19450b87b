"""The queue's scenarios, step by step at given instants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import jobs

SCHEMA = "job_id long, status string, priority int, available_at timestamp_ntz, created_at timestamp_ntz, attempt_count int, max_attempts int, lease_expires_at timestamp_ntz, claimed_by string, claim_token string, error_message string, error_code string, completed_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return F.lit(T0 + dt.timedelta(seconds=seconds)).cast("timestamp_ntz")


def table(spark, *rows):
    base = dict(status="QUEUED", priority=100, available_at=T0, created_at=T0, attempt_count=0, max_attempts=3, lease_expires_at=None, claimed_by=None, claim_token=None, error_message=None, error_code=None, completed_at=None)
    return spark.createDataFrame([tuple((base | {"job_id": i} | r)[c.split()[0]] for c in SCHEMA.split(", ")) for i, r in enumerate(rows, 1)], SCHEMA)


def step(jobs_, changed):
    return jobs_.sparkSession.createDataFrame(jobs.merged(jobs_, changed).collect(), jobs_.schema)


def test_one_job_has_one_claim(spark):
    got = jobs.claim(table(spark, {}), ["a", "b"], at(1)).collect()
    assert len(got) == 1 and (got[0]["status"], got[0]["attempt_count"], got[0]["claimed_by"], got[0]["from_status"]) == ("CLAIMED", 1, "a", "QUEUED")
    with pytest.raises(ValueError):
        jobs.claim(table(spark, {}), [" "], at(1))


def test_run_and_finish(spark):
    queue = table(spark, {})
    claimed = jobs.claim(queue, ["a"], at(1))
    queue = step(queue, claimed)
    queue = step(queue, jobs.mark_running(queue, queue, at(2)))
    assert queue.first()["status"] == "RUNNING"
    assert jobs.mark_running(queue, queue, at(3)).count() == 0
    done = jobs.finish(queue.select("job_id", "claimed_by", "claim_token", F.lit("SUCCEEDED").alias("result")), queue, at(4)).first()
    assert (done["status"], done["attempt_count"], done["claim_token"], done["attempt_status"]) == ("SUCCEEDED", 1, None, "SUCCEEDED") and done["completed_at"]


def test_retry_then_claim_again_fences_the_old_token(spark):
    queue = table(spark, {})
    queue = step(queue, jobs.claim(queue, ["a"], at(1)))
    old = spark.createDataFrame(queue.select("job_id", "claimed_by", "claim_token").collect(), "job_id long, claimed_by string, claim_token string")
    queue = step(queue, jobs.retry(old, queue, at(2), 30))
    assert queue.first()["status"] == "RETRY_WAIT"
    assert jobs.claimable(queue, at(31)).count() == 0 and jobs.claimable(queue, at(32)).count() == 1
    queue = step(queue, jobs.claim(queue, ["a"], at(40)))
    assert queue.first()["attempt_count"] == 2
    assert jobs.finish(old.withColumn("result", F.lit("SUCCEEDED")), queue, at(41)).count() == 0


def test_last_retry_fails(spark):
    queue = table(spark, {"max_attempts": 1})
    queue = step(queue, jobs.claim(queue, ["a"], at(1)))
    got = jobs.retry(queue, queue, at(2)).first()
    assert (got["status"], got["error_code"]) == ("FAILED", "MAX_ATTEMPTS_EXHAUSTED") and got["completed_at"]


def test_lapsed_last_attempt_is_swept_not_claimed(spark):
    held = {"status": "RUNNING", "attempt_count": 1, "max_attempts": 1, "lease_expires_at": T0, "claimed_by": "a", "claim_token": "t"}
    queue = table(spark, held)
    assert jobs.claimable(queue, at(100)).count() == 0
    gone = jobs.exhausted(queue, at(100))
    assert (gone.first()["status"], gone.first()["from_status"], gone.first()["claim_token"]) == ("FAILED", "RUNNING", None)
    attempts = spark.createDataFrame([(1, 1, "RUNNING", T0, None, None), (2, 1, "RUNNING", T0, None, None)], "job_id long, attempt_number int, status string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms long")
    closed = jobs.expired_attempts(attempts, gone, at(100)).collect()
    assert [(r["job_id"], r["status"], r["duration_ms"]) for r in closed] == [(1, "LEASE_EXPIRED", 100_000)]
    assert jobs.fenced(queue, queue, at(1)).count() == 0


def test_order_and_grace(spark):
    queue = table(spark, {"priority": 100}, {"priority": 50, "available_at": T0 + dt.timedelta(seconds=5)}, {"priority": 50}, {"status": "CLAIMED", "lease_expires_at": T0, "priority": 1})
    assert [r["job_id"] for r in jobs.dequeue(queue, at(29), 9).orderBy("priority", "available_at").collect()] == [3, 2, 1]
    assert [r["job_id"] for r in jobs.dequeue(queue, at(31), 1).collect()] == [4]


def test_needs_input_leaves_the_job_open(spark):
    queue = table(spark, {"status": "RUNNING", "attempt_count": 1, "lease_expires_at": T0 + dt.timedelta(seconds=60), "claimed_by": "a", "claim_token": "t"})
    got = jobs.finish(queue.select("job_id", "claimed_by", "claim_token", F.lit("NEEDS_INPUT").alias("result")), queue, at(1)).first()
    assert (got["status"], got["completed_at"], got["attempt_status"]) == ("NEEDS_INPUT", None, "SUCCEEDED")


def test_queued_job_without_attempts_left_stays(spark):
    queue = table(spark, {"attempt_count": 3})
    assert jobs.exhausted(queue, at(9)).count() == 0 and jobs.claimable(queue, at(9)).count() == 0


def test_policies(spark):
    df = spark.createDataFrame([(120, 30, 30, 3, [30, 120, 600]), (30, 30, -1, 0, [0]), (10, 5, 0, 3, [1])], "lease int, heartbeat int, grace int, attempts int, backoff array<int>")
    assert [r["errors"] for r in jobs.policy_errors(df).collect()] == [[], ["HEARTBEAT_NOT_SHORTER", "GRACE", "ATTEMPTS", "BACKOFF"], ["BACKOFF_TOO_SHORT"]]
