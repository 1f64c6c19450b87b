"""Streams with timers and with tables that they keep, run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import jobs
from tallyloom.plans.queue_queries import KINDS
from tallyloom.plans.registry import query
from tallyloom.sources.readers import shared_dir, table
from tallyloom.sources.schemas import JOB_MOVES
from tallyloom.streaming import events, leases, merges

#: What an event does to its user's lease, and the lease's terms in seconds: long, as users do something twice a day.
KIND = "CASE event_type WHEN 'view' THEN 'CLAIM' WHEN 'signup' THEN 'CLAIM' WHEN 'click' THEN 'HEARTBEAT' WHEN 'purchase' THEN 'FINISH' END"
HOLD, SPARE = 21_600, 3_600
END = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM k)"

#: The same over the whole table, an event at a time: what holds the job, and the lease that the event found expired.
EXPIRY = f"""WITH RECURSIVE k AS (SELECT user_id AS job, event_id, ts, {KIND} AS kind FROM events WHERE event_type IN ('view', 'signup', 'click', 'purchase')),
  e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM k WHERE ts < {END}),
  s AS (SELECT job, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS token, CAST(NULL AS TIMESTAMP) AS claimed, CAST(NULL AS TIMESTAMP) AS expires, CAST(0 AS BIGINT) AS beats, CAST(NULL AS BIGINT) AS x_token, CAST(NULL AS TIMESTAMP) AS x_claimed, CAST(NULL AS TIMESTAMP) AS x_expires, CAST(0 AS BIGINT) AS x_beats FROM (SELECT DISTINCT job FROM e)
    UNION ALL SELECT job, n, CASE WHEN free AND kind = 'CLAIM' THEN event_id WHEN free OR (kind = 'FINISH' AND expires > ts) THEN NULL ELSE token END, CASE WHEN free AND kind = 'CLAIM' THEN ts ELSE claimed END, CASE WHEN (free AND kind = 'CLAIM') OR (NOT free AND kind = 'HEARTBEAT' AND expires > ts) THEN ts + INTERVAL {HOLD} SECOND ELSE expires END,
      CASE WHEN free THEN 0 WHEN kind = 'HEARTBEAT' AND expires > ts THEN beats + 1 ELSE beats END, CASE WHEN over THEN token END, claimed, expires, beats
      FROM (SELECT s.*, e.* EXCLUDE (job, n), e.n AS n, s.token IS NOT NULL AND s.expires + INTERVAL {SPARE} SECOND < e.ts AS over, s.token IS NULL OR s.expires + INTERVAL {SPARE} SECOND < e.ts AS free FROM (SELECT job, n AS m, token, claimed, expires, beats FROM s) s JOIN e ON e.job = s.job AND e.n = s.m + 1)),
  z AS (SELECT x_token AS token, job, x_claimed AS claimed, x_expires AS expires, x_beats AS beats FROM s WHERE x_token IS NOT NULL UNION ALL SELECT arg_max(token, n) FILTER (WHERE true), job, arg_max(claimed, n), arg_max(expires, n), arg_max(beats, n) FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n DESC) AS back FROM s) WHERE back = 1 AND token IS NOT NULL AND expires + INTERVAL {SPARE} SECOND < {END} GROUP BY job)
  SELECT job AS job_id, token, claimed AS claimed_at, expires AS expired_at, beats FROM z"""


@query(EXPIRY)
def stream_lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases of users that ran out, by event-time timers."""
    before = spark.conf.get(leases.STORE[0], None)
    spark.conf.set(*leases.STORE)
    try:
        got = events.drain(leases.expired(events.timed(events.read(spark, sf_dir)), F.expr(KIND), lease=HOLD, grace=SPARE))
    finally:
        if before is None:
            spark.conf.unset(leases.STORE[0])
        else:
            spark.conf.set(leases.STORE[0], before)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("claimed_at", "expired_at")})


STATUS = KINDS.format("event_id")


@query(f"SELECT user_id AS job_id, arg_max({STATUS}, (ts, event_id)) AS status, max(ts) AS updated_at, arg_max(event_id, (ts, event_id)) AS last_event_id, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id")
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as a stream of their events has left them."""
    root = f"{shared_dir(spark)}/tallyloom/jobs-{uuid.uuid4().hex}"
    kept = merges.Versions(spark, f"{root}/table", "job_id", merges.JOB_STATE, buckets=8)
    merges.follow(events.read(spark, sf_dir), F.expr(STATUS), kept, f"{root}/stream").awaitTermination()
    return kept.current().withColumns({"updated_at": F.col("updated_at").cast("timestamp_ntz"), "total": F.col("total").cast("double")})


# -- logs of jobs, checked move by move

#: Most moves go round QUEUED, CLAIMED, RUNNING, RETRY_WAIT; every ninth goes anywhere, and every 31st says it came from elsewhere.
ROUND = "CASE {} % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'CLAIMED' WHEN 2 THEN 'RUNNING' ELSE 'RETRY_WAIT' END"
LOG = f"""SELECT job_id, event_id, ts, CASE WHEN event_id % 31 = 0 THEN 'SUCCEEDED' ELSE {ROUND.format('(n - 1)')} END AS from_status, CASE WHEN event_id % 9 = 0 THEN {STATUS} ELSE {ROUND.format('n')} END AS to_status FROM (SELECT user_id * 40 + event_id % 40 AS job_id, event_id, ts, row_number() OVER (PARTITION BY user_id * 40 + event_id % 40 ORDER BY ts, event_id) AS n FROM events)"""
ALLOWED = " OR ".join(f"(from_status = '{s}' AND to_status IN ({', '.join(repr(t) for t in ts)}))" for s, ts in JOB_MOVES.items())


@query(f"""WITH l AS (SELECT *, row_number() OVER o AS n, coalesce(lag(to_status) OVER o, 'QUEUED') AS state FROM ({LOG}) WINDOW o AS (PARTITION BY job_id ORDER BY ts, event_id)),
  v AS (SELECT *, CASE WHEN from_status <> state THEN 'WRONG_STATE' WHEN NOT ({ALLOWED}) THEN 'NOT_ALLOWED' END AS problem FROM l), f AS (SELECT job_id, min(n) AS n FROM v WHERE problem IS NOT NULL GROUP BY job_id)
  SELECT job_id, event_id, CAST(n AS INTEGER) AS step, state, from_status, to_status, problem FROM v SEMI JOIN f USING (job_id, n)""")
def job_log_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first illegal move of each job's log."""
    table(spark, sf_dir, "events").createOrReplaceTempView("tallyloom_events")
    return jobs.log_violations(spark.sql(LOG.replace("FROM events", "FROM tallyloom_events")))
