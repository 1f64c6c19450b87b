"""The leased job queue as batch steps at a given instant.

Each step takes tables and gives new rows; ``now`` is always a parameter. Where a database would lock rows
for one worker at a time, a batch of idle workers is served at once: jobs in order of the queue are given
to workers in order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.schemas import JOB_MOVES

# The lease policy, in seconds.
LEASE, HEARTBEAT, GRACE, ATTEMPTS, BACKOFF = 120, 30, 30, 3, (30, 120, 600)
HELD = ("CLAIMED", "RUNNING")
# Signs that a job's and an event's message have at most, and what is said of a job without attempts left.
MESSAGE, EVENT_MESSAGE, EXHAUSTED = 2000, 500, "Maximum job attempts exhausted"


def after(now: Column, seconds: int | Column) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds) if isinstance(seconds, int) else seconds)


def move_allowed(source: Column, target: Column) -> Column:
    """Whether the table of moves has this one."""
    out = F.lit(False)
    for s, targets in JOB_MOVES.items():
        out = out | ((source == s) & target.isin(*targets))
    return F.coalesce(out, F.lit(False))


def lapsed(now: Column, grace: int = GRACE) -> Column:
    """The lease ended longer ago than the grace."""
    return F.col("status").isin(*HELD) & (F.col("lease_expires_at") < after(now, -grace))


def exhausted(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that fail because no attempt is left, rewritten, with their former status."""
    out = jobs.where((F.col("attempt_count") >= F.col("max_attempts")) & ((F.col("status") == "RETRY_WAIT") | lapsed(now)))
    return out.withColumn("from_status", F.col("status")).withColumns({
        "status": F.lit("FAILED"), "completed_at": now, "error_code": F.lit("MAX_ATTEMPTS_EXHAUSTED"), "error_message": F.coalesce("error_message", F.lit(EXHAUSTED + ".")),
        **{c: F.lit(None).cast(jobs.schema[c].dataType) for c in ("claimed_by", "claim_token", "lease_expires_at")},
    })


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    due = F.col("status").isin("QUEUED", "RETRY_WAIT") & (F.col("available_at") <= now)
    return jobs.where((due | lapsed(now)) & (F.col("attempt_count") < F.col("max_attempts")))


QUEUE = ("priority", "available_at", "created_at", "job_id")


def dequeue(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """The next jobs of the queue, in order."""
    return claimable(jobs, now).orderBy(*[F.col(c).asc_nulls_last() for c in QUEUE]).limit(most)


def claim(jobs: DataFrame, workers: list[str], now: Column, lease: int = LEASE) -> DataFrame:
    """One job for each idle worker, rewritten as claimed, with the former status.

    As many rows as there are workers are ranked, after a top-k that no single task has to sort.
    """
    spark = jobs.sparkSession
    if any(not w.strip() for w in workers):
        raise ValueError("a worker needs a name")
    names = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(workers), 1)], "rank_ int, worker string")
    order = [F.col(c).asc_nulls_last() for c in QUEUE]
    next_ = dequeue(jobs, now, len(workers)).withColumn("rank_", F.row_number().over(Window.orderBy(*order)))
    got = next_.join(F.broadcast(names), "rank_").drop("rank_")
    return got.withColumn("from_status", F.col("status")).withColumns({
        "status": F.lit("CLAIMED"), "claimed_by": F.col("worker"), "attempt_count": F.col("attempt_count") + 1, "lease_expires_at": after(now, lease),
        "claim_token": F.sha2(F.concat_ws(":", "job_id", F.col("attempt_count") + 1, "worker"), 256),
    }).drop("worker")


def fenced(claims: DataFrame, jobs: DataFrame, now: Column, states: tuple[str, ...] = HELD) -> DataFrame:
    """Jobs whose claim is still its holder's: id, token and worker agree, and the lease hasn't ended."""
    c = claims.select(F.col("job_id").alias("id_"), F.col("claim_token").alias("token_"), F.col("claimed_by").alias("worker_"), *[x for x in claims.columns if x not in jobs.columns])
    on = (F.col("job_id") == F.col("id_")) & (F.col("claim_token") == F.col("token_")) & (F.col("claimed_by") == F.col("worker_"))
    return jobs.join(c, on).drop("id_", "token_", "worker_").where(F.col("status").isin(*states) & (F.col("lease_expires_at") > now))


def mark_running(claims: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    return fenced(claims, jobs, now, ("CLAIMED",)).withColumn("status", F.lit("RUNNING"))


def heartbeat(claims: DataFrame, jobs: DataFrame, now: Column, lease: int = LEASE) -> DataFrame:
    return fenced(claims, jobs, now).withColumn("lease_expires_at", after(now, lease))


def finish(claims: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Claims with a ``result`` of SUCCEEDED, FAILED, CANCELLED or NEEDS_INPUT; the last leaves the job open.

    ``attempt_status`` is the attempt's: one that asks for input has succeeded.
    """
    open_ = F.col("result") == "NEEDS_INPUT"
    none = lambda c: F.lit(None).cast(jobs.schema[c].dataType)
    return fenced(given(claims), jobs, now).withColumns({
        "error_code": F.col("given_code"), "error_message": F.left("given_message", F.lit(MESSAGE)),
        "from_status": F.lit("RUNNING"), "status": F.col("result"), "completed_at": F.when(~open_, now), "attempt_status": F.when(open_, "SUCCEEDED").otherwise(F.col("result")),
        "claimed_by": none("claimed_by"), "claim_token": none("claim_token"), "lease_expires_at": none("lease_expires_at"),
    }).drop("result")


def given(claims: DataFrame) -> DataFrame:
    """Claims with ``given_code`` and ``given_message``, what the worker says of an error, null where it says nothing."""
    return claims.withColumns({c: F.lit(None).cast("string") for c in ("given_code", "given_message") if c not in claims.columns})


def retry(claims: DataFrame, jobs: DataFrame, now: Column, delay: int | Column = BACKOFF[0]) -> DataFrame:
    """Claims that failed for now: wait for ``delay`` seconds, or fail if no attempt is left.

    The error is the worker's, ``given_code`` and ``given_message``; the job's former one goes.
    """
    over = F.col("attempt_count") >= F.col("max_attempts")
    none = lambda c: F.lit(None).cast(jobs.schema[c].dataType)
    said = F.left("given_message", F.lit(MESSAGE))
    return fenced(given(claims), jobs, now).withColumns({
        "from_status": F.lit("RUNNING"), "status": F.when(over, "FAILED").otherwise("RETRY_WAIT"), "completed_at": F.when(over, now), "available_at": F.when(over, F.col("available_at")).otherwise(after(now, delay)),
        "error_code": F.when(over, "MAX_ATTEMPTS_EXHAUSTED").otherwise(F.col("given_code")), "error_message": F.when(over, F.coalesce(said, F.lit(EXHAUSTED + "."))).otherwise(said),
        "claimed_by": none("claimed_by"), "claim_token": none("claim_token"), "lease_expires_at": none("lease_expires_at"),
    })


def event(rows: DataFrame, kind: Column, source: Column, target: Column, stage: Column, message: Column) -> DataFrame:
    """Rows of the log of jobs."""
    cut = F.left(message, F.lit(EVENT_MESSAGE))
    return rows.select("job_id", kind.alias("event_type"), source.alias("from_status"), target.alias("to_status"), stage.alias("stage"), cut.alias("message"))


def exhausted_events(failed: DataFrame) -> DataFrame:
    """For what ``exhausted`` gives."""
    return event(failed, F.col("error_code"), F.col("from_status"), F.col("status"), F.lit("FINALIZE"), F.lit(EXHAUSTED))


def claim_events(claimed: DataFrame) -> DataFrame:
    """For what ``claim`` gives."""
    return event(claimed, F.lit("CLAIMED"), F.col("from_status"), F.col("status"), F.lit("CLAIM"), F.lit("Worker claimed job"))


def finish_events(finished: DataFrame) -> DataFrame:
    """For what ``finish`` gives, from claims with what ``given`` adds."""
    said = F.coalesce("given_message", F.concat(F.lit("Job finished as "), "status"))
    return event(finished, F.col("status"), F.lit("RUNNING"), F.col("status"), F.lit("FINALIZE"), said)


def retry_events(retried: DataFrame) -> DataFrame:
    """For what ``retry`` gives."""
    over = F.col("status") == "FAILED"
    said = F.coalesce("given_message", F.when(over, EXHAUSTED).otherwise("Retry scheduled"))
    return event(retried, F.when(over, F.col("error_code")).otherwise("RETRY_SCHEDULED"), F.lit("RUNNING"), F.col("status"), F.when(over, "FINALIZE").otherwise("RETRY"), said)


def claim_attempts(claimed: DataFrame, now: Column) -> DataFrame:
    """New attempts for what ``claim`` gives."""
    none = F.lit(None).cast("string")
    return claimed.select("job_id", F.col("attempt_count").alias("attempt_number"), F.col("claimed_by").alias("worker_id"), "claim_token", F.lit("CLAIMED").alias("status"), now.alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("long").alias("duration_ms"), none.alias("error_code"), none.alias("error_message"))


def closed_attempts(attempts: DataFrame, claims: DataFrame, done: DataFrame, now: Column, status: Column) -> DataFrame:
    """Attempts of jobs that ``finish`` or ``retry`` has let go, closed. ``claims``: as their workers know them."""
    held = claims.select("job_id", "claim_token")
    ended = done.select("job_id", F.col("attempt_count").alias("attempt_number"), status.alias("status_"), F.col("error_code").alias("code_"), F.col("error_message").alias("message_"))
    got = attempts.join(held, ["job_id", "claim_token"], "left_semi").join(ended, ["job_id", "attempt_number"])
    return got.withColumns({"status": F.col("status_"), "finished_at": now, "duration_ms": duration_ms(F.col("started_at"), now), "error_code": F.col("code_"), "error_message": F.col("message_")}).drop("status_", "code_", "message_")


def expired_attempts(attempts: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Attempts still open of jobs that failed, as ``exhausted`` gives them, with a lease that ended, closed."""
    got = attempts.where(F.col("finished_at").isNull()).join(jobs.where(F.col("from_status").isin(*HELD)).select("job_id"), "job_id", "left_semi")
    none = {c: F.lit(None).cast("string") for c in ("error_code", "error_message") if c not in attempts.columns}
    return got.withColumns(none).withColumns({
        "status": F.lit("LEASE_EXPIRED"), "finished_at": now, "duration_ms": F.coalesce("duration_ms", duration_ms(F.col("started_at"), now)),
        "error_code": F.coalesce("error_code", F.lit("MAX_ATTEMPTS_EXHAUSTED")), "error_message": F.coalesce("error_message", F.lit("Lease expired on the final permitted attempt.")),
    })


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two instants, 0 at least."""
    return F.greatest(F.lit(0), F.floor(F.timestamp_diff("MICROSECOND", start, end) / 1000)).cast("bigint")


def merged(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The job table with changed rows in place of their former selves."""
    return jobs.join(changed.select("job_id"), "job_id", "left_anti").unionByName(changed.select(*jobs.columns))


def log_violations(log: DataFrame, start: str = "QUEUED") -> DataFrame:
    """The first illegal move of each job's log, by the table of moves as an automaton that begins in ``start``.

    ``log``: job_id, event_id, ts, from_status, to_status. Up to a job's first illegal move every move was legal, so the automaton is in the
    state that the move before led to, and no fold over the log is needed: a move is illegal if it doesn't begin there
    (WRONG_STATE) or isn't in the table (NOT_ALLOWED). Missing states are illegal. ``step`` is the move's place in the log.
    A job's log is read in order from a sort that spills, never held whole.
    """
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    rows = log.withColumns({"step": F.row_number().over(w), "state": F.coalesce(F.lag("to_status").over(w), F.when(F.row_number().over(w) == 1, F.lit(start)))})
    problem = F.when(~F.coalesce(F.col("from_status") == F.col("state"), F.lit(False)), "WRONG_STATE").when(~move_allowed(F.col("from_status"), F.col("to_status")), "NOT_ALLOWED")
    rows = rows.withColumn("problem", problem)
    first = F.min_by(F.struct("event_id", "step", "state", "from_status", "to_status", "problem"), "step")
    return rows.where(F.col("problem").isNotNull()).groupBy("job_id").agg(first.alias("v")).select("job_id", "v.*")


def policy_errors(policy: DataFrame) -> DataFrame:
    """What is wrong with each lease policy: lease, heartbeat, grace, attempts and backoff in seconds."""
    rules = {
        "LEASE": ~(F.col("lease") > 0), "HEARTBEAT": ~(F.col("heartbeat") > 0), "HEARTBEAT_NOT_SHORTER": F.col("heartbeat") >= F.col("lease"), "GRACE": ~(F.col("grace") >= 0),
        "ATTEMPTS": ~(F.col("attempts") > 0), "BACKOFF_TOO_SHORT": F.size("backoff") < F.greatest(F.lit(0), F.col("attempts") - 1), "BACKOFF": F.exists("backoff", lambda x: ~(x > 0)),
    }
    return policy.withColumn("errors", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])))
