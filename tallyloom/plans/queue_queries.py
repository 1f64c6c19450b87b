"""The pipeline list, the job queue and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import jobs, pipeline
from tallyloom.plans.registry import query
from tallyloom.sources.readers import table
from tallyloom.sources.schemas import JOB_MOVES, JOB_STATUS, STATUS_GROUPS
from tallyloom.streaming import events

# -- the list of extractions

JOB = """SELECT 'J' || event_id AS id, 'file' || (event_id % 50) || '.pdf' AS file_name, CASE event_id % 3 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'PROCESSING' ELSE 'FAILED' END AS status,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'T' || (user_id % 7) END AS detected_ticker, CASE event_id % 5 WHEN 0 THEN 'Known ' || (user_id % 7) END AS detected_name, ts AS updated_at FROM events"""
RUN = """SELECT 'R' || o_orderkey AS id, 'report' || (o_orderkey % 90) || '.pdf' AS file_name, CASE o_orderkey % 4 WHEN 0 THEN 'PENDING_REVIEW' WHEN 1 THEN 'READY_TO_COMMIT' WHEN 2 THEN 'COMMITTED' ELSE 'FAILED' END AS status, o_custkey AS company_id, o_orderdate AS updated_at FROM orders"""
CANDIDATE = "SELECT 'R' || l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'N' THEN 'PENDING' ELSE CASE WHEN l_linestatus = 'F' THEN 'REJECTED' ELSE 'COMMITTED' END END AS status FROM lineitem"
LIST = f"""WITH j AS (SELECT id, 'JOB' AS kind, file_name, status, coalesce(nullif(detected_ticker, ''), 'AI DETECTING') AS ticker, coalesce(nullif(detected_name, ''), 'Background extraction in progress') AS company_name, updated_at, 0 AS pending, 0 AS accepted, 0 AS rejected, 0 AS committed, 0 AS n_candidates FROM ({JOB}) ORDER BY updated_at DESC, id LIMIT 100),
  n AS (SELECT run_id, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE status = 'REJECTED') AS rejected, count(*) FILTER (WHERE status = 'COMMITTED') AS committed, count(*) AS n_candidates FROM ({CANDIDATE}) GROUP BY run_id),
  r AS (SELECT id, 'RUN' AS kind, file_name, status, c_name AS ticker, c_mktsegment AS company_name, updated_at, coalesce(pending, 0) AS pending, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, coalesce(committed, 0) AS committed, coalesce(n_candidates, 0) AS n_candidates
    FROM ({RUN}) JOIN customer ON company_id = c_custkey LEFT JOIN n ON id = run_id ORDER BY updated_at DESC, id LIMIT 300), a AS (SELECT * FROM j UNION ALL SELECT * FROM r)
"""


def view(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    """A fixture's SQL over a table of the folder."""
    table(spark, sf_dir, name).createOrReplaceTempView(f"tallyloom_{name}")
    return spark.sql(text.replace(f"FROM {name}", f"FROM tallyloom_{name}"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("company_name"))
    runs = pipeline.run_rows(view(spark, sf_dir, "orders", RUN), view(spark, sf_dir, "lineitem", CANDIDATE), companies)
    return pipeline.listed(pipeline.job_rows(view(spark, sf_dir, "events", JOB)), runs)


@query(LIST + "SELECT * FROM a")
def pipeline_union_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir)


@query(LIST + "SELECT id, kind, status, updated_at FROM a WHERE status IN ('UPLOADED', 'PROCESSING', 'PENDING_REVIEW') AND contains(lower(ticker || ' ' || company_name || ' ' || file_name), 'port') ORDER BY updated_at DESC, kind, id LIMIT 5 OFFSET 5")
def pipeline_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listed(spark, sf_dir).where(pipeline.matches("need_review", " PORT "))
    return pipeline.page(rows, 2, 3).select("id", "kind", "status", "updated_at")


GROUP_SQL = " UNION ALL ".join(["SELECT 'ALL' AS status_group, count(*) AS reports, count(DISTINCT nullif(ticker, 'AI DETECTING')) AS companies FROM a"] + [f"SELECT '{g}', count(*), count(DISTINCT nullif(ticker, 'AI DETECTING')) FROM a WHERE status IN ({', '.join(repr(s) for s in m)})" for g, m in STATUS_GROUPS.items()])


@query(LIST + GROUP_SQL)
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.summary(listed(spark, sf_dir))


# -- the job queue; events stand for jobs at a fixed instant

NOW = "CAST('2024-01-16 12:00:00' AS TIMESTAMP)"
QUEUE = """SELECT event_id AS job_id, CASE event_id % 8 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'CLAIMED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'RETRY_WAIT' WHEN 4 THEN 'NEEDS_INPUT' WHEN 5 THEN 'SUCCEEDED' WHEN 6 THEN 'FAILED' ELSE 'CANCELLED' END AS status,
  CAST(50 + 50 * (user_id % 3) AS INTEGER) AS priority, ts AS available_at, ts AS created_at, CAST(event_id % 5 AS INTEGER) AS attempt_count, CAST(3 AS INTEGER) AS max_attempts, CASE WHEN event_id % 8 IN (1, 2) THEN ts END AS lease_expires_at,
  CASE WHEN event_id % 8 IN (1, 2) THEN 'w' || (event_id % 9) END AS claimed_by, CASE WHEN event_id % 8 IN (1, 2) THEN 'tok' || event_id END AS claim_token, CASE WHEN event_id % 10 = 0 THEN 'old error' END AS error_message FROM events"""
LAPSED = f"(status IN ('CLAIMED', 'RUNNING') AND lease_expires_at < {NOW} - INTERVAL 30 SECOND)"
DUE = f"((status IN ('QUEUED', 'RETRY_WAIT') AND available_at <= {NOW}) OR {LAPSED}) AND attempt_count < max_attempts"
ORDER = "priority, available_at, created_at, job_id"
WORKERS = ["alpha", "beta", "gamma", "delta"]


def now() -> F.Column:
    return F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = view(spark, sf_dir, "events", QUEUE)
    none = {"completed_at": F.lit(None).cast("timestamp_ntz"), "error_code": F.lit(None).cast("string")}
    return got.withColumns(none)


@query(f"SELECT job_id, status, priority FROM ({QUEUE}) WHERE {DUE} ORDER BY {ORDER} LIMIT 50")
def job_dequeue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.dequeue(queue(spark, sf_dir), now(), 50).select("job_id", "status", "priority")


@query(f"SELECT job_id, status AS from_status, 'FAILED' AS status, 'MAX_ATTEMPTS_EXHAUSTED' AS error_code, coalesce(error_message, 'Maximum job attempts exhausted.') AS error_message FROM ({QUEUE}) WHERE attempt_count >= max_attempts AND (status = 'RETRY_WAIT' OR {LAPSED})")
def job_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.exhausted(queue(spark, sf_dir), now()).select("job_id", "from_status", "status", "error_code", "error_message")


@query(f"""SELECT job_id, from_status, 'CLAIMED' AS status, CASE n WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' WHEN 3 THEN 'delta' ELSE 'gamma' END AS claimed_by, attempt_count + 1 AS attempt_count, {NOW} + INTERVAL 120 SECOND AS lease_expires_at FROM
  (SELECT job_id, status AS from_status, attempt_count, row_number() OVER (ORDER BY {ORDER}) AS n FROM ({QUEUE}) WHERE {DUE}) WHERE n <= 4""")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claim(queue(spark, sf_dir), WORKERS, now()).select("job_id", "from_status", "status", "claimed_by", "attempt_count", "lease_expires_at")


HELD = f"status IN ('CLAIMED', 'RUNNING') AND lease_expires_at > {NOW} AND job_id % 3 <> 0"
RESULT = "CASE job_id % 4 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'NEEDS_INPUT' ELSE 'CANCELLED' END"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as their workers know them; every third holds an old token."""
    got = queue(spark, sf_dir).where("claim_token IS NOT NULL")
    return got.select("job_id", "claimed_by", F.expr("CASE WHEN job_id % 3 = 0 THEN 'stale' ELSE claim_token END").alias("claim_token"))


@query(f"SELECT job_id, 'RUNNING' AS from_status, {RESULT} AS status, CASE WHEN {RESULT} <> 'NEEDS_INPUT' THEN {NOW} END AS completed_at, CASE WHEN {RESULT} = 'NEEDS_INPUT' THEN 'SUCCEEDED' ELSE {RESULT} END AS attempt_status FROM ({QUEUE}) WHERE {HELD}")
def job_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = claims(spark, sf_dir).withColumn("result", F.expr(RESULT))
    return jobs.finish(done, queue(spark, sf_dir), now()).select("job_id", "from_status", "status", "completed_at", "attempt_status")


#: What workers say of errors: a code, and a message that is longer than is kept.
GIVEN = ("CASE job_id % 4 WHEN 1 THEN 'PROVIDER' WHEN 2 THEN 'TIMEOUT' END", "CASE WHEN job_id % 5 IN (1, 2) THEN repeat('late ' || job_id || ' ', 300) END")
SAID = f"substr({GIVEN[1]}, 1, 2000)"
OVER = "attempt_count >= max_attempts"


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with what their workers say of an error."""
    return claims(spark, sf_dir).withColumns({"given_code": F.expr(GIVEN[0]), "given_message": F.expr(GIVEN[1])})


@query(f"SELECT job_id, CASE WHEN {OVER} THEN 'FAILED' ELSE 'RETRY_WAIT' END AS status, CASE WHEN {OVER} THEN available_at ELSE {NOW} + INTERVAL 30 SECOND END AS available_at, CASE WHEN {OVER} THEN 'MAX_ATTEMPTS_EXHAUSTED' ELSE {GIVEN[0]} END AS error_code, CASE WHEN {OVER} THEN coalesce({SAID}, 'Maximum job attempts exhausted.') ELSE {SAID} END AS error_message FROM ({QUEUE}) WHERE {HELD}")
def job_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retry(told(spark, sf_dir), queue(spark, sf_dir), now()).select("job_id", "status", "available_at", "error_code", "error_message")


ENDED = f"coalesce(substr({GIVEN[1]}, 1, 500), {{}})"


@query(f"""SELECT job_id, 'MAX_ATTEMPTS_EXHAUSTED' AS event_type, status AS from_status, 'FAILED' AS to_status, 'FINALIZE' AS stage, 'Maximum job attempts exhausted' AS message FROM ({QUEUE}) WHERE {OVER} AND (status = 'RETRY_WAIT' OR {LAPSED})
  UNION ALL SELECT job_id, 'CLAIMED', status, 'CLAIMED', 'CLAIM', 'Worker claimed job' FROM (SELECT job_id, status, row_number() OVER (ORDER BY {ORDER}) AS n FROM ({QUEUE}) WHERE {DUE}) WHERE n <= 4
  UNION ALL SELECT job_id, {RESULT}, 'RUNNING', {RESULT}, 'FINALIZE', {ENDED.format(f"'Job finished as ' || {RESULT}")} FROM ({QUEUE}) WHERE {HELD} AND job_id % 2 = 0
  UNION ALL SELECT job_id, CASE WHEN {OVER} THEN 'MAX_ATTEMPTS_EXHAUSTED' ELSE 'RETRY_SCHEDULED' END, 'RUNNING', CASE WHEN {OVER} THEN 'FAILED' ELSE 'RETRY_WAIT' END, CASE WHEN {OVER} THEN 'FINALIZE' ELSE 'RETRY' END,
    {ENDED.format(f"CASE WHEN {OVER} THEN 'Maximum job attempts exhausted' ELSE 'Retry scheduled' END")} FROM ({QUEUE}) WHERE {HELD} AND job_id % 2 = 1""")
def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows of one round: jobs without attempts left, claims, ends and retries."""
    rows, said = queue(spark, sf_dir), told(spark, sf_dir)
    ended = jobs.finish(said.where("job_id % 2 = 0").withColumn("result", F.expr(RESULT)), rows, now())
    again = jobs.retry(said.where("job_id % 2 = 1"), rows, now())
    out = jobs.exhausted_events(jobs.exhausted(rows, now())).unionByName(jobs.claim_events(jobs.claim(rows, WORKERS, now())))
    return out.unionByName(jobs.finish_events(ended)).unionByName(jobs.retry_events(again))


TOOK = f"CAST(greatest(0, floor((epoch_us({NOW}) - epoch_us(available_at)) / 1000)) AS DOUBLE)"


@query(f"""SELECT job_id, attempt_count + 1 AS attempt_number, CASE n WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' WHEN 3 THEN 'delta' ELSE 'gamma' END AS worker_id, 'CLAIMED' AS status, CAST(NULL AS DOUBLE) AS duration_ms, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS VARCHAR) AS error_message FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS n FROM ({QUEUE}) WHERE {DUE}) WHERE n <= 4
  UNION ALL SELECT job_id, attempt_count, claimed_by, CASE WHEN {RESULT} = 'NEEDS_INPUT' THEN 'SUCCEEDED' ELSE {RESULT} END, {TOOK}, {GIVEN[0]}, {SAID} FROM ({QUEUE}) WHERE {HELD} AND job_id % 2 = 0
  UNION ALL SELECT job_id, attempt_count, claimed_by, 'FAILED', {TOOK}, CASE WHEN {OVER} THEN 'MAX_ATTEMPTS_EXHAUSTED' ELSE {GIVEN[0]} END, CASE WHEN {OVER} THEN coalesce({SAID}, 'Maximum job attempts exhausted.') ELSE {SAID} END FROM ({QUEUE}) WHERE {HELD} AND job_id % 2 = 1
  UNION ALL SELECT job_id, attempt_count, claimed_by, 'LEASE_EXPIRED', {TOOK}, 'MAX_ATTEMPTS_EXHAUSTED', 'Lease expired on the final permitted attempt.' FROM ({QUEUE}) WHERE {OVER} AND {LAPSED}""")
def job_attempt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that one round begins, ends, sends back or takes away."""
    rows, said = queue(spark, sf_dir), told(spark, sf_dir)
    none = F.lit(None).cast("string")
    running = rows.where("claim_token IS NOT NULL").select("job_id", F.col("attempt_count").alias("attempt_number"), F.col("claimed_by").alias("worker_id"), "claim_token", F.lit("RUNNING").alias("status"), F.col("available_at").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("long").alias("duration_ms"), none.alias("error_code"), none.alias("error_message"))
    begun = jobs.claim_attempts(jobs.claim(rows, WORKERS, now()), now())
    ended = jobs.finish(said.where("job_id % 2 = 0").withColumn("result", F.expr(RESULT)), rows, now()).withColumn("attempt_status_", F.col("attempt_status"))
    again = jobs.retry(said.where("job_id % 2 = 1"), rows, now())
    closed = jobs.closed_attempts(running, said, ended, now(), F.col("attempt_status_")).unionByName(jobs.closed_attempts(running, said, again, now(), F.lit("FAILED")))
    gone = jobs.expired_attempts(running, jobs.exhausted(rows, now()), now())
    every = begun.unionByName(closed).unionByName(gone)
    return every.select("job_id", "attempt_number", "worker_id", "status", F.col("duration_ms").cast("double").alias("duration_ms"), "error_code", "error_message")


@query(f"SELECT job_id, {NOW} + INTERVAL 120 SECOND AS lease_expires_at FROM ({QUEUE}) WHERE {HELD}")
def job_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.heartbeat(claims(spark, sf_dir), queue(spark, sf_dir), now()).select("job_id", "lease_expires_at")


@query(f"SELECT job_id, 'RUNNING' AS status FROM ({QUEUE}) WHERE {HELD} AND status = 'CLAIMED'")
def job_mark_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.mark_running(claims(spark, sf_dir), queue(spark, sf_dir), now()).select("job_id", "status")


MOVES = " OR ".join(f"(a = '{s}' AND b IN ({', '.join(repr(t) for t in ts)}))" for s, ts in JOB_MOVES.items())
KINDS = "CASE {} % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(JOB_STATUS)) + " END"


@query(f"SELECT a AS from_status, b AS to_status, count(*) AS n_moves, bool_and({MOVES}) AS allowed FROM (SELECT {KINDS.format('event_id')} AS a, {KINDS.format('user_id')} AS b FROM events) GROUP BY a, b")
def job_transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "events").select(F.expr(KINDS.format("event_id")).alias("from_status"), F.expr(KINDS.format("user_id")).alias("to_status"))
    return got.groupBy("from_status", "to_status").agg(F.count(F.lit(1)).alias("n_moves"), F.bool_and(jobs.move_allowed(F.col("from_status"), F.col("to_status"))).alias("allowed"))


@query("SELECT user_id AS job_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt_number FROM events")
def job_attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt_number"))


@query("SELECT user_id AS job_id, event_id, CAST(greatest(0, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000)) AS DOUBLE) AS duration_ms FROM events QUALIFY lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    got = table(spark, sf_dir, "events").withColumn("before", before).where("before IS NOT NULL")
    return got.select(F.col("user_id").alias("job_id"), "event_id", jobs.duration_ms(F.col("before"), F.col("ts")).cast("double").alias("duration_ms"))


#: Terms of leases, which events stand for; each of the seven rules is broken by some.
TERMS = """SELECT event_id AS id, CAST(event_id % 5 * 40 - 20 AS INTEGER) AS lease, CAST(user_id % 4 * 30 - 10 AS INTEGER) AS heartbeat, CAST(event_id % 7 * 10 - 10 AS INTEGER) AS grace, CAST(event_id % 6 - 1 AS INTEGER) AS attempts, CAST(user_id % 4 AS INTEGER) AS n_backoff, CAST(event_id % 8 * 60 AS INTEGER) AS last_backoff FROM events"""


@query(f"""SELECT id, concat_ws(',', CASE WHEN lease <= 0 THEN 'LEASE' END, CASE WHEN heartbeat <= 0 THEN 'HEARTBEAT' END, CASE WHEN heartbeat >= lease THEN 'HEARTBEAT_NOT_SHORTER' END, CASE WHEN grace < 0 THEN 'GRACE' END, CASE WHEN attempts <= 0 THEN 'ATTEMPTS' END,
  CASE WHEN n_backoff < greatest(0, attempts - 1) THEN 'BACKOFF_TOO_SHORT' END, CASE WHEN n_backoff > 0 AND last_backoff = 0 THEN 'BACKOFF' END) AS errors FROM ({TERMS})""")
def lease_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events", TERMS)
    waits = F.expr("transform(if(n_backoff > 0, sequence(1, n_backoff), array()), i -> if(i = n_backoff, last_backoff, 30 * i))")
    return jobs.policy_errors(rows.withColumn("backoff", waits)).select("id", F.array_join("errors", ",").alias("errors"))


# -- streams, run over what is there


#: What a stream over the whole table has closed: windows that ended two hours before its last event or earlier.
CLOSED = "<= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events)"


@query(f"SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR {CLOSED}")
def stream_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events.drain(events.tumbling(events.read(spark, sf_dir)))
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events), b AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM a)
  SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n_events FROM b GROUP BY user_id, n HAVING max(ts) + INTERVAL 30 MINUTE {CLOSED}""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events.drain(events.sessions(events.read(spark, sf_dir)))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query()
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drain(events.once(events.read(spark, sf_dir), ["user_id", "event_type"])).select("event_id", "user_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def batch_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows over the whole table, in the times it holds."""
    got = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"), "event_type")
    return got.agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
