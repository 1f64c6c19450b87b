"""Candidates, matching, review, aggregation, commit, and integrity of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import mutations, quality, staging
from tallyloom.plans.registry import query, values
from tallyloom.plans.report_queries import ACCOUNTS, STATEMENT_ORD
from tallyloom.sources import schemas
from tallyloom.sources.readers import extraction, table

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END"
KIND = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'INCOME_STATEMENT' WHEN '2' THEN 'BALANCE_SHEET' WHEN '3' THEN 'CASH_FLOW' WHEN '4' THEN 'OTHER' END"
#: Lines of an order as extracted candidates: an order is a run; some lines lack a code or number.
CODE = "CASE l_orderkey % 3 WHEN 0 THEN 'AR' WHEN 1 THEN 'DEBT_ISSUED' ELSE CASE l_linenumber % 4 WHEN 0 THEN 'REV' WHEN 1 THEN 'TOTAL_ASSETS' WHEN 2 THEN 'TOTAL_LIAB' END END"
LABEL = "CASE l_partkey % 5 WHEN 0 THEN 'Piutang Pihak Ketiga' WHEN 1 THEN 'Piutang pihak  berelasi' WHEN 2 THEN 'Short-term bank loans' WHEN 3 THEN 'Pinjaman jangka panjang' ELSE 'Other balances' END"
LINES = f"""SELECT l_orderkey AS run_id, CAST(l_linenumber AS INTEGER) AS ord, {CODE} AS code, {LABEL} AS reported_label, CASE WHEN l_partkey % 7 <> 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS raw_value,
  CASE WHEN l_quantity <> 50 THEN CAST(l_quantity AS DECIMAL(28,6)) END AS numeric_value, CAST(CASE WHEN l_partkey % 3 <> 0 THEN CASE WHEN l_orderkey % 4 = 0 THEN 1000 ELSE CASE l_suppkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1 ELSE 0 END END END AS INTEGER) AS scale,
  CAST(CASE WHEN l_returnflag <> 'A' THEN 1 + l_partkey % 2 END AS INTEGER) AS source_page, 1 - l_discount AS extraction_confidence, CASE WHEN l_tax > 0 THEN 1 - l_tax END AS mapping_confidence,
  CASE l_returnflag WHEN 'N' THEN 'ACCEPTED' WHEN 'R' THEN 'REJECTED' ELSE CASE WHEN l_orderkey % 10 = 0 THEN 'PENDING' ELSE 'ACCEPTED' END END AS status, CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'USD' WHEN 2 THEN 'IDR' END AS currency, CASE WHEN l_partkey % 2 = 0 THEN 'text of ' || l_partkey END AS source_text FROM lineitem"""
#: One row a line number: the test tables may repeat one within an order.
CANDIDATES = f"WITH c0 AS ({LINES}), c AS (SELECT * EXCLUDE (ord, numeric_value, raw_value), ord, sum(numeric_value) AS numeric_value, min(raw_value) AS raw_value FROM c0 GROUP BY ALL)"
#: Orders as runs.
RUN_TERMS = "SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'SGD' WHEN 1 THEN '' END AS currency, CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'IDR' END AS company_currency, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 0 END AS INTEGER) AS unit_scale FROM orders"


def spark_sql(text: str) -> str:
    return text.replace("AS VARCHAR", "AS STRING")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with one row for each run, place and set of attributes."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tallyloom_lineitem")
    raw = spark.sql(spark_sql(LINES).replace("FROM lineitem", "FROM tallyloom_lineitem"))
    keys = [c for c in raw.columns if c not in ("numeric_value", "raw_value")]
    return raw.groupBy(*keys).agg(F.sum("numeric_value").alias("numeric_value"), F.min("raw_value").alias("raw_value"))


@query(f"SELECT o_custkey AS run_id, count(*) FILTER (WHERE s = 'PENDING') AS pending, count(*) FILTER (WHERE s = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE s = 'REJECTED') AS rejected, count(*) FILTER (WHERE s = 'COMMITTED') AS committed, count(*) AS total, count(*) FILTER (WHERE s <> 'PENDING') AS reviewed, CASE WHEN count(*) FILTER (WHERE s = 'PENDING') = 0 THEN 'READY_TO_COMMIT' ELSE 'PENDING_REVIEW' END AS run_status FROM (SELECT *, {STATUS} AS s FROM orders) GROUP BY o_custkey")
def candidate_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.expr(STATUS).alias("status"))
    return staging.review_counts(rows)


@query(f"SELECT coalesce(k, 'OTHER') AS statement_type, count(*) AS n_candidates, count(*) FILTER (WHERE s = 'PENDING') AS n_pending, CAST({STATEMENT_ORD.replace('statement_type', chr(34) + 'kk' + chr(34))} AS INTEGER) AS statement_ord FROM (SELECT {KIND} AS k, {STATUS} AS s, coalesce({KIND}, 'OTHER') AS kk FROM orders) GROUP BY ALL")
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.expr(KIND).alias("statement_type"), F.expr(STATUS).alias("status"))
    return staging.by_statement(rows)


RAW_CODE = "CASE o_orderkey % 5 WHEN 0 THEN 'rev' WHEN 1 THEN 'Ocf' WHEN 2 THEN 'AR' WHEN 3 THEN 'no_such' END"


@query(f"SELECT o_orderkey AS candidate_id, {RAW_CODE} AS canonical_code, a.name AS account_name, a.statement_type AS account_statement FROM orders LEFT JOIN (SELECT * FROM {ACCOUNTS}) a ON upper({RAW_CODE}) = a.code")
def candidate_account_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.expr(RAW_CODE).alias("canonical_code"))
    return staging.match_accounts(rows, F.broadcast(schemas.accounts(spark)))


@query("""WITH k AS (SELECT c_custkey AS run_id, CAST(i AS INTEGER) AS ordinal, CAST(1 + (i - 1) * (3 + c_custkey % 4) AS INTEGER) AS page_start, CAST(5 + (i - 1) * (3 + c_custkey % 4) AS INTEGER) AS page_end FROM customer, range(1, 6) t(i))
  SELECT o_orderkey AS candidate_id, o_custkey AS run_id, CAST(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 30 END AS DOUBLE) AS source_page,
  (SELECT CAST(min(ordinal) AS DOUBLE) FROM k WHERE k.run_id = o_custkey AND (CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 30 END) BETWEEN page_start AND page_end) AS chunk_ordinal FROM orders""")
def candidate_chunk_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.expr("CAST((ordinal - 1) * (3 + run_id % 4) AS INT)")
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ordinal")).select("run_id", "ordinal", (1 + step).alias("page_start"), (5 + step).alias("page_end"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("run_id"), F.expr("CAST(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 30 END AS INT)").alias("source_page"))
    return staging.attach_chunks(rows, chunks).withColumns({c: F.col(c).cast("double") for c in ("source_page", "chunk_ordinal")})


KEY = r"regexp_replace(lower(regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')), '[^a-z0-9]', '', 'g')"
DETECTED = """SELECT c_custkey AS run_id, CASE c_custkey % 4 WHEN 0 THEN ' s-' || (c_custkey % 150) WHEN 1 THEN '' ELSE 'nobody' END AS detected_ticker,
  CASE c_custkey % 3 WHEN 0 THEN replace('Supplier#' || lpad(CAST(c_custkey % 150 AS {}), 9, '0'), '#', ' # ') WHEN 1 THEN NULL ELSE 'Unknown Tbk' END AS detected_name,
  CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN CAST(0.949 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END END AS company_confidence, CAST(CASE WHEN c_custkey % 13 <> 0 THEN 2024 ELSE 0 END AS INTEGER) AS detected_year,
  CASE WHEN c_custkey % 17 <> 0 THEN 'H1' END AS detected_period, CASE WHEN c_custkey % 11 <> 0 THEN CAST(0.75 AS DOUBLE) END AS period_confidence FROM customer"""


@query(f"""WITH d AS ({DETECTED.format('VARCHAR')}), s AS (SELECT s_suppkey AS id, 'S-' || s_suppkey AS ticker, s_name AS name FROM supplier),
  t AS (SELECT {KEY.format('ticker')} AS k, min(id) AS id FROM s GROUP BY 1 HAVING k <> ''), n AS (SELECT {KEY.format('name')} AS k, min(id) AS id FROM s GROUP BY 1 HAVING k <> ''),
  m AS (SELECT d.*, coalesce(t.id, n.id) AS company_id FROM d LEFT JOIN t ON {KEY.format('detected_ticker')} = t.k LEFT JOIN n ON {KEY.format('detected_name')} = n.k)
  SELECT run_id, CAST(company_id AS DOUBLE) AS company_id, CASE WHEN company_id IS NULL OR coalesce(company_confidence, 0) < 0.95 THEN 'COMPANY' WHEN coalesce(detected_year, 0) = 0 OR coalesce(detected_period, '') = '' OR coalesce(period_confidence, 0) < 0.75 THEN 'PERIOD' END AS blocked_by FROM m""")
def issuer_match_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("tallyloom_customer")
    detected = spark.sql(DETECTED.format("STRING").replace("FROM customer", "FROM tallyloom_customer"))
    companies = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("name"))
    return staging.match_issuers(detected, companies).select("run_id", F.col("matched.company_id").cast("double").alias("company_id"), staging.gate().alias("blocked_by"))


AMOUNT = "numeric_value * coalesce(nullif(scale, 0), 1)"


USABLE = "FROM c WHERE status = 'ACCEPTED' AND code IS NOT NULL AND numeric_value IS NOT NULL"
LINE = "reported_label || ': ' || raw_value || CASE WHEN coalesce(source_page, 0) <> 0 THEN ' (page ' || source_page || ')' ELSE '' END"
#: The first candidate of a group, by all that may tell them apart.
FIRST = "arg_min({}, (ord, reported_label, raw_value IS NOT NULL, raw_value, source_text IS NOT NULL, source_text, currency IS NOT NULL, currency))"


def run_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("tallyloom_orders")
    return spark.sql(RUN_TERMS.replace("FROM orders", "FROM tallyloom_orders"))


def accepted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("status = 'ACCEPTED'")


@query(CANDIDATES + f""", r AS ({RUN_TERMS}), f AS (SELECT run_id, code, {FIRST.format("{'l': reported_label, 'r': raw_value, 's': source_text, 'c': currency}")} AS first, count(*) AS n, count(scale) AS scales, min(scale) AS lo, max(scale) AS hi, sum(numeric_value) AS plain, sum({AMOUNT}) AS scaled, count(DISTINCT source_page) AS pages, max(source_page) AS page,
    min(least(coalesce(extraction_confidence, 0), coalesce(mapping_confidence, 0))) AS confidence, string_agg({LINE}, ' | ' ORDER BY ord, {LINE}) AS provenance {USABLE} GROUP BY run_id, code)
  SELECT run_id, code, n, CAST(CASE WHEN lo = hi AND scales = n THEN plain ELSE scaled END AS DOUBLE) AS value, CASE WHEN lo = hi AND scales = n THEN lo ELSE 1 END AS scale, CAST(scaled AS DOUBLE) AS scaled_value, CAST(CASE WHEN pages = 1 THEN page END AS DOUBLE) AS source_page, confidence,
    coalesce(nullif(provenance, ''), nullif(first.s, ''), nullif(first.r, '')) AS raw_text, CASE WHEN n > 1 THEN coalesce(a.name, code) || ' — aggregated from ' || n || ' reviewed components' ELSE first.l END AS reported_label, coalesce(nullif(first.c, ''), nullif(r.currency, ''), company_currency) AS currency
  FROM f LEFT JOIN r USING (run_id) LEFT JOIN (SELECT code, name FROM {ACCOUNTS}) a USING (code)""")
def commit_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = staging.commit_entries(accepted_lines(spark, sf_dir), F.broadcast(schemas.accounts(spark)), run_terms(spark, sf_dir))
    return got.withColumn("source_page", F.col("source_page").cast("double"))


@query(CANDIDATES + f", r AS ({RUN_TERMS}) SELECT DISTINCT run_id, statement_type, coalesce(nullif(r.currency, ''), company_currency) AS currency, coalesce(nullif(unit_scale, 0), 1) AS unit_scale FROM (SELECT run_id, code {USABLE}) JOIN (SELECT code, statement_type FROM {ACCOUNTS}) a USING (code) JOIN r USING (run_id)")
def commit_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that commits need."""
    return staging.commit_statements(accepted_lines(spark, sf_dir), F.broadcast(schemas.accounts(spark)), run_terms(spark, sf_dir))


@query(CANDIDATES + f""", n AS (SELECT run_id, code, count(*) AS n {USABLE} GROUP BY ALL)
  SELECT run_id, ord, code, CASE WHEN code IS NOT NULL AND numeric_value IS NOT NULL THEN 'COMMITTED' ELSE status END AS status, CASE WHEN code IS NOT NULL AND numeric_value IS NOT NULL AND n > 1 THEN 'Aggregated into canonical ' || code || ' with reviewed ' || n || ' components.' ELSE 'seen' END AS review_note FROM c LEFT JOIN n USING (run_id, code) WHERE status = 'ACCEPTED'""")
def commit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted candidates after their runs are committed."""
    return staging.commit_candidates(accepted_lines(spark, sf_dir).withColumn("review_note", F.lit("seen"))).select("run_id", "ord", "code", "status", "review_note")


@query(CANDIDATES + f" SELECT run_id, 'PDF_AI_COMMIT' AS action, 'web-user' AS actor, 'ExtractionRun' AS entity, CAST(run_id AS VARCHAR) AS entity_id, count(*) || '{staging.COMMITTED[0]}' || count(DISTINCT code) || '{staging.COMMITTED[1]}' AS note {USABLE} GROUP BY run_id")
def commit_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.commit_audit(accepted_lines(spark, sf_dir))


PARTY = f"CASE WHEN regexp_matches(lower(reported_label), '{staging.THIRD}') THEN 'T' WHEN regexp_matches(lower(reported_label), '{staging.RELATED}') THEN 'R' END"
TERM = f"CASE WHEN regexp_matches(lower(reported_label), '{staging.SHORT}') THEN 'S' WHEN regexp_matches(lower(reported_label), '{staging.LONG}') THEN 'L' ELSE 'O' END"
SAFE = f"""SELECT run_id, code, count(*) AS n_candidates, count(*) <= 1 OR CASE WHEN code = 'AR' THEN count({PARTY}) = count(*) AND count(DISTINCT {PARTY}) = 2 WHEN code = 'DEBT_ISSUED' THEN count(DISTINCT {TERM}) = count(*) ELSE false END AS is_safe
  FROM c WHERE status = 'ACCEPTED' AND code IS NOT NULL AND numeric_value IS NOT NULL GROUP BY run_id, code"""


@query(f"{CANDIDATES} {SAFE}")
def safe_aggregate_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where("status = 'ACCEPTED' AND code IS NOT NULL AND numeric_value IS NOT NULL")
    return staging.safe_groups(rows)


RUNS = "SELECT o_orderkey AS run_id, o_custkey AS company, CASE WHEN o_orderkey % 19 <> 0 THEN year(o_orderdate) END AS year, 'FY' AS period, CASE WHEN o_orderkey % 23 = 0 THEN 'COMMITTED' ELSE 'READY_TO_COMMIT' END AS status, CAST(NULL AS BIGINT) AS report_id FROM orders"
REPORTS = "SELECT c_custkey AS report_id, c_custkey AS company, 1995 + c_custkey % 7 AS year, 'FY' AS period FROM customer"


@query(CANDIDATES + f""", r AS ({RUNS}), q AS ({REPORTS}), p AS (SELECT run_id, count(*) FILTER (WHERE status = 'PENDING') AS pending FROM c GROUP BY run_id),
  u AS (SELECT run_id, count(*) AS usable, CAST(sum(CASE WHEN code = 'TOTAL_ASSETS' THEN {AMOUNT} END) AS DOUBLE) AS a, CAST(sum(CASE WHEN code = 'TOTAL_LIAB' THEN {AMOUNT} END) AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS e FROM c WHERE status = 'ACCEPTED' AND code IS NOT NULL AND numeric_value IS NOT NULL GROUP BY run_id),
  s AS (SELECT run_id, count(*) FILTER (WHERE NOT is_safe) AS unsafe FROM ({SAFE}) GROUP BY run_id)
  SELECT r.run_id, CASE WHEN r.status = 'COMMITTED' THEN 'ALREADY_COMMITTED' WHEN r.year IS NULL THEN 'NO_PERIOD' WHEN coalesce(pending, 0) > 0 THEN 'PENDING' WHEN coalesce(usable, 0) = 0 THEN 'NOTHING_ACCEPTED' WHEN coalesce(unsafe, 0) > 0 THEN 'UNSAFE_AGGREGATE'
    WHEN abs(a - l - e) > greatest(abs(a) * 0.0001, 1) THEN 'UNBALANCED' WHEN q.report_id IS NOT NULL AND q.report_id IS DISTINCT FROM r.report_id THEN 'REPORT_EXISTS' ELSE 'READY' END AS verdict
  FROM r LEFT JOIN p USING (run_id) LEFT JOIN u USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN q ON r.company = q.company AND r.year = q.year AND r.period = q.period""")
def commit_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("tallyloom_orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("tallyloom_customer")
    runs = spark.sql(RUNS.replace("FROM orders", "FROM tallyloom_orders"))
    reports = spark.sql(REPORTS.replace("FROM customer", "FROM tallyloom_customer"))
    return staging.commit_verdicts(lines(spark, sf_dir), runs, reports)


DECISION = "CASE o_orderkey % 6 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'PENDING' END"
ACCOUNT, OLD, RUN_STATUS = "CASE WHEN o_orderkey % 4 = 0 THEN 'REV' END", "CASE WHEN o_orderkey % 5 = 0 THEN 'OCF' END", "CASE WHEN o_custkey % 9 = 0 THEN 'COMMITTED' ELSE 'PENDING_REVIEW' END"
OUTCOME = f"CASE WHEN {DECISION} IS NULL THEN 'NONE' WHEN {RUN_STATUS} = 'COMMITTED' THEN 'LOCKED' WHEN {DECISION} = 'ACCEPTED' AND coalesce({ACCOUNT}, {OLD}) IS NULL THEN 'NEEDS_ACCOUNT' ELSE 'APPLIED' END"


@query(f"""SELECT candidate_id, outcome, CASE WHEN outcome = 'APPLIED' THEN d ELSE s END AS status, CASE WHEN outcome = 'APPLIED' THEN coalesce(a, old) ELSE old END AS canonical_code, CASE WHEN outcome = 'APPLIED' AND d = 'PENDING' THEN 'Returned to pending for review.' END AS review_note,
  outcome = 'APPLIED' AND d <> 'PENDING' AS is_reviewed FROM (SELECT o_orderkey AS candidate_id, {OUTCOME} AS outcome, {STATUS} AS s, {DECISION} AS d, {ACCOUNT} AS a, {OLD} AS old FROM orders)""")
def candidate_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    candidates = rows.select(F.col("o_orderkey").alias("candidate_id"), F.expr(RUN_STATUS).alias("run_status"), F.expr(STATUS).alias("status"), F.expr(OLD).alias("canonical_code"), F.lit(None).cast("string").alias("review_note"), F.lit(None).cast("timestamp").alias("reviewed_at"))
    decisions = rows.select(F.col("o_orderkey").alias("candidate_id"), F.expr(DECISION).alias("decision"), F.expr(ACCOUNT).alias("account"), F.lit(None).cast("string").alias("note")).where("decision IS NOT NULL")
    got = staging.review(candidates, decisions, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return got.select("candidate_id", "outcome", "status", "canonical_code", "review_note", F.col("reviewed_at").isNotNull().alias("is_reviewed"))


# -- integrity


@query("""SELECT 'orders.customer' AS relation, count(*) AS n_rows FROM orders WHERE o_custkey IS NOT NULL AND o_custkey + 3 NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'lineitem.order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
  UNION ALL SELECT 'customer.nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    found = [
        ("orders.customer", quality.orphans(t("orders").withColumn("k", F.col("o_custkey") + 3), "k", t("customer"), "c_custkey")),
        ("lineitem.order", quality.orphans(t("lineitem"), "l_orderkey", t("orders").where("o_orderstatus <> 'P'"), "o_orderkey")),
        ("customer.nation", quality.orphans(t("customer"), "c_nationkey", t("nation"), "n_nationkey")),
    ]
    out = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "n_rows") for name, df in found]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT l_orderkey AS run_id, l_linenumber AS ordinal, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ordinal"))
    return quality.repeated_keys(rows, ["run_id", "ordinal"])


@query("SELECT user_id AS dedup_key, count(*) AS n_rows FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY user_id HAVING count(*) > 1")
def partial_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that more than one active job holds; finished jobs may share a key."""
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "dedup_key")
    return quality.repeated_keys(rows, ["dedup_key"], F.col("event_type").isin("click", "view", "signup"))


@query("""SELECT o_orderkey AS id, 'PRICE_POSITIVE' AS check_name FROM orders WHERE NOT o_totalprice > 1000 UNION ALL SELECT o_orderkey, 'STATUS_DOMAIN' FROM orders WHERE NOT o_orderstatus IN ('F', 'O')
  UNION ALL SELECT o_orderkey, 'PRIORITY' FROM orders WHERE NOT (CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END) <> '1-URGENT'""")
def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"PRICE_POSITIVE": F.col("o_totalprice") > 1000, "STATUS_DOMAIN": F.col("o_orderstatus").isin("F", "O"), "PRIORITY": F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END") != "1-URGENT"}
    return quality.failed_checks(table(spark, sf_dir, "orders"), "o_orderkey", checks).withColumnRenamed("o_orderkey", "id")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS owner FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'NEW', o_custkey + 1 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 = 0 UNION ALL SELECT -o_orderkey, 'NEW', o_custkey + 1 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    new = old.where("id % 5 = 0").select(F.expr("CASE WHEN id % 7 = 0 THEN id ELSE -id END").alias("id"), F.lit("NEW").alias("status"), (F.col("owner") + 1).alias("owner"))
    return mutations.upsert(old, new, ["id"])


@query("SELECT l_orderkey AS report_id, l_linenumber AS ord, l_quantity AS value FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("value"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("report_id"), F.lit(1).alias("ord"), F.col("o_totalprice").alias("value"))
    return mutations.replace_children(old, new, "report_id")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT o_custkey + 10000000, min(o_orderpriority) FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    # A customer's orders all claim one key, and some have none.
    more = table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_custkey % 9 <> 0 THEN o_custkey + 10000000 END").alias("id"), F.col("o_orderpriority").alias("name"))
    return mutations.insert_new(old, more.unionByName(old.select("id", F.lit("never").alias("name"))), ["id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'UPLOADED' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS amount, o_orderstatus = 'F' AS changed FROM orders")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    return mutations.update(rows, F.col("status") == "F", {"amount": F.lit(0.0), "status": F.lit("UPLOADED")})


# -- validation of inputs


SWITCH = "CASE event_id % 9 WHEN 0 THEN ' YES ' WHEN 1 THEN '' WHEN 3 THEN '0' WHEN 4 THEN event_type WHEN 5 THEN 'On' WHEN 6 THEN 'off' WHEN 7 THEN 'FALSE' WHEN 8 THEN ' 1 ' END"


@query(f"""SELECT id, CASE WHEN v = '' THEN 'false' WHEN v IN ('1', 'true', 'yes', 'on') THEN 'true' WHEN v IN ('0', 'false', 'no', 'off') THEN 'false' END AS flag FROM (SELECT event_id AS id, lower(trim(coalesce({SWITCH}, ''))) AS v FROM events)""")
def flags_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), S.flag(F.expr(SWITCH)).cast("string").alias("flag"))


@query("""SELECT event_id AS id, v2, legacy, worker, CASE WHEN NOT v2 AND NOT legacy THEN 'NO_UPLOAD_PATH' WHEN v2 AND NOT worker THEN 'NEEDS_WORKER' END AS error FROM (SELECT event_id, event_type IN ('view', 'click') AS v2, user_id % 2 = 0 AS legacy, event_id % 3 = 0 AS worker FROM events)""")
def flags_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of three kinds, and why a combination isn't safe; an event stands for a deployment."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type IN ('view', 'click') AS v2", "user_id % 2 = 0 AS legacy", "event_id % 3 = 0 AS worker")
    v2, legacy, worker = F.col("v2"), F.col("legacy"), F.col("worker")
    return rows.withColumn("error", F.when(~v2 & ~legacy, "NO_UPLOAD_PATH").when(v2 & ~worker, "NEEDS_WORKER"))


@query("""SELECT s_suppkey AS id, upper(t) AS ticker, length(t) BETWEEN 1 AND 12 AND length(s_name) >= 2 AND length(c) = 2 AND m BETWEEN 1 AND 12 AS valid FROM
  (SELECT *, trim(CASE s_suppkey % 3 WHEN 0 THEN ' ab' || s_suppkey ELSE CASE s_suppkey % 3 WHEN 1 THEN '' ELSE 'a ticker that is long' END END) AS t, CASE s_suppkey % 2 WHEN 0 THEN 'id' ELSE 'idn' END AS c, s_suppkey % 14 AS m FROM supplier)""")
def company_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN ' ab' || s_suppkey WHEN 1 THEN '' ELSE 'a ticker that is long' END").alias("ticker"), F.col("s_name").alias("name"), F.expr("CASE s_suppkey % 2 WHEN 0 THEN 'id' ELSE 'idn' END").alias("country"), F.expr("s_suppkey % 14").alias("fye"))
    t = F.upper(S.trim_all("ticker"))
    return rows.select("id", t.alias("ticker"), (F.length(t).between(1, 12) & (F.length("name") >= 2) & (F.length("country") == 2) & F.col("fye").between(1, 12)).alias("valid"))


@query(f"""SELECT code, regexp_full_match(code, '[A-Z0-9_]+') AND length(code) BETWEEN 2 AND 50 AND length(name) BETWEEN 2 AND 160 AS valid FROM (SELECT code, name FROM {ACCOUNTS} UNION ALL SELECT DISTINCT p_brand, p_type FROM part UNION ALL SELECT 'A', 'one sign' UNION ALL SELECT 'lower', 'x y')""")
def account_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("name")).distinct()
    rows = schemas.accounts(spark).select("code", "name").unionByName(more).unionByName(spark.createDataFrame([("A", "one sign"), ("lower", "x y")], "code string, name string"))
    return rows.select("code", (F.col("code").rlike("^[A-Z0-9_]+$") & F.length("code").between(2, 50) & F.length("name").between(2, 160)).alias("valid"))


@query("SELECT o_orderkey AS id, y BETWEEN 2000 AND 2100 AND p IN ('Q1', 'H1', 'Q3', 'FY') AND v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AS valid, y BETWEEN 1900 AND 2200 AS year_known FROM (SELECT o_orderkey, year(o_orderdate) AS y, CASE o_orderkey % 5 WHEN 0 THEN 'Q1' WHEN 1 THEN 'H1' WHEN 2 THEN 'Q3' WHEN 3 THEN 'FY' ELSE 'MONTHLY' END AS p, CASE WHEN o_orderkey % 6 = 0 THEN CAST('nan' AS DOUBLE) WHEN o_orderkey % 6 = 1 THEN CAST('inf' AS DOUBLE) ELSE o_totalprice END AS v FROM orders)")
def report_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'Q1' WHEN 1 THEN 'H1' WHEN 2 THEN 'Q3' WHEN 3 THEN 'FY' ELSE 'MONTHLY' END").alias("p"), F.expr("CASE WHEN o_orderkey % 6 = 0 THEN double('nan') WHEN o_orderkey % 6 = 1 THEN double('infinity') ELSE o_totalprice END").alias("v"))
    return rows.select("id", (F.col("y").between(2000, 2100) & F.col("p").isin("Q1", "H1", "Q3", "FY") & S.finite("v")).alias("valid"), F.col("y").between(1900, 2200).alias("year_known"))


@query("SELECT l_orderkey AS run_id, l_linenumber AS ord, l_partkey AS part, CASE WHEN l_discount IS NOT NULL THEN greatest(0, least(1, l_discount * 20 - 0.3::DOUBLE)) END AS confidence, substr(l_returnflag || l_linestatus || 'text', 1, 500) AS label FROM lineitem")
def staged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("part"), S.clamp(F.col("l_discount") * 20 - 0.3).alias("confidence"), S.cut(F.concat("l_returnflag", "l_linestatus", F.lit("text")), 500).alias("label"))


@query("SELECT doc_id, substr(text, 1, 500) AS reported_label, substr(text, 1, 250) AS raw_value, substr(text, 1, 2000) AS source_text, length(substr(text, 1, 12000)) AS n_kept FROM documents")
def staged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to what a label, a raw value, a source text and a chunk may have."""
    return table(spark, sf_dir, "documents").select("doc_id", S.cut("text", 500).alias("reported_label"), S.cut("text", 250).alias("raw_value"), S.cut("text", 2000).alias("source_text"), F.length(S.cut("text", staging.CHUNK_TEXT)).cast("long").alias("n_kept"))


@query("""SELECT c_custkey AS run_id, CAST(i AS INTEGER) AS ord, CASE WHEN c_custkey % 2 = 0 THEN 'usd' WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 4 = 1 THEN 'SGD' ELSE 'EUR' END ELSE 'IDR' END AS currency, CAST(CASE WHEN i = 0 THEN 1000 WHEN c_custkey % 3 = 0 THEN 5 ELSE 1 END AS INTEGER) AS scale, CASE WHEN i = 0 THEN 'REV' END AS code,
  CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mapping_confidence, CAST(CASE WHEN i = 0 AND c_custkey % 6 <> 0 THEN 2 END AS DOUBLE) AS chunk_ordinal FROM customer, range(0, 2) t(i) WHERE c_custkey % 7 <> 0""")
def extraction_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the extraction service parsed and staged; those without both lists aren't valid."""
    got = staging.staged(extraction(answers(spark, sf_dir)), F.broadcast(schemas.accounts(spark)))
    return got.select("run_id", "ord", "currency", "scale", "code", "mapping_confidence", F.col("chunk_ordinal").cast("double").alias("chunk_ordinal"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the service, of which some lack a currency, chunks, or both lists, and their companies' currency."""
    n = F.col("c_custkey")
    key = n.cast("string")
    scale = F.when(n % 3 == 0, '"detectedUnitScale":5,').otherwise("")
    currency = F.when(n % 2 == 0, '"currency":"usd",').otherwise('"currency":"",')
    chunks = F.when(n % 6 == 0, "").otherwise('{"pageStart":1,"pageEnd":2,"textSummary":"one"},{"pageStart":3,"pageEnd":9,"section":"S","chunkType":"TABLE","textSummary":""},{"pageStart":3,"pageEnd":5}')
    good = F.concat(
        F.lit('{"detectedCurrency":"'), F.when(n % 5 == 0, "").otherwise("IDR"), F.lit('",'), scale, F.lit('"chunks":['), chunks, F.lit('],"candidates":[{'), currency,
        F.lit('"reportedLabel":" Sales '), key, F.lit('","rawValue":"1","numericValue":1.5,"scale":1000,"sourcePage":4,"canonicalCode":"rev","extractionConfidence":2.0,"mappingConfidence":1.5},{'), currency,
        F.lit('"reportedLabel":"Other","rawValue":"2","numericValue":2,"scale":0,"canonicalCode":"none","mappingConfidence":0.5},{"reportedLabel":"No number","rawValue":"-","numericValue":null}]}'),
    )
    return table(spark, sf_dir, "customer").select(n.alias("run_id"), F.when(n % 4 == 1, "SGD").otherwise("EUR").alias("company_currency"), F.when(n % 7 == 0, '{"chunks":[]}').otherwise(good).alias("answer"))


@query("""SELECT c_custkey AS run_id, CAST(i AS INTEGER) AS ordinal, CASE WHEN c_custkey % 6 = 0 THEN 'SECTION' WHEN i = 2 THEN 'TABLE' END AS chunk_type, CAST(CASE WHEN c_custkey % 6 <> 0 THEN CASE i WHEN 1 THEN 1 ELSE 3 END END AS DOUBLE) AS page_start, CAST(CASE WHEN c_custkey % 6 <> 0 THEN CASE i WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 5 END END AS DOUBLE) AS page_end,
  CASE WHEN c_custkey % 6 = 0 THEN 'Financial Statements' WHEN i = 2 THEN 'S' END AS section, CASE WHEN c_custkey % 6 = 0 THEN 'AI extraction result' WHEN i = 1 THEN 'one' WHEN i = 2 THEN '' END AS text, sha256(CASE WHEN c_custkey % 6 = 0 THEN 'AI extraction result' WHEN i = 1 THEN 'one' WHEN i = 2 THEN '' END) AS text_hash
  FROM customer, range(1, 4) t(i) WHERE c_custkey % 7 <> 0 AND (c_custkey % 6 <> 0 OR i = 1)""")
def extraction_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the same answers; one without any gets one for the whole."""
    got = staging.staged_chunks(extraction(answers(spark, sf_dir)))
    return got.withColumns({c: F.col(c).cast("double") for c in ("page_start", "page_end")})
