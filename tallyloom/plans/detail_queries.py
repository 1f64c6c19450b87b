"""Lists, lookups and details of reports, runs and accounts, and the uploads' states.

Orders stand for reports and runs, customers for companies, line items for entries and candidates, events for
warnings, chunks and uploads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import details
from tallyloom.plans.queue_queries import view
from tallyloom.plans.registry import query, values
from tallyloom.plans.report_queries import ACCOUNTS, STATEMENT_ORD
from tallyloom.sources import schemas
from tallyloom.sources.readers import table

COMPANY = "SELECT c_custkey AS company_id, 'T' || c_custkey AS ticker, c_name AS company_name, c_custkey % 5 <> 0 AS is_active FROM customer"
REPORT = "SELECT o_orderkey AS report_id, o_custkey AS company_id, CAST(year(o_orderdate) AS INTEGER) AS year, CASE o_orderkey % 4 WHEN 0 THEN 'Q1' WHEN 1 THEN 'H1' WHEN 2 THEN 'Q3' ELSE 'FY' END AS period FROM orders"
ENTRY = """SELECT l_orderkey AS report_id, CAST(l_linenumber AS INTEGER) AS ord, CASE l_partkey % 6 WHEN 0 THEN 'AR' WHEN 1 THEN 'AP' WHEN 2 THEN 'REV' WHEN 3 THEN 'TOTAL_ASSETS' WHEN 4 THEN 'OCF' ELSE 'NOT_KNOWN' END AS code,
  CAST(l_extendedprice AS DECIMAL(28,6)) AS value, CAST(CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS INTEGER) AS source_page, l_linestatus AS status FROM lineitem"""
WARNING = "SELECT event_id AS warning_id, event_id * 3 % 1000 + 1 AS report_id, event_type AS code, event_id % 2 = 0 AS resolved FROM events"
CHUNK = "SELECT event_id AS ordinal, event_id * 7 % 1000 + 1 AS report_id, event_type AS section FROM events"
PLAIN = "CASE WHEN contains(CAST({0} AS VARCHAR), '.') THEN regexp_replace(CAST({0} AS VARCHAR), '\\.?0+$', '') ELSE CAST({0} AS VARCHAR) END"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer", COMPANY)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders", REPORT)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem", ENTRY)


@query("SELECT 'ok' AS status, count(*) AS n_tables FROM (SELECT 1 FROM region HAVING count(*) > 0 UNION ALL SELECT 1 FROM nation HAVING count(*) > 0)")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the store answers: its smallest tables can be read and aren't empty."""
    rows = table(spark, sf_dir, "region").select(F.lit("region").alias("t")).unionByName(table(spark, sf_dir, "nation").select(F.lit("nation").alias("t")))
    return rows.agg(F.countDistinct("t").alias("n_tables")).select(F.lit("ok").alias("status"), "n_tables")


@query(f"SELECT ticker, company_name FROM ({COMPANY}) WHERE is_active")
def company_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.active(companies(spark, sf_dir), "ticker", "company_name")


#: Parts as accounts, of which some are closed and some calculated.
MASTER = "SELECT p_partkey AS account_id, p_brand AS code, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'CASH_FLOW' WHEN 2 THEN 'BALANCE_SHEET' ELSE 'INCOME_STATEMENT' END AS statement_type, CAST(p_size AS INTEGER) AS sort_order, p_partkey % 5 <> 0 AS is_active, p_partkey % 7 = 0 AS is_calculated FROM part"


@query(f"SELECT account_id, code, name, statement_type FROM ({MASTER}) WHERE is_active AND NOT is_calculated ORDER BY {STATEMENT_ORD}, sort_order")
def account_extractable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active accounts that aren't calculated."""
    return details.extractable(view(spark, sf_dir, "part", MASTER)).select("account_id", "code", "name", "statement_type")


@query(f"SELECT account_id, statement_type, sort_order, CAST(row_number() OVER (PARTITION BY statement_type ORDER BY sort_order, name, account_id) AS INTEGER) AS place FROM ({MASTER}) WHERE is_active")
def account_master_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active accounts in order of statement, sort order and name, with their place in the statement."""
    return details.account_master(view(spark, sf_dir, "part", MASTER)).select("account_id", "statement_type", "sort_order", "place")


MAPPING = "SELECT p_partkey AS mapping_id, p_name || ' ' || p_partkey AS source_label, CASE p_partkey % 4 WHEN 0 THEN 'AR' WHEN 1 THEN 'AP' WHEN 2 THEN 'REV' ELSE 'NOT_KNOWN' END AS code FROM part"


@query(f"SELECT mapping_id, source_label, a.code, a.name, a.statement_type FROM ({MAPPING}) m JOIN {ACCOUNTS.replace('AS t(', 'AS a(')} ON m.code = a.code ORDER BY source_label")
def mapping_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.mapping_list(view(spark, sf_dir, "part", MAPPING), F.broadcast(schemas.accounts(spark))).select("mapping_id", "source_label", "code", "name", "statement_type")


LOOKED_UP = [1, 7, 42, -5]


@query(f"SELECT report_id, company_id, year, period FROM ({REPORT}) WHERE report_id IN ({', '.join(map(str, LOOKED_UP))}) OR (company_id = 10 AND year = 1996 AND period = 'FY')")
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by their id, and by company, year and period; both filters reach the scan."""
    return reports(spark, sf_dir).where(F.col("report_id").isin(LOOKED_UP) | ((F.col("company_id") == 10) & (F.col("year") == 1996) & (F.col("period") == "FY")))


@query(f"SELECT report_id, year, period FROM ({REPORT}) JOIN ({COMPANY}) USING (company_id) WHERE ticker = 'T10'")
def reports_of_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by what their company has."""
    return reports(spark, sf_dir).join(companies(spark, sf_dir).where("ticker = 'T10'"), "company_id", "left_semi").select("report_id", "year", "period")


@query(f"""SELECT report_id, coalesce(ord, 0) AS ord, ticker || ' · ' || period || ' ' || year AS label, e.code, a.name AS account_name, CASE a.statement_type WHEN 'INCOME_STATEMENT' THEN 'Income Statement' WHEN 'BALANCE_SHEET' THEN 'Balance Sheet' WHEN 'CASH_FLOW' THEN 'Cash Flow' WHEN 'OTHER' THEN 'Other' END AS statement,
  {PLAIN.format('value')} AS value FROM ({REPORT}) r JOIN ({COMPANY}) USING (company_id) LEFT JOIN ({ENTRY}) e USING (report_id) LEFT JOIN {ACCOUNTS.replace('AS t(', 'AS a(')} ON e.code = a.code""")
def report_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = details.report_entries(reports(spark, sf_dir), companies(spark, sf_dir), entries(spark, sf_dir), F.broadcast(schemas.accounts(spark)))
    label = details.report_label(F.col("ticker"), F.col("period"), F.col("year"))
    statement = details.chosen_label(F.col("statement_type"), details.STATEMENT_LABELS)
    return got.select("report_id", F.coalesce("ord", F.lit(0)).alias("ord"), label.alias("label"), "code", "account_name", statement.alias("statement"), details.plain_number(F.col("value")).alias("value"))


@query(f"""SELECT report_id, count(w.code) AS n_open, coalesce(string_agg(w.code, ',' ORDER BY warning_id), '') AS codes FROM ({REPORT}) LEFT JOIN (SELECT * FROM ({WARNING}) WHERE NOT resolved) w USING (report_id) GROUP BY report_id""")
def report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report with its unresolved warnings."""
    open_ = view(spark, sf_dir, "events", WARNING).where("NOT resolved")
    got = details.gathered(reports(spark, sf_dir), open_, "report_id", "codes", [F.col("warning_id")], F.col("code"))
    return got.select("report_id", F.size("codes").cast("long").alias("n_open"), F.array_join("codes", ",").alias("codes"))


@query(f"""WITH c AS (SELECT report_id, count(*) AS n, string_agg(e.code || ':' || coalesce(a.name, '?'), ',' ORDER BY source_page NULLS LAST, ord, e.code) AS listed FROM ({ENTRY}) e LEFT JOIN {ACCOUNTS.replace('AS t(', 'AS a(')} ON e.code = a.code GROUP BY report_id),
  k AS (SELECT report_id, count(*) AS n, string_agg(section, ',' ORDER BY ordinal) AS sections FROM ({CHUNK}) GROUP BY report_id)
  SELECT report_id AS run_id, ticker, company_name, coalesce(c.n, 0) AS n_candidates, coalesce(listed, '') AS candidates, coalesce(k.n, 0) AS n_chunks, coalesce(sections, '') AS sections FROM ({REPORT}) JOIN ({COMPANY}) USING (company_id) LEFT JOIN c USING (report_id) LEFT JOIN k USING (report_id)""")
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run with its company, its candidates by page, those without one last, and its chunks."""
    known = schemas.accounts(spark).select("code", "name")
    candidates = entries(spark, sf_dir).join(known, "code", "left")
    got = reports(spark, sf_dir).join(companies(spark, sf_dir), "company_id")
    got = details.gathered(got, candidates, "report_id", "candidates", [*details.nulls_last(F.col("source_page")), F.col("ord"), F.col("code")], F.concat_ws(":", "code", F.coalesce("name", F.lit("?"))))
    got = details.gathered(got, view(spark, sf_dir, "events", CHUNK), "report_id", "sections", [F.col("ordinal")], F.col("section"))
    return got.select(F.col("report_id").alias("run_id"), "ticker", "company_name", F.size("candidates").cast("long").alias("n_candidates"), F.array_join("candidates", ",").alias("candidates"), F.size("sections").cast("long").alias("n_chunks"), F.array_join("sections", ",").alias("sections"))


@query(f"""WITH e AS (SELECT report_id, string_agg(code || '=' || {PLAIN.format('value')}, ',' ORDER BY code, ord, value) AS listed, bool_or(code = 'AR') AS ar, bool_or(code = 'AP') AS ap FROM ({ENTRY}) WHERE code IN ('AR', 'AP') AND status = 'F' GROUP BY report_id),
  c AS (SELECT report_id, string_agg(code || '@' || coalesce(CAST(source_page AS VARCHAR), '-'), ',' ORDER BY source_page NULLS LAST, ord, code) AS listed FROM ({ENTRY}) WHERE code IN ('AR', 'AP') AND status = 'O' GROUP BY report_id)
  SELECT report_id, ticker, company_name, year, period, coalesce(e.listed, '') AS entries, coalesce(c.listed, '') AS candidates, coalesce(ar, false) AS ar_in_canonical, coalesce(ap, false) AS ap_in_canonical FROM ({REPORT}) JOIN ({COMPANY}) USING (company_id) LEFT JOIN e USING (report_id) LEFT JOIN c USING (report_id)""")
def diagnostics_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report with its receivables and payables, those entered and those still staged."""
    every = entries(spark, sf_dir).where("code IN ('AR', 'AP')")
    got = reports(spark, sf_dir).join(companies(spark, sf_dir), "company_id")
    entered = F.struct("code", details.plain_number(F.col("value")).alias("value"))
    got = details.gathered(got, every.where("status = 'F'"), "report_id", "entries", [F.col("code"), F.col("ord"), F.col("value")], entered)
    staged = F.struct("code", F.coalesce(F.col("source_page").cast("string"), F.lit("-")).alias("page"))
    got = details.gathered(got, every.where("status = 'O'"), "report_id", "candidates", [*details.nulls_last(F.col("source_page")), F.col("ord"), F.col("code")], staged)
    holds = lambda code: F.exists("entries", lambda e: e["code"] == code)
    return got.select(
        "report_id", "ticker", "company_name", "year", "period", F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["code"], e["value"])), ",").alias("entries"),
        F.array_join(F.transform("candidates", lambda e: F.concat_ws("@", e["code"], e["page"])), ",").alias("candidates"), holds("AR").alias("ar_in_canonical"), holds("AP").alias("ap_in_canonical"),
    )


@query(f"""WITH e AS (SELECT e.*, a.statement_type FROM ({ENTRY}) e LEFT JOIN {ACCOUNTS.replace('AS t(', 'AS a(')} ON e.code = a.code)
  SELECT report_id, ord, code, CASE WHEN statement_type <> 'OTHER' THEN report_id || '-' || statement_type END AS statement_id FROM e""")
def statement_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its report's statement of the account's type."""
    rows, accounts = entries(spark, sf_dir), F.broadcast(schemas.accounts(spark))
    return details.with_statement(rows, accounts, details.statements_of(rows, accounts)).select("report_id", "ord", "code", "statement_id")


TERMS = ["  Steel ", "BRAND#1", "", "nothing like it", "nama", "size stated", "alias 2", "held"]
SIX = f"SELECT *, CASE WHEN sort_order % 20 <> 0 THEN 'Nama ' || name END AS display_name, 'size stated' AS description, CASE WHEN sort_order % 30 = 0 THEN 'What is held' END AS definition FROM ({MASTER})"


@query(f"""SELECT q.term, a.account_id FROM {values([(t,) for t in TERMS], 'term').replace('AS t(', 'AS q(')}, ({SIX}) a
  WHERE contains(lower(code || ' ' || name || ' ' || coalesce(display_name, '') || ' ' || description || ' ' || coalesce(definition, '') || ' ' || lower(code) || ' alias ' || sort_order), lower(trim(q.term)))""")
def dictionary_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in all six texts of an account."""
    got = view(spark, sf_dir, "part", SIX).withColumn("aliases", F.array(F.lower("code"), F.concat(F.lit("alias "), F.col("sort_order").cast("string"))))
    return details.searched(got, TERMS).select("term", "account_id")


LIST = """CASE event_id % 3 WHEN 0 THEN '["' || event_type || '", ' || event_id || ', null, {"k": 1}, "7", ["x"], true]' WHEN 1 THEN '[]' ELSE '{"a": "b"}' END"""


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',7' ELSE '' END AS kept FROM (SELECT event_id, event_type, {LIST} AS list FROM events) WHERE json_valid(list)""")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an array of mixed JSON items keeps if only strings are wanted."""
    got = view(spark, sf_dir, "events", f"SELECT event_id, {LIST} AS list FROM events")
    return got.select("event_id", F.array_join(details.strings_of(F.col("list")), ",").alias("kept"))


# -- uploads

UPLOAD = """SELECT event_id AS job_id, 'f' || event_id || '.pdf' AS file_name, 'application/pdf' AS mime_type, CAST(event_id % 900 AS INTEGER) AS file_size, CASE event_id % 5 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'COMPLETED' ELSE 'UPLOADED' END AS status,
  CASE WHEN event_id % 5 IN (1, 2, 3) OR event_id % 10 = 4 THEN 'resp' || event_id END AS response_id, CASE event_id % 5 WHEN 3 THEN 'run' || event_id END AS run_id, CASE event_id % 2 WHEN 0 THEN 'T' || user_id END AS detected_ticker, CASE event_id % 2 WHEN 0 THEN 'Name ' || user_id END AS detected_name,
  CASE event_id % 4 WHEN 0 THEN '2024' END AS detected_year, CASE event_id % 4 WHEN 0 THEN 'FY' END AS detected_period, CASE event_id % 5 WHEN 2 THEN 'went wrong' END AS error_message, ts AS created_at FROM events"""
ANSWER = """SELECT event_id AS job_id, 'new' || event_id AS answer_id, CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'incomplete' ELSE 'completed' END AS state,
  CASE WHEN event_id % 11 = 0 THEN 'no file' END AS error, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'too long' END AS reason FROM events"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", UPLOAD)


@query(f"SELECT job_id, file_name FROM ({UPLOAD}) WHERE status = 'UPLOADED' AND response_id IS NULL ORDER BY created_at, job_id LIMIT 2")
def upload_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.upload_queue(uploads(spark, sf_dir), 2).select("job_id", "file_name")


STATE = "CASE WHEN state IN ('queued', 'in_progress') THEN 'PROCESSING' WHEN state = 'completed' THEN 'COMPLETED' ELSE {} END"


@query(f"""SELECT job_id, status AS from_status, CASE WHEN error IS NOT NULL THEN 'FAILED' ELSE {STATE.format('upper(state)')} END AS status, CASE WHEN error IS NULL THEN answer_id END AS response_id, run_id, error AS error_message FROM ({UPLOAD}) JOIN ({ANSWER}) USING (job_id) WHERE status = 'UPLOADED' AND response_id IS NULL
  UNION ALL SELECT job_id, status, {STATE.format("'FAILED'")}, response_id, CASE WHEN state = 'completed' THEN 'run' || job_id END, CASE WHEN state NOT IN ('queued', 'in_progress', 'completed') THEN coalesce(nullif(error, ''), nullif(reason, ''), 'background response ' || state) ELSE error_message END FROM ({UPLOAD}) JOIN ({ANSWER}) USING (job_id) WHERE status = 'PROCESSING' AND response_id IS NOT NULL""")
def upload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that are handed over, and those that are asked for again, with their new state."""
    jobs, answers = uploads(spark, sf_dir), view(spark, sf_dir, "events", ANSWER)
    columns = ("job_id", "from_status", "status", "response_id", "run_id", "error_message")
    again = details.asked_again(jobs, answers, F.concat(F.lit("run"), F.col("job_id").cast("string")))
    return details.handed_over(jobs, answers).select(*columns).unionByName(again.select(*columns))


@query(f"""SELECT u.job_id, CAST(CASE WHEN j.job_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS changed, CASE WHEN j.job_id IS NOT NULL THEN 'UPLOADED' END AS status, CASE WHEN j.job_id IS NOT NULL THEN 'again' || u.job_id || '.pdf' END AS file_name, CASE WHEN j.job_id IS NOT NULL THEN 'application/pdf' END AS mime_type,
  CAST(NULL AS VARCHAR) AS response_id, CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS detected_ticker, CAST(NULL AS VARCHAR) AS error_message FROM (SELECT event_id AS job_id FROM events WHERE event_type = 'error') u LEFT JOIN (SELECT * FROM ({UPLOAD}) WHERE status = 'FAILED') j USING (job_id)""")
def upload_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files given again for uploads that failed; ``changed`` is 0 where the upload hasn't."""
    given = view(spark, sf_dir, "events", "SELECT event_id AS job_id, 'again' || event_id || '.pdf' AS new_name, 'application/pdf' AS new_mime, CAST(5 AS INTEGER) AS new_size FROM events WHERE event_type = 'error'")
    return details.reset_failed(uploads(spark, sf_dir), given).select("job_id", "changed", "status", "file_name", "mime_type", "response_id", "run_id", "detected_ticker", "error_message")

