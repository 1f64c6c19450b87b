"""Lists in order, counts of pages, open jobs, nested arrays, files' first bytes, and gaps in the dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import details, documents, pipeline
from tallyloom.plans.detail_queries import SIX
from tallyloom.plans.queue_queries import GROUP_SQL, LIST, listed, view
from tallyloom.plans.registry import query
from tallyloom.sources import ranges
from tallyloom.sources.readers import table
from tallyloom.sources.schemas import PERIODS

OPEN = """SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'R' || event_id END AS run_id, event_type AS status, ts AS updated_at, props AS content FROM events"""


@query(f"SELECT job_id, run_id, status, updated_at FROM ({OPEN}) WHERE run_id IS NULL ORDER BY updated_at DESC, job_id LIMIT 100")
def job_open_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest hundred jobs without a run; the limit is the list's own."""
    return details.open_jobs(view(spark, sf_dir, "events", OPEN))


PERIOD = f"CASE o_orderkey % {len(PERIODS)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PERIODS)) + " END"
REPORT = f"SELECT o_orderkey AS report_id, CAST(year(o_orderdate) AS INTEGER) AS year, {PERIOD} AS period, o_custkey FROM orders"


@query(f"SELECT report_id, year, ticker, period, CAST(row_number() OVER (PARTITION BY year ORDER BY ticker, list_position([{', '.join(map(repr, PERIODS))}], period), report_id) AS INTEGER) AS place FROM (SELECT r.*, c_mktsegment || '-' || (c_custkey % 40) AS ticker FROM ({REPORT}) r JOIN customer ON o_custkey = c_custkey)")
def reports_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by year, latest first, and their company's ticker."""
    companies = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_mktsegment || '-' || (c_custkey % 40)").alias("ticker"))
    rows = view(spark, sf_dir, "orders", REPORT).join(companies, F.col("o_custkey") == F.col("c_custkey"))
    return details.in_order(rows).select("report_id", "year", "ticker", "period", "place")


SIZES = [1, 7, 20, 300]


@query(LIST + f"SELECT status_group, reports AS total, CAST(asked AS INTEGER) AS asked, CAST(least(50, greatest(5, asked)) AS INTEGER) AS size, CAST(greatest(1, ceil(reports / CAST(least(50, greatest(5, asked)) AS DOUBLE))) AS INTEGER) AS pages FROM ({GROUP_SQL}), (SELECT unnest({SIZES}) AS asked)")
def pipeline_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.page_counts(listed(spark, sf_dir), SIZES)


KEPT = ("ACCEPTED", "REJECTED", "PENDING")
LINE = "CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'R' THEN 'REJECTED' ELSE 'PENDING' END"


@query(f"SELECT o_orderkey AS run_id, o_orderstatus AS status, {', '.join(f'CAST(count(*) FILTER (WHERE s = {s!r}) AS INTEGER) AS {s.lower()}' for s in KEPT)}, CAST(count(s) AS INTEGER) AS total FROM orders LEFT JOIN (SELECT l_orderkey, {LINE} AS s FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1, 2")
def run_without_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their nested candidates counted and then left out."""
    nested = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.struct(F.col("l_linenumber").alias("ord"), F.expr(LINE).alias("status")).alias("c")).groupBy("run_id").agg(F.collect_list("c").alias("candidates"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return details.counted_and_dropped(runs.join(nested, "run_id", "left"), "candidates", "status", KEPT)


LINKS = """CASE event_id % 4 WHEN 0 THEN '[{"label":"' || event_type || '","url":"u' || event_id || '"}, "text", 7, {"label":"second"}, ["x"], null]' WHEN 1 THEN '[]' WHEN 2 THEN '{"label":"alone"}' END"""


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || '=u' || event_id || ',second=' ELSE '' END AS links FROM events")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an array of mixed JSON items keeps if only objects are wanted."""
    got = view(spark, sf_dir, "events", f"SELECT event_id, {LINKS} AS list FROM events")
    pair = lambda x: F.concat(x["label"], F.lit("="), F.coalesce(x["url"], F.lit("")))
    return got.select("event_id", F.array_join(F.transform(details.objects_of(F.col("list"), "label", "url"), pair), ",").alias("links"))


FILE = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '%PDF-1.7' || chr(10) || text WHEN 1 THEN ' %PDF-1.7' || text ELSE text END AS body FROM documents"


@query(f"SELECT doc_id, coalesce(starts_with(body, '%PDF-'), false) AS is_pdf, sha256(body) AS checksum FROM ({FILE})")
def doc_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether whole files begin as PDF files do, and the hash of all their bytes."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("tallyloom_documents")
    rows = spark.sql(FILE.replace("FROM documents", "FROM tallyloom_documents")).withColumn("content", F.col("body").cast("binary"))
    return rows.select("doc_id", F.coalesce(documents.is_pdf(F.col("content")), F.lit(False)).alias("is_pdf"), F.sha2("content", 256).alias("checksum"))


@query()
def file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and first bytes of the stored tables' files, of which nothing else is read."""
    got = ranges.heads(spark, sf_dir, 4, ".parquet")
    return got.select(F.substring_index("path", "/", -2).alias("name"), "size", F.decode("content", "US-ASCII").alias("magic"))


@query(f"""SELECT account_id, concat_ws(',', CASE WHEN display_name IS NULL THEN 'display_name' END, CASE WHEN description_ = '' THEN 'description' END, CASE WHEN definition IS NULL THEN 'definition' END, CASE WHEN account_id % 6 = 0 THEN 'aliases' END) AS missing
  FROM (SELECT *, CASE WHEN account_id % 9 = 0 THEN '' ELSE description END AS description_ FROM ({SIX})) WHERE display_name IS NULL OR description_ = '' OR definition IS NULL OR account_id % 6 = 0""")
def dictionary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose dictionary row isn't complete, and the texts it lacks."""
    rows = view(spark, sf_dir, "part", SIX).withColumns({"description": F.expr("CASE WHEN account_id % 9 = 0 THEN ' ' ELSE description END"), "aliases": F.expr("CASE WHEN account_id % 6 <> 0 THEN array(lower(code)) ELSE array() END")})
    got = details.missing_texts(rows, ["display_name", "description", "definition", "aliases"])
    return got.select("account_id", F.array_join("missing", ",").alias("missing"))
