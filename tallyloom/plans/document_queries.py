"""Labels, codes, checksums, preflight, chunks and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import documents
from tallyloom.plans.registry import query, values
from tallyloom.plans.report_queries import ACCOUNTS
from tallyloom.sources import schemas
from tallyloom.sources.readers import table

#: Labels of parts, and documents' whole texts.
RAW = "SELECT 'p' || p_partkey AS id, '  ' || p_name || ' – (' || p_type || ') ' AS label FROM part UNION ALL SELECT 'd' || doc_id, text FROM documents"
SPACE = S.SPACE.replace("\\s", "\\s\\v")


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("  "), "p_name", F.lit(" – ("), "p_type", F.lit(") ")).alias("label"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("label"))
    return part.unionByName(docs)


@query(f"SELECT id, trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS label_key FROM ({RAW})")
def mapping_normalize_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("id", S.label_key("label").alias("label_key"))


@query(f"SELECT id, regexp_replace({trimmed('lower(label)')}, '[^a-z0-9]+', ' ', 'g') AS label_key FROM ({RAW})")
def mapping_normalize_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("id", S.mapping_key("label").alias("label_key"))


@query(f"SELECT id, regexp_replace(lower({trimmed('label')}), '[^a-z0-9]', '', 'g') AS label_key FROM ({RAW})")
def mapping_normalize_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("id", S.issuer_key("label").alias("label_key"))


@query(f"SELECT id, substr(lower({trimmed('label')}), 1, 500) AS label_key FROM ({RAW})")
def mapping_normalize_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("id", S.staged_label("label").alias("label_key"))


@query(f"SELECT p_partkey AS id, regexp_replace(upper({trimmed(chr(39) + ' ' + chr(39) + ' || p_name')}), '\\s+', '_', 'g') AS code FROM part")
def code_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.code_key(F.concat(F.lit(" "), "p_name")).alias("code"))


@query("""SELECT p_partkey AS id, regexp_replace(CASE p_partkey % 3 WHEN 0 THEN '"' || p_brand || '"' WHEN 1 THEN '""' || p_brand ELSE p_brand END, '^"|"$', '', 'g') AS etag FROM part""")
def etag_unquote(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("""CASE p_partkey % 3 WHEN 0 THEN '"' || p_brand || '"' WHEN 1 THEN '""' || p_brand ELSE p_brand END""")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.unquoted(raw).alias("etag"))


#: Parts stand for accounts: their brand as code.
PART_ACCOUNT = "SELECT p_partkey AS account_id, upper(replace(p_brand, '#', '_')) || '_' || p_partkey AS code, p_name AS name FROM part"
SEARCHES = ["  Brand_1 ", "STEEL", "", "nothing like it", "_7"]


@query(f"SELECT q.term, a.account_id FROM {values([(s,) for s in SEARCHES], 'term').replace('AS t(', 'AS q(')}, ({PART_ACCOUNT}) a WHERE contains(lower(a.code || ' ' || a.name), lower(trim(q.term)))")
def dictionary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that hold each search term in their texts; a blank one finds all."""
    hay = F.lower(F.concat_ws(" ", "code", "name"))
    terms = F.array(*map(F.lit, SEARCHES))
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS account_id", "upper(replace(p_brand, '#', '_')) || '_' || p_partkey AS code", "p_name AS name")
    return rows.select("account_id", F.explode(F.filter(terms, lambda t: hay.contains(F.lower(F.trim(t))))).alias("term"))


@query("SELECT sha256(text) AS checksum, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY 1")
def doc_checksum_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.first_copies(table(spark, sf_dir, "documents"), F.sha2(F.col("text").cast("binary"), 256), F.col("doc_id"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS checksum, source FROM documents), r AS (SELECT checksum, doc_id AS run_id, row_number() OVER (PARTITION BY checksum ORDER BY doc_id % 100 DESC, doc_id DESC) AS n FROM d WHERE doc_id % 3 = 0),
  j AS (SELECT checksum, min(doc_id) AS job_id FROM d WHERE doc_id % 2 = 0 GROUP BY checksum)
  SELECT d.doc_id, r.run_id::DOUBLE AS run_id, CASE WHEN r.run_id IS NOT NULL THEN 'DUPLICATE_RUN' WHEN j.job_id IS NULL THEN 'CREATE' WHEN j.job_id % 4 <> 0 THEN 'DUPLICATE_JOB' ELSE 'RESET' END AS verdict FROM d LEFT JOIN r ON d.checksum = r.checksum AND r.n = 1 LEFT JOIN j ON d.checksum = j.checksum""")
def upload_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))
    runs = d.where("doc_id % 3 = 0").select("checksum", F.col("doc_id").alias("run_id"), (F.col("doc_id") % 100).alias("created_at"))
    jobs = d.where("doc_id % 2 = 0").groupBy("checksum").agg(F.min("doc_id").alias("job_id")).withColumn("status", F.when(F.col("job_id") % 4 == 0, "FAILED").otherwise("PROCESSING"))
    return documents.upload_verdicts(d, runs, jobs).select("doc_id", F.col("run_id").cast("double").alias("run_id"), "verdict")


PDF = "repeat('BT ', CAST(page_id % 6 AS INTEGER)) || repeat('/Font ', CAST(page_id % 4 AS INTEGER)) || repeat('/Subtype  /Image ', CAST(page_id % 25 AS INTEGER)) || repeat('Tjx Tf_ /FontName ', 2) || html"


def count(pattern: str) -> str:
    return f"len(regexp_extract_all(body, '{pattern}'))"


@query(f"""WITH b AS (SELECT page_id, {PDF} AS body FROM pages), c AS (SELECT page_id, {count(chr(92) + 'b(?:BT|ET|Tj|TJ|Tf)' + chr(92) + 'b')} AS n_text, {count('/Font' + chr(92) + 'b')} AS n_font, {count('/Subtype' + chr(92) + 's*/Image' + chr(92) + 'b')} AS n_image FROM b)
  SELECT page_id, CAST(n_text AS INTEGER) AS n_text, CAST(n_font AS INTEGER) AS n_font, CAST(n_image AS INTEGER) AS n_image, CASE WHEN NOT (n_text >= 3 OR n_font >= 2) THEN 'VISION_OCR_FALLBACK' WHEN n_image > greatest(8, 2 * n_text) THEN 'HYBRID' ELSE 'NATIVE_TEXT' END AS mode,
  CASE WHEN NOT (n_text >= 3 OR n_font >= 2) THEN 0.78::DOUBLE WHEN n_image > greatest(8, 2 * n_text) THEN 0.72::DOUBLE ELSE 0.82::DOUBLE END AS confidence FROM c""")
def doc_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(PDF.replace("INTEGER", "INT")).cast("binary").alias("content"))
    return documents.preflight(rows, documents.sample_text(F.col("content"))).select("page_id", "n_text", "n_font", "n_image", "mode", "confidence")


@query("""SELECT doc_id, CAST(i AS INTEGER) AS ordinal, sha256(substr(t, CAST((i - 1) * 600 + 1 AS BIGINT), 600)) AS chunk_hash FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 600), range(1, 1000000) r(i) WHERE (i - 1) * 600 < length(t)
  UNION ALL SELECT doc_id, 1, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 600""")
def chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of texts without blank lines, which are cut into equal lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.chunked(docs, F.col("text"), 600).select("doc_id", "ordinal", "chunk_hash")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return documents.chunked(docs, F.col("text"), 600)


#: Lines as blocks, long ones in pieces, and the chunk that each piece goes to, piece after piece.
PACKED = f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), b AS (SELECT doc_id, k, {trimmed('b')} AS b FROM l WHERE {trimmed('b')} <> ''),
  p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS n, substr(b, i * 600 + 1, 600) AS piece, length(b) > 600 AS alone FROM (SELECT doc_id, k, b, unnest(range(0, (length(b) + 599) // 600)) AS i FROM b)),
  c AS (SELECT doc_id, n, 1 AS ordinal, CASE WHEN alone THEN -1 ELSE length(piece) END AS size FROM p WHERE n = 1 UNION ALL SELECT p.doc_id, p.n, CASE WHEN alone OR size < 0 OR size + length(piece) + 2 > 600 THEN ordinal + 1 ELSE ordinal END,
    CASE WHEN alone THEN -1 WHEN size < 0 OR size + length(piece) + 2 > 600 THEN length(piece) ELSE size + 2 + length(piece) END FROM c JOIN p ON p.doc_id = c.doc_id AND p.n = c.n + 1),
  k AS (SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, string_agg(piece, chr(10) || chr(10) ORDER BY n) AS chunk FROM c JOIN p USING (doc_id, n) GROUP BY doc_id, ordinal)
"""


@query(PACKED + "SELECT doc_id, ordinal, chunk, sha256(chunk) AS chunk_hash FROM k")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of texts whose lines are blocks."""
    return packed(spark, sf_dir).select("doc_id", "ordinal", "chunk", "chunk_hash")


@query(PACKED + "SELECT doc_id, count(*) AS n_chunks, max(length(chunk)) AS longest FROM k GROUP BY doc_id")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("chunk")).alias("longest"))


#: Documents as uploads, some of them beyond the largest size.
FILE = "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'a.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN 'b.txt' ELSE 'c' || doc_id || '.pdf' END AS name, CASE doc_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN '' WHEN 2 THEN 'text/html' WHEN 3 THEN 'application/octet-stream' END AS mime, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars * 3000 END AS size FROM documents"


@query(f"SELECT id, CASE WHEN NOT (lower(name) LIKE '%.pdf' AND coalesce(mime, '') IN ('', 'application/pdf', 'application/octet-stream')) THEN 'NOT_PDF' WHEN size <= 0 THEN 'EMPTY' WHEN size > 12582912 THEN 'TOO_LARGE' END AS error FROM ({FILE})")
def pdf_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("tallyloom_documents")
    rows = spark.sql(FILE.replace("FROM documents", "FROM tallyloom_documents"))
    return rows.select("id", documents.upload_error(F.col("name"), F.col("mime"), F.col("size")).alias("error"))


STATES = ["UPLOADED", "PROCESSING", "PENDING_REVIEW", "READY_TO_COMMIT", "COMMITTED", "FAILED", "PENDING", "ACCEPTED_ALL", "NEED REVIEW", "OTHER"]
STATE = f"CASE o_orderkey % {len(STATES)} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END"


@query(f"""SELECT id, CASE WHEN status = 'PENDING_REVIEW' THEN 'NEED REVIEW' ELSE replace(status, '_', ' ') END AS friendly, CASE WHEN status = 'COMMITTED' THEN 'View Review Audit' WHEN status = 'READY_TO_COMMIT' THEN 'Final Review' WHEN status = 'FAILED' THEN 'Error Details' WHEN status IN ('PROCESSING', 'UPLOADED') THEN 'AI Processing…' ELSE 'Continue Review' END AS action,
  CASE WHEN status IN ('NEED REVIEW') THEN 'NEED_REVIEW' WHEN status = 'READY_TO_COMMIT' THEN 'READY_TO_COMMIT' WHEN status = 'COMMITTED' THEN 'COMMITTED' WHEN status = 'FAILED' THEN 'FAILED' WHEN status LIKE 'PENDING%' THEN 'PENDING' WHEN status LIKE 'ACCEPTED%' THEN 'ACCEPTED' ELSE 'NEUTRAL' END AS style FROM (SELECT o_orderkey AS id, {STATE} AS status FROM orders)""")
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(STATE).alias("status"))
    return rows.select("id", S.friendly_status("status").alias("friendly"), S.action_label("status").alias("action"), S.badge_style("status").alias("style"))


@query("""SELECT o_orderkey AS id, CASE WHEN s IN ('queued', 'in_progress') THEN 'PROCESSING' ELSE upper(s) END AS state, coalesce(nullif(e, ''), nullif(r, ''), 'background response ' || s) AS detail,
  replace(replace(replace(regexp_replace(format('{:,.3f}', round(o_totalprice, 1)), '\\.?0+$', ''), ',', '_'), '.', ','), '_', '.') AS amount FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS s, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'message' END AS e, CASE o_orderkey % 5 WHEN 0 THEN 'reason' END AS r FROM orders)""")
def job_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "round(o_totalprice, 1) AS price", "CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS s", "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'message' END AS e", "CASE o_orderkey % 5 WHEN 0 THEN 'reason' END AS r")
    return rows.select("id", S.job_state("s").alias("state"), S.first_given("e", "r", F.concat(F.lit("background response "), "s")).alias("detail"), S.grouped_number("price").alias("amount"))


@query("""SELECT l_orderkey AS session_id, count(*) AS n_parts, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS parts, max(l_linenumber) = count(DISTINCT l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey""")
def multipart_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each upload in order, and whether none is missing up to the last."""
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.count(F.lit(1)).alias("n_parts"), F.array_sort(F.collect_set("l_linenumber")).alias("p"))
    return got.select("session_id", "n_parts", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("parts"), (F.array_max("p") == F.size("p")).alias("complete"))
