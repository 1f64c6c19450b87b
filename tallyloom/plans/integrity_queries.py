"""Request bodies, the store's constraints, audit rows and upload sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import audit, bodies, constraints, uploads
from tallyloom.plans.queue_queries import KINDS, NOW, now, view
from tallyloom.plans.registry import query

# -- request bodies, made from orders, customers and parts


def body_errors(rules: tuple[bodies.Rule, ...], body: str = "good") -> str:
    """The rules as SQL: the problems of a body as one text, of what ``parsed`` gives."""

    def kind(path: str) -> str:
        at = f"json_type({body}, '$.{path}')" if path else f"json_type({body})"
        return f"CASE WHEN {at} IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE') THEN 'number' WHEN {at} = 'VARCHAR' THEN 'text' WHEN {at} = 'BOOLEAN' THEN 'flag' WHEN {at} = 'OBJECT' THEN 'object' ELSE lower({at}) END"

    def one(r: bodies.Rule) -> str:
        text = f"json_extract_string({body}, '$.{r.path}')"
        bare = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
        seen = bare if r.trim else text
        number = f"TRY_CAST({text} AS DOUBLE)"
        if r.coerced:
            number = f"CASE WHEN {kind(r.path)} = 'text' THEN CASE WHEN {bare} = '' THEN 0 ELSE TRY_CAST({bare} AS DOUBLE) END WHEN {kind(r.path)} = 'flag' THEN CASE {text} WHEN 'true' THEN 1 ELSE 0 END WHEN {kind(r.path)} = 'null' THEN 0 ELSE {number} END"
        out = [f"WHEN {kind(r.path)} IS NULL THEN {repr('REQUIRED') if r.required else 'NULL'}", f"WHEN ({number}) IS NULL THEN 'TYPE'" if r.coerced else f"WHEN {kind(r.path)} <> '{r.kind}' THEN 'TYPE'"]
        out += [f"WHEN floor({number}) <> ({number}) THEN 'INTEGER'"] if r.integer else []
        out += [f"WHEN ({number}) < {r.low} THEN 'MIN'"] if r.low is not None else []
        out += [f"WHEN ({number}) > {r.high} THEN 'MAX'"] if r.high is not None else []
        out += [f"WHEN length({seen}) <> {r.exact} THEN 'LENGTH'"] if r.exact is not None else []
        out += [f"WHEN length({seen}) < {r.shortest} THEN 'TOO_SHORT'"] if r.shortest is not None else []
        out += [f"WHEN length({seen}) > {r.longest} THEN 'TOO_LONG'"] if r.longest is not None else []
        out += [f"WHEN NOT regexp_matches({seen}, '{r.pattern}') THEN 'PATTERN'"] if r.pattern else []
        out += [f"WHEN {seen} NOT IN ({', '.join(map(repr, r.domain))}) THEN 'DOMAIN'"] if r.domain else []
        got = f"CASE {' '.join(out)} END"
        return f"'{r.path}: ' || " + (f"CASE WHEN {kind(r.within)} = 'object' THEN {got} END" if r.within else got)

    return f"CASE WHEN {body} IS NULL THEN 'body: JSON' WHEN json_type({body}) <> 'OBJECT' THEN 'body: TYPE' ELSE concat_ws('; ', {', '.join(map(one, rules))}) END"


def parsed(text: str) -> str:
    """Bodies, null in ``good`` where they aren't JSON."""
    return f"(SELECT *, CASE WHEN json_valid(body) THEN body END AS good FROM ({text}))"


REPORT_BODY = """SELECT o_orderkey AS id, CASE o_orderkey % 19 WHEN 0 THEN 'no json' WHEN 1 THEN '[1]' WHEN 2 THEN '{}' WHEN 3 THEN '7' WHEN 4 THEN '{"companyId":"c","year":2020,"periodType":"FY","values":[1]}' ELSE
  '{"companyId":' || CASE o_orderkey % 5 WHEN 0 THEN '""' WHEN 1 THEN '12' ELSE '"c' || o_custkey || '"' END || ',"year":' || CASE o_orderkey % 7 WHEN 0 THEN '1999' WHEN 1 THEN '2020.5' WHEN 2 THEN '"2020"' WHEN 3 THEN '2101' WHEN 4 THEN 'null' ELSE CAST(year(o_orderdate) + 10 AS VARCHAR(4)) END ||
  CASE o_orderkey % 3 WHEN 0 THEN ',"periodType":"MONTHLY"' WHEN 1 THEN ',"periodType":"FY"' ELSE '' END || CASE o_orderkey % 4 WHEN 0 THEN ',"audited":true' WHEN 1 THEN ',"audited":"yes"' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN ',"sourceFile":"' || repeat('f', 256) || '"' WHEN o_orderkey % 11 = 1 THEN ',"sourceFile":null' ELSE '' END ||
  ',"values":{"REV":' || CAST(o_orderkey AS VARCHAR(20)) || ',"NET_PROFIT":' || CASE o_orderkey % 6 WHEN 0 THEN '"1"' WHEN 1 THEN 'null' WHEN 2 THEN '-1.5e3' ELSE '0.25' END || ',"TOTAL_ASSETS":10,"TOTAL_LIAB":4' || CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE ',"EQUITY":6' END || ',"OCF":' || CASE WHEN o_orderkey % 9 = 0 THEN 'true' ELSE '1' END || ',"OTHER":"x"}}' END AS body FROM orders"""


@query(f"SELECT id, {body_errors(bodies.REPORT)} AS errors FROM {parsed(REPORT_BODY)}")
def report_body_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies.reports(view(spark, sf_dir, "orders", REPORT_BODY))
    return rows.select("id", F.array_join("errors", "; ").alias("errors"))


COMPANY_BODY = """SELECT c_custkey AS id, '{"ticker":' || CASE c_custkey % 4 WHEN 0 THEN '"  "' WHEN 1 THEN '" ab' || c_custkey || ' "' WHEN 2 THEN '"a ticker that is long"' ELSE '"tk"' END || CASE WHEN c_custkey % 6 = 0 THEN '' ELSE ',"name":"' || c_name || '"' END || CASE c_custkey % 5 WHEN 0 THEN ',"country":"idn"' WHEN 1 THEN ',"country":" sg "' WHEN 2 THEN ',"country":5' ELSE '' END ||
  CASE c_custkey % 7 WHEN 0 THEN ',"currency":"usd"' WHEN 1 THEN ',"currency":"us"' WHEN 2 THEN ',"currency":null' ELSE '' END || CASE c_custkey % 9 WHEN 0 THEN ',"fiscalYearEnd":"6"' WHEN 1 THEN ',"fiscalYearEnd":13' WHEN 2 THEN ',"fiscalYearEnd":1.5' WHEN 3 THEN ',"fiscalYearEnd":""' WHEN 4 THEN ',"fiscalYearEnd":"June"' WHEN 5 THEN ',"fiscalYearEnd":true' ELSE '' END || '}' AS body FROM customer"""


def stored(path: str, default: str | None = None) -> str:
    text = f"upper(regexp_replace(json_extract_string(body, '$.{path}'), '^\\s+|\\s+$', '', 'g'))"
    return f"CASE WHEN errors = '' THEN coalesce({text}, {repr(default)}) END" if default else f"CASE WHEN errors = '' THEN {text} END"


@query(f"SELECT id, errors, {stored('ticker')} AS ticker, {stored('country', 'ID')} AS country, {stored('currency', 'IDR')} AS currency FROM (SELECT id, body, {body_errors(bodies.COMPANY)} AS errors FROM {parsed(COMPANY_BODY)})")
def company_body_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies.companies(view(spark, sf_dir, "customer", COMPANY_BODY))
    return rows.select("id", F.array_join("errors", "; ").alias("errors"), "ticker", "country", "currency")


ACCOUNT_BODY = """SELECT p_partkey AS id, '{"code":"' || CASE p_partkey % 5 WHEN 0 THEN 'lower' WHEN 1 THEN 'A' WHEN 2 THEN ' CODE_' || p_partkey || ' ' ELSE 'P' || p_partkey END || '","name":"' || CASE p_partkey % 7 WHEN 0 THEN ' x ' WHEN 1 THEN repeat('long ', 40) ELSE p_name END || '"' || CASE p_partkey % 3 WHEN 0 THEN ',"description":"' || repeat('d', p_partkey % 600) || '"' ELSE '' END ||
  ',"statementType":"' || CASE p_partkey % 4 WHEN 0 THEN 'BALANCE_SHEET' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'CASH_FLOW' ELSE 'cash_flow' END || '","valueNature":' || CASE p_partkey % 6 WHEN 0 THEN '"SIZE"' WHEN 1 THEN '7' ELSE '"STOCK"' END || CASE p_partkey % 8 WHEN 0 THEN ',"normalBalance":"DEBIT"' WHEN 1 THEN ',"normalBalance":"BOTH"' WHEN 2 THEN ',"normalBalance":null' ELSE '' END || '}' AS body FROM part"""


@query(f"SELECT id, {body_errors(bodies.ACCOUNT)} AS errors FROM {parsed(ACCOUNT_BODY)}")
def account_body_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bodies.accounts(view(spark, sf_dir, "part", ACCOUNT_BODY))
    return rows.select("id", F.array_join("errors", "; ").alias("errors"))


# -- the store's constraints, over tables in which each of them is broken somewhere

STORE = {
    "UploadSession": ("orders", """SELECT 'U' || o_orderkey AS id, 'c' || CASE WHEN o_orderkey % 50 = 0 THEN 50 ELSE o_orderkey END AS correlationId, CASE WHEN o_orderkey % 33 = 0 THEN 'OTHER' WHEN o_orderkey % 3 = 0 THEN 'SINGLE_PUT' WHEN o_orderkey % 3 = 1 THEN 'MULTIPART' END AS uploadMode, CASE o_orderkey % 9 WHEN 0 THEN 'LOST' WHEN 1 THEN 'UPLOADING' ELSE 'VERIFIED' END AS status,
      'k' || (o_orderkey - o_orderkey % 2) AS objectKey, CAST(o_orderkey % 17 AS INTEGER) AS expectedSize, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 6000000 END AS INTEGER) AS partSize FROM orders"""),
    "UploadPart": ("lineitem", """SELECT 'P' || l_orderkey || '-' || l_linenumber AS id, 'U' || CASE WHEN l_partkey % 40 = 0 THEN -l_orderkey ELSE l_orderkey END AS uploadSessionId, CAST(CASE WHEN l_suppkey % 10 = 0 THEN 2 ELSE l_linenumber - 1 END AS INTEGER) AS partNumber, CASE WHEN l_partkey % 25 <> 0 THEN 'e' || l_partkey END AS etag, CAST(l_partkey % 90 AS INTEGER) AS size FROM lineitem"""),
    "FinancialDocument": ("part", """SELECT 'D' || (p_partkey - p_partkey % 2) AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'U' || (p_partkey % 400) END AS uploadSessionId, CASE WHEN p_partkey % 12 <> 0 THEN 'o' || p_partkey END AS objectKey, CAST(p_size - 3 AS INTEGER) AS verifiedSize, CASE p_partkey % 4 WHEN 0 THEN 'GONE' WHEN 1 THEN NULL ELSE 'VERIFIED' END AS status FROM part"""),
    "Job": ("events", f"""SELECT 'J' || event_id AS id, CASE WHEN event_id % 21 <> 0 THEN 'c' END AS correlationId, event_type AS type, CASE WHEN event_id % 64 = 0 THEN 'LOST' ELSE {KINDS.format('event_id')} END AS status, CASE WHEN event_id % 4 <= 1 THEN 'd' || (user_id * 100 + event_id % 100) END AS deduplicationKey, CAST(event_id % 6 - 1 AS INTEGER) AS attemptCount, CAST(event_id % 4 AS INTEGER) AS maxAttempts,
      CAST(event_id % 5 - 1 AS INTEGER) AS priority, CASE WHEN event_id % 3 = 0 THEN 'D' || (user_id * 7) END AS documentId FROM events"""),
    "JobAttempt": ("orders", """SELECT 'A' || o_orderkey AS id, 'J' || (o_orderkey - o_orderkey % 4) AS jobId, CAST(o_orderkey % 3 AS INTEGER) AS attemptNumber, CASE o_orderkey % 6 WHEN 0 THEN 'LEASE_EXPIRED' WHEN 1 THEN 'LOST' ELSE 'RUNNING' END AS status, CAST(CASE WHEN o_orderkey % 5 = 0 THEN -1 WHEN o_orderkey % 5 > 2 THEN 7 END AS INTEGER) AS durationMs FROM orders"""),
    "JobEvent": ("events", """SELECT 'E' || (event_id - event_id % 3) AS id, CASE WHEN event_id % 10 <> 0 THEN 'J' || (event_id * 2) END AS jobId, CASE WHEN event_id % 2 = 0 THEN 'A' || (event_id * 3) END AS attemptId, event_type AS eventType FROM events"""),
    "MetadataAssertion": ("customer", """SELECT 'M' || c_custkey AS id, CASE WHEN c_custkey % 8 <> 0 THEN 'D' || (c_custkey * 2) END AS documentId, 'year' AS field, CASE c_custkey % 5 WHEN 0 THEN 'MAYBE' ELSE 'PROPOSED' END AS status, CASE c_custkey % 6 WHEN 0 THEN 1.5 WHEN 1 THEN NULL ELSE 0.5 END AS confidence, CAST(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 4 END AS INTEGER) AS sourcePage FROM customer"""),
}


def constraints_sql() -> str:
    """Each constraint by itself."""
    parts = []
    for name, declared in constraints.STORE.items():
        rules = {f"{c}_required": f"{c} IS NOT NULL" for c in declared.required} | {f"{c}_domain": f"{c} IN ({', '.join(map(repr, v))})" for c, v in declared.enums.items()} | {c.name: c.holds for c in declared.checks}
        parts += [f"SELECT '{name}' AS table_name, '{k}' AS constraint_name, count(*) AS n_rows, min(id) AS first_id FROM {name} WHERE NOT ({v})" for k, v in rules.items()]
        for u in declared.uniques:
            given = " AND ".join(f"{c} IS NOT NULL" for c in u.columns)
            parts.append(f"SELECT '{name}', '{u.name}', CAST(coalesce(sum(n), 0) AS BIGINT), min(id) FROM (SELECT count(*) AS n, min(id) AS id FROM {name} WHERE ({u.where}) AND {given} GROUP BY {', '.join(u.columns)} HAVING count(*) > 1)")
        parts += [f"SELECT '{name}', '{f.name}', count(*), min(id) FROM {name} WHERE {f.column} IS NOT NULL AND {f.column} NOT IN (SELECT {f.parent_column} FROM {f.parent})" for f in declared.foreign]
    return "WITH " + ", ".join(f"{n} AS ({text})" for n, (_, text) in STORE.items()) + " SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_rows > 0"


@query(constraints_sql())
def store_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of the platform tables that rows break."""
    tables = {name: view(spark, sf_dir, source, text) for name, (source, text) in STORE.items()}
    return constraints.violations(tables, constraints.STORE)


# -- audit rows between two states of a table

BEFORE = "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR(20)) AS owner, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS note FROM orders WHERE o_orderkey % 13 <> 0"
AFTER = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) AS owner, CASE WHEN o_orderkey % 6 = 0 THEN 'say \"so\"' WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS note FROM orders WHERE o_orderkey % 11 <> 0"
NAMES = ("note", "owner", "status")


def side(which: str) -> str:
    part = lambda c: f"CASE WHEN b_{c} IS DISTINCT FROM a_{c} THEN '\"{c}\":' || coalesce('\"' || replace({which}_{c}, '\"', '\\\"') || '\"', 'null') END"
    return f"'{{' || concat_ws(',', {', '.join(map(part, NAMES))}) || '}}'"


@query(f"""WITH j AS (SELECT coalesce(b.id, a.id) AS id, b.id IS NULL AS added, a.id IS NULL AS gone, {', '.join(f'b.{c} AS b_{c}, a.{c} AS a_{c}' for c in NAMES)} FROM ({BEFORE}) b FULL JOIN ({AFTER}) a ON a.id = b.id)
  SELECT id, 'Order' AS entity, CAST(id AS VARCHAR) AS entity_id, CASE WHEN added THEN 'INSERT' WHEN gone THEN 'DELETE' ELSE 'UPDATE' END AS action, 'batch' AS actor, concat_ws(',', {', '.join(f"CASE WHEN b_{c} IS DISTINCT FROM a_{c} THEN '{c}' END" for c in NAMES)}) AS fields, CASE WHEN NOT added THEN {side('b')} END AS before, CASE WHEN NOT gone THEN {side('a')} END AS after
  FROM j WHERE added OR gone OR {' OR '.join(f'b_{c} IS DISTINCT FROM a_{c}' for c in NAMES)}""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the audit log for one state of orders against another."""
    got = audit.changes(view(spark, sf_dir, "orders", BEFORE), view(spark, sf_dir, "orders", AFTER), ["id"], "Order", "batch")
    return got.withColumn("fields", F.array_join(F.map_keys("fields"), ","))


# -- uploads

SESSION = f"""SELECT o_orderkey AS session_id, CASE o_orderkey % 9 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'ABORTED' WHEN 2 THEN 'INITIATED' ELSE 'UPLOADING' END AS status, CAST(CASE WHEN o_orderkey % 8 = 0 THEN 5 ELSE 1 + 10 * (o_orderkey % 7) END AS INTEGER) AS expected_size, CAST(CASE WHEN o_orderkey % 8 <> 0 THEN 10 END AS INTEGER) AS part_size,
  CASE WHEN o_orderkey % 10 = 0 THEN {NOW} - INTERVAL 1 HOUR ELSE {NOW} + INTERVAL 1 HOUR END AS expires_at FROM orders"""
PART = "SELECT l_orderkey AS session_id, CAST(CASE WHEN l_partkey % 20 = 0 THEN 2 ELSE l_linenumber END AS INTEGER) AS part_number, CAST(CASE WHEN l_orderkey % 8 = 0 THEN 5 WHEN l_linenumber = 1 + l_orderkey % 7 THEN 1 ELSE 10 END AS INTEGER) AS size FROM lineitem WHERE l_partkey % 9 <> 0"


@query(f"""WITH s AS (SELECT *, CAST(greatest(1, CASE WHEN part_size IS NULL THEN 1 ELSE ceil(expected_size / CAST(part_size AS DOUBLE)) END) AS BIGINT) AS n_expected FROM ({SESSION})), p AS (SELECT session_id, part_number, max(size) AS size FROM ({PART}) GROUP BY ALL),
  m AS (SELECT session_id, n, n - row_number() OVER (PARTITION BY session_id ORDER BY n) AS island FROM (SELECT session_id, unnest(range(1, n_expected + 1)) AS n FROM s) e WHERE NOT EXISTS (FROM p WHERE p.session_id = e.session_id AND p.part_number = e.n)),
  g AS (SELECT session_id, string_agg(a || '-' || b, ',' ORDER BY a) AS missing FROM (SELECT session_id, min(n) AS a, max(n) AS b FROM m GROUP BY session_id, island) GROUP BY session_id), t AS (SELECT session_id, count(*) AS n_parts, sum(size) AS received FROM p GROUP BY session_id)
  SELECT session_id, n_expected, coalesce(n_parts, 0) AS n_parts, CAST(coalesce(received, 0) AS BIGINT) AS received, coalesce(missing, '') AS missing, CASE WHEN status NOT IN ('INITIATED', 'UPLOADING') THEN status WHEN expires_at < {NOW} THEN 'ABORTED' WHEN missing IS NULL AND coalesce(received, 0) = expected_size THEN 'UPLOADED' WHEN missing IS NULL THEN 'FAILED' WHEN n_parts > 0 THEN 'UPLOADING' ELSE status END AS state
  FROM s LEFT JOIN g USING (session_id) LEFT JOIN t USING (session_id)""")
def upload_session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = uploads.states(view(spark, sf_dir, "orders", SESSION), view(spark, sf_dir, "lineitem", PART), now())
    runs = F.transform("missing", lambda x: F.concat(x["first_missing"].cast("string"), F.lit("-"), x["last_missing"].cast("string")))
    return got.select("session_id", F.col("n_expected").cast("long").alias("n_expected"), "n_parts", "received", F.array_join(runs, ",").alias("missing"), "state")
