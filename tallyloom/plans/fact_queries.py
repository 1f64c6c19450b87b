"""Revisions, outliers, units and derived facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import consistency, facts, revisions
from tallyloom.plans.queue_queries import view
from tallyloom.plans.registry import query
from tallyloom.plans.report_queries import LONG, wide
from tallyloom.sources.readers import kept, table

# -- revisions; an order stands for one, and follows the customer's last one that isn't a draft

REVISION = """SELECT o_orderkey AS revision_id, lag(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id, o_orderkey % 5 = 0 AS draft, o_custkey FROM orders"""
#: Published ones that another published one follows are superseded.
STATES = f"""SELECT a.revision_id, a.parent_id, CASE WHEN draft THEN 'DRAFT' WHEN b.over_id IS NOT NULL THEN 'SUPERSEDED' ELSE 'PUBLISHED' END AS status FROM ({REVISION}) a LEFT JOIN (SELECT DISTINCT parent_id AS over_id FROM ({REVISION}) WHERE NOT draft AND parent_id IS NOT NULL) b ON a.revision_id = b.over_id"""
CHAIN = f"""WITH RECURSIVE r AS (SELECT * FROM ({STATES})), c AS (SELECT revision_id, revision_id AS root_id, 0 AS depth FROM r WHERE parent_id IS NULL UNION ALL SELECT r.revision_id, c.root_id, c.depth + 1 FROM r JOIN c ON r.parent_id = c.revision_id),
  a AS (SELECT revision_id, CAST(parent_id AS DOUBLE) AS parent_id, status, root_id, CAST(depth AS BIGINT) AS depth FROM c JOIN r USING (revision_id))"""


def number(rows: DataFrame, *names: str) -> DataFrame:
    """Whole numbers that may be null as doubles, as they are compared."""
    return rows.withColumns({c: F.col(c).cast("double") for c in names})


def revision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders", STATES.replace(" IGNORE NULLS)", ") IGNORE NULLS"))


@query(CHAIN + " SELECT * FROM a")
def revision_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision with the first of its chain and its place in it."""
    return number(revisions.rooted(revision_table(spark, sf_dir), kept), "parent_id")


@query(CHAIN + """ SELECT root_id, CAST(arg_max(revision_id, depth) FILTER (WHERE status = 'PUBLISHED') AS DOUBLE) AS current_id, CAST(max(depth) FILTER (WHERE status = 'PUBLISHED') AS DOUBLE) AS depth, count(*) AS n_revisions, count(*) FILTER (WHERE status = 'DRAFT') AS n_drafts, count(*) FILTER (WHERE status = 'PUBLISHED') > 1 AS forked FROM a GROUP BY root_id""")
def revision_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number(revisions.current(revisions.rooted(revision_table(spark, sf_dir), kept)), "current_id", "depth")


FACT = "SELECT l_orderkey AS revision_id, l_returnflag || l_linestatus AS code, sum(CAST(l_quantity AS DECIMAL(18,2))) AS value FROM lineitem GROUP BY 1, 2"


@query(f"""WITH f AS (SELECT revision_id, code, CAST(value AS DOUBLE) AS value FROM ({FACT})), p AS (SELECT revision_id, parent_id AS before_id FROM ({STATES}) WHERE parent_id IS NOT NULL AND status <> 'DRAFT'),
  a AS (SELECT p.*, code, value FROM p JOIN f USING (revision_id)), b AS (SELECT p.*, code, value FROM p JOIN f ON before_id = f.revision_id)
  SELECT coalesce(a.revision_id, b.revision_id) AS revision_id, coalesce(a.before_id, b.before_id) AS before_id, coalesce(a.code, b.code) AS code, b.value AS before, a.value AS after, CASE WHEN b.code IS NULL THEN 'ADDED' WHEN a.code IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
  FROM a FULL JOIN b ON a.revision_id = b.revision_id AND a.code = b.code WHERE a.value IS DISTINCT FROM b.value""")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each published revision changed against the one that it superseded."""
    pairs = revision_table(spark, sf_dir).where("parent_id IS NOT NULL AND status <> 'DRAFT'").select("revision_id", F.col("parent_id").alias("before_id"))
    rows = view(spark, sf_dir, "lineitem", FACT).withColumn("value", F.col("value").cast("double"))
    return revisions.differences(rows, pairs)


@query(f"""WITH r AS (SELECT * FROM ({STATES})), d AS (SELECT r.revision_id, r.parent_id, u.status AS up FROM r LEFT JOIN r u ON r.parent_id = u.revision_id WHERE r.status = 'DRAFT' AND r.revision_id % 3 = 0),
  w AS (SELECT parent_id, min(revision_id) AS revision_id FROM d WHERE up = 'PUBLISHED' GROUP BY parent_id),
  o AS (SELECT d.revision_id, CASE WHEN d.parent_id IS NULL OR w.revision_id IS NOT NULL THEN 'PUBLISHED' ELSE 'STALE' END AS outcome FROM d LEFT JOIN w USING (revision_id))
  SELECT r.revision_id, CAST(r.parent_id AS DOUBLE) AS parent_id, CASE WHEN outcome = 'PUBLISHED' THEN 'PUBLISHED' WHEN x.parent_id IS NOT NULL THEN 'SUPERSEDED' ELSE status END AS status, CASE WHEN r.revision_id % 3 = 0 AND o.revision_id IS NULL AND r.revision_id % 2 = 0 THEN 'NOT_A_DRAFT' ELSE outcome END AS outcome FROM r LEFT JOIN o USING (revision_id) LEFT JOIN w x ON r.revision_id = x.parent_id""")
def revision_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions after every third draft is published; some of them have gone stale, and some named ones aren't drafts."""
    rows = revision_table(spark, sf_dir)
    named = rows.where("revision_id % 3 = 0 AND (status = 'DRAFT' OR revision_id % 2 = 0)").select("revision_id")
    return number(revisions.publish(rows, named), "parent_id")


# -- rules across entries

OUTLIERS = LONG.rstrip().rstrip(")") + f""")
  , m AS (SELECT company, code, quantile_disc(value, 0.5) AS median, count(*) AS n FROM f WHERE period = 'FY' GROUP BY ALL HAVING count(*) >= 5), d AS (SELECT f.company, f.year, f.code, f.value, median, abs(value - median) AS far FROM f JOIN m USING (company, code) WHERE period = 'FY'),
  s AS (SELECT company, code, quantile_disc(far, 0.5) AS deviation FROM d GROUP BY ALL HAVING quantile_disc(far, 0.5) > 0)
  SELECT company, year, code, value, median, deviation FROM d JOIN s USING (company, code) WHERE far / (deviation * {consistency.NORMAL}::DOUBLE) > {consistency.TIMES}"""


@query(OUTLIERS)
def dq_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole years' facts that are far from the company's others of the same code."""
    rows = facts.to_long(wide(spark, sf_dir)).where("period = 'FY'")
    return consistency.outliers(rows).select("company", "year", "code", "value", "median", "deviation")


ENTRY = """SELECT company, year, period, code, CASE WHEN company % 10 = 3 AND year % 2 = 0 AND code = 'REV' THEN value / 1000 WHEN company % 10 = 4 AND year = 1995 THEN value * 1000000 ELSE value END AS value,
  CAST(CASE WHEN length(code) % 5 = 0 AND company % 4 = 1 THEN 1000 WHEN company % 6 = 5 THEN 0 WHEN code = 'AR' THEN NULL ELSE 1 END AS INTEGER) AS scale, CASE WHEN company % 3 = 0 AND length(code) > 9 THEN 'USD' WHEN code = 'AP' THEN NULL ELSE 'IDR' END AS currency"""
#: As the operator tells jumps, by the bounds of each power.
POWER = "CASE WHEN r IS NULL OR r = 0 THEN NULL " + " ".join(f"WHEN r > {1000**k} / 5.0::DOUBLE AND r < {1000**k} * 5.0::DOUBLE THEN {k} WHEN r < 5.0::DOUBLE / {1000**k} AND r > 1 / ({1000**k} * 5.0::DOUBLE) THEN -{k}" for k in (1, 2, 3)) + " ELSE 0 END"


@query(LONG.rstrip() + f""", e AS ({ENTRY} FROM f), n AS (SELECT *, nullif(scale, 0) AS s, value * coalesce(nullif(scale, 0), 1) AS amount FROM e),
  l AS (SELECT n.*, abs(n.amount / nullif(p.amount, 0)) AS r FROM n LEFT JOIN n p ON p.company = n.company AND p.period = n.period AND p.code = n.code AND p.year = n.year - 1),
  c AS (SELECT company, year, period, arg_min(currency, (-k, currency)) AS common FROM (SELECT company, year, period, currency, count(*) AS k FROM n WHERE currency IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  d AS (SELECT company, year, period, arg_min(s, (-k, s)) AS common_s FROM (SELECT company, year, period, s, count(*) AS k FROM n WHERE s IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT l.*, common, common_s, {POWER} AS jump FROM l LEFT JOIN c USING (company, year, period) LEFT JOIN d USING (company, year, period))
  SELECT company, year, period, code, 'CURRENCY' AS rule, currency AS found, common AS expected FROM g WHERE currency <> common
  UNION ALL SELECT company, year, period, code, 'SCALE', CAST(s AS VARCHAR), CAST(common_s AS VARCHAR) FROM g WHERE s <> common_s UNION ALL SELECT company, year, period, code, 'UNIT_JUMP', CAST(jump AS VARCHAR), '0' FROM g WHERE jump <> 0""")
def dq_unit_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts.to_long(wide(spark, sf_dir)).createOrReplaceTempView("tallyloom_f")
    return consistency.unit_and_currency(spark.sql(f"{ENTRY} FROM tallyloom_f"))


FLOWS = ("REV", "COGS", "OCF", "CAPEX")


@query(LONG.rstrip() + f""", q AS (SELECT company || '-' || year || '-' || period || '-' || code AS fact_id, * FROM f WHERE code IN {FLOWS}),
  j AS (SELECT a.*, b.fact_id AS before_id, b.value AS before_value, b.period AS before_period FROM q a LEFT JOIN q b ON a.company = b.company AND a.year = b.year AND a.code = b.code AND b.period_ord = a.period_ord - 1)
  SELECT company, year, 'Q' || period_ord AS quarter, code, CASE WHEN period_ord = 1 THEN value ELSE value - before_value END AS value, CASE WHEN period_ord = 1 THEN code || '[Q1]' ELSE code || '[' || period || '] - ' || code || '[' || before_period || ']' END AS formula,
  '{consistency.CALCULATION}' AS version, 'STANDALONE' AS basis, concat_ws(',', fact_id, CASE WHEN period_ord > 1 THEN before_id END) AS source_ids FROM j WHERE period_ord = 1 OR before_id IS NOT NULL""")
def derived_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.to_long(wide(spark, sf_dir)).withColumn("fact_id", F.concat_ws("-", "company", "year", "period", "code"))
    return consistency.derived_quarters(rows, FLOWS).withColumn("source_ids", F.array_join("source_ids", ","))
