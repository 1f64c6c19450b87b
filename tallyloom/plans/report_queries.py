"""Facts, ratios and data quality of reports derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import facts, mutations, quality, ratios
from tallyloom.plans.registry import query, values
from tallyloom.sources import schemas
from tallyloom.sources.readers import table

KEYS = "company, year, period_ord, period"
#: Facts as SQL: the same decimals, with every period's rows summed directly.
WIDE = """WITH p(period_ord, period) AS (VALUES (1, 'Q1'), (2, 'H1'), (3, 'Q3'), (4, 'FY')),
b AS (SELECT l_suppkey AS company, CAST(year(l_shipdate) AS INTEGER) AS year, quarter(l_shipdate) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS e,
  CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS n, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS t, l_returnflag AS rf, l_linestatus AS ls,
  CAST(CASE l_suppkey % 7 WHEN 0 THEN 0.01 WHEN 1 THEN 0.002 WHEN 2 THEN 0.0005 ELSE 0 END AS DECIMAL(5,4)) AS share FROM lineitem),
w AS (SELECT company, year, CAST(period_ord AS INTEGER) AS period_ord, period,
  CAST(sum(n) AS DOUBLE) AS "REV", CAST(sum(CASE WHEN rf <> 'R' THEN n END) AS DOUBLE) AS "COGS",
  CAST(sum(CASE WHEN rf = 'R' AND ls = 'F' THEN n END) AS DOUBLE) AS "OPERATING_PROFIT",
  CAST(sum(CASE WHEN rf = 'R' AND ls = 'F' THEN n END) - sum(CASE WHEN rf = 'R' THEN t END) AS DOUBLE) AS "NET_PROFIT",
  CAST(sum(CASE WHEN rf = 'R' AND ls = 'O' THEN n END) - sum(CASE WHEN rf = 'R' THEN t END) AS DOUBLE) AS "OCF",
  CAST(sum(e) AS DOUBLE) AS "TOTAL_ASSETS", CAST(sum(CASE WHEN rf <> 'N' THEN e END) AS DOUBLE) AS "TOTAL_LIAB",
  CAST(sum(CASE WHEN rf = 'N' THEN e END) + sum(e * share) AS DOUBLE) AS "EQUITY",
  CAST(sum(CASE WHEN ls = 'O' AND rf = 'N' THEN e END) AS DOUBLE) AS "AR", CAST(sum(CASE WHEN rf = 'N' AND ls = 'F' THEN e END) AS DOUBLE) AS "CASH",
  CAST(sum(CASE WHEN rf = 'A' AND ls = 'O' THEN e END) AS DOUBLE) AS "INV", CAST(sum(CASE WHEN rf = 'R' AND ls = 'O' THEN e END) AS DOUBLE) AS "AP",
  CAST(sum(CASE WHEN rf = 'A' THEN e END) AS DOUBLE) AS "TOTAL_DEBT", CAST(sum(CASE WHEN rf = 'A' THEN t END) AS DOUBLE) AS "CAPEX",
  CAST(sum(CASE WHEN rf = 'R' AND ls = 'F' THEN t END) AS DOUBLE) AS "FINANCE_COST",
  CAST(sum(CASE WHEN ls = 'O' THEN e END) AS DOUBLE) AS "CURRENT_ASSETS", CAST(sum(CASE WHEN rf = 'R' THEN e END) AS DOUBLE) AS "CURRENT_LIAB"
  FROM b JOIN p ON q <= period_ord GROUP BY company, year, period_ord, period)
"""
LONG = WIDE + ", f AS (" + " UNION ALL ".join(f"""SELECT {KEYS}, '{c}' AS code, "{c}" AS value FROM w WHERE "{c}" IS NOT NULL""" for c in facts.CODES) + ")\n"
DAYS = "365 / NULLIF({}, 0)"
LIBRARY = """("REV" - "COGS") / NULLIF("REV", 0) AS gross_margin, "OPERATING_PROFIT" / NULLIF("REV", 0) AS operating_margin, "NET_PROFIT" / NULLIF("REV", 0) AS net_margin,
  "NET_PROFIT" / NULLIF("TOTAL_ASSETS", 0) AS roa, "NET_PROFIT" / NULLIF("EQUITY", 0) AS roe, "CURRENT_ASSETS" / NULLIF("CURRENT_LIAB", 0) AS current_ratio, "TOTAL_DEBT" / NULLIF("EQUITY", 0) AS debt_to_equity,
  "TOTAL_DEBT" - "CASH" AS net_debt, "OPERATING_PROFIT" / NULLIF("FINANCE_COST", 0) AS interest_coverage, "OCF" / NULLIF("NET_PROFIT", 0) AS ocf_to_net_profit, "OCF" - "CAPEX" AS free_cash_flow,
  "AR" * 365 / NULLIF("REV", 0) AS receivable_days, "INV" * 365 / NULLIF("COGS", 0) AS inventory_days, "AP" * 365 / NULLIF("COGS", 0) AS payable_days,
  coalesce("AR" * 365 / NULLIF("REV", 0), 0) + coalesce("INV" * 365 / NULLIF("COGS", 0), 0) - coalesce("AP" * 365 / NULLIF("COGS", 0), 0) AS cash_conversion_cycle"""
PAGE = [f"""CASE WHEN "{b}" <> 0 THEN "{a}" / "{b}" * {k} END""" for a, b, k, *_ in ratios.PAGE.values()]
GAP = 'abs("TOTAL_ASSETS" - "TOTAL_LIAB" - "EQUITY")'
MISMATCH, LOW_CASH = f'{GAP} > greatest(abs("TOTAL_ASSETS") * 0.005, 1)', '"NET_PROFIT" > 0 AND "OCF" < "NET_PROFIT" * 0.5'
WARNINGS = WIDE + f""", x AS (SELECT {KEYS}, 'BALANCE_MISMATCH' AS code, 'HIGH' AS severity, {GAP} AS gap FROM w WHERE {MISMATCH}
  UNION ALL SELECT {KEYS}, 'LOW_CASH_CONVERSION', 'MEDIUM', NULL FROM w WHERE {LOW_CASH})
"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.from_lineitem(table(spark, sf_dir, "lineitem"))


@query(LONG + "SELECT * FROM f")
def facts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.to_long(wide(spark, sf_dir))


@query(WIDE + "SELECT * FROM w")
def facts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.to_wide(facts.to_long(wide(spark, sf_dir)))


@query(WIDE + f"SELECT {KEYS}, {LIBRARY} FROM w")
def ratios_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.library(wide(spark, sf_dir)).select(*facts.KEYS, *ratios.LIBRARY)


@query(WIDE + f"SELECT {KEYS}, {', '.join(f'{x} AS r{i}' for i, x in enumerate(PAGE, 1))} FROM w")
def ratios_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.page(wide(spark, sf_dir)).select(*facts.KEYS, *[f"r{i}" for i in range(1, 7)])


@query(WIDE + " UNION ALL ".join(f"SELECT {KEYS}, '{n}' AS ratio, {x} AS value, '{r[3]}' AS unit, CASE WHEN {x} {r[4]} {r[5]} THEN 'Healthy' ELSE 'Monitor' END AS verdict FROM w" for x, (n, r) in zip(PAGE, ratios.PAGE.items())))
def ratio_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.health(wide(spark, sf_dir), facts.KEYS)


@query(WIDE + f"""SELECT {KEYS}, abs("TOTAL_ASSETS" - ("TOTAL_LIAB" + "EQUITY")) AS gap FROM w WHERE abs("TOTAL_ASSETS" - ("TOTAL_LIAB" + "EQUITY")) > greatest(1, "TOTAL_ASSETS" * 0.001)""")
def dq_library_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).where(quality.library_balance()).select(*facts.KEYS, F.abs(quality.assets() - quality.claims_on_assets()).alias("gap"))


@query(WIDE + f"""SELECT {KEYS}, "OCF" / "NET_PROFIT" AS conversion FROM w WHERE "NET_PROFIT" > 0 AND "OCF" / "NET_PROFIT" < 0.6""")
def dq_library_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).where(quality.library_cash()).select(*facts.KEYS, S.ratio("OCF", "NET_PROFIT").alias("conversion"))


ODD = [(1, 0.0), (2, -5.0), (3, 100.0), (4, None)]


@query(f"""SELECT id, value IS NULL OR isnan(value) OR isinf(value) OR value <= 0 AS invalid FROM (SELECT CAST(id AS BIGINT) AS id, CAST(value AS DOUBLE) AS value FROM {values(ODD, 'id, value')}
  UNION ALL SELECT 5, CAST('nan' AS DOUBLE) UNION ALL SELECT 6, CAST('inf' AS DOUBLE) UNION ALL SELECT l_suppkey * 1000 + year(l_shipdate) - 1990, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) FROM lineitem GROUP BY ALL)""")
def dq_assets_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([*ODD, (5, float("nan")), (6, float("inf"))], "id long, TOTAL_ASSETS double")
    key = (F.col("l_suppkey") * 1000 + F.year("l_shipdate") - 1990).cast("long")
    real = table(spark, sf_dir, "lineitem").groupBy(key.alias("id")).agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice").cast("decimal(18,2)"))).cast("double").alias("TOTAL_ASSETS"))
    return odd.unionByName(real).select("id", quality.assets_invalid().alias("invalid"))


@query(WIDE + f""", y AS (SELECT *, lag("REV") OVER v AS prev_rev, lag("AR") OVER v AS prev_ar FROM w WINDOW v AS (PARTITION BY company, period ORDER BY year))
  SELECT {KEYS}, "REV" AS rev, prev_rev, "AR" AS ar, prev_ar FROM y WHERE prev_rev <> 0 AND prev_ar <> 0 AND "REV" < prev_rev AND "AR" > prev_ar * 1.1::DOUBLE""")
def dq_receivable_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.receivable_divergence(wide(spark, sf_dir)).select(*facts.KEYS, F.col("REV").alias("rev"), "prev_rev", F.col("AR").alias("ar"), "prev_ar")


@query(WARNINGS + "SELECT * FROM x")
def dq_manual_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select(*facts.KEYS, F.explode(quality.manual_warnings()).alias("x")).select(*facts.KEYS, "x.*")


@query(WIDE + f"SELECT {KEYS}, CASE WHEN {MISMATCH} OR ({LOW_CASH}) THEN 'PENDING_REVIEW' ELSE 'VERIFIED' END AS status FROM w")
def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select(*facts.KEYS, quality.manual_status().alias("status"))


@query(WIDE + f"""SELECT {KEYS}, {GAP} AS gap FROM w WHERE {GAP} > greatest(abs("TOTAL_ASSETS") * 0.0001, 1)""")
def dq_commit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).where(quality.commit_blocked()).select(*facts.KEYS, quality.gap().alias("gap"))


@query(WARNINGS + "SELECT severity, code, count(*) AS n_warnings, count(DISTINCT company) AS n_companies FROM x GROUP BY ALL")
def warning_counts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq_manual_warnings(spark, sf_dir).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n_warnings"), F.countDistinct("company").alias("n_companies"))


@query(WIDE + f""", y AS (SELECT *, lag(year) OVER v AS py, lag("REV") OVER v AS pr, lag("NET_PROFIT") OVER v AS pn FROM w WINDOW v AS (PARTITION BY company, period ORDER BY year))
  SELECT {KEYS}, CASE WHEN py = year - 1 THEN ("REV" - pr) / NULLIF(abs(pr), 0) END AS rev_growth, CASE WHEN py = year - 1 THEN ("NET_PROFIT" - pn) / NULLIF(abs(pn), 0) END AS net_profit_growth FROM y""")
def growth_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.growth(wide(spark, sf_dir), ("REV", "NET_PROFIT"))


FLOWS = ("REV", "COGS", "OPERATING_PROFIT", "NET_PROFIT", "OCF", "CAPEX", "FINANCE_COST")


@query(LONG + f""", y AS (SELECT *, lag(value) OVER v AS before, lag(period_ord) OVER v AS prev FROM f WHERE code IN {FLOWS} WINDOW v AS (PARTITION BY company, year, code ORDER BY period_ord))
  SELECT company, year, period_ord, 'Q' || period_ord AS quarter, code, CASE WHEN period_ord = 1 THEN value WHEN prev = period_ord - 1 THEN value - before END AS value FROM y""")
def standalone_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.standalone_quarters(facts_long(spark, sf_dir), FLOWS)


@query(WIDE + f"""SELECT {KEYS}, "REV" AS rev, "NET_PROFIT" AS net_profit FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY year DESC, period_ord DESC) AS n FROM w) WHERE n = 1""")
def latest_report_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = facts.latest(wide(spark, sf_dir), ["company"], [F.col("year").desc(), F.col("period_ord").desc()])
    return got.select(*facts.KEYS, F.col("REV").alias("rev"), F.col("NET_PROFIT").alias("net_profit"))


@query(WIDE + """SELECT s_suppkey AS company, s_name AS name, count(w.company) AS n_reports FROM supplier LEFT JOIN w ON s_suppkey = w.company GROUP BY s_suppkey, s_name""")
def company_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = wide(spark, sf_dir).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "supplier").join(n, F.col("s_suppkey") == F.col("company"), "left").select(F.col("s_suppkey").alias("company"), F.col("s_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n_reports"))


@query(WIDE + f"""SELECT (SELECT least(count(*), 10) FROM supplier) AS companies_shown, count(*) AS n_reports, count(*) FILTER (WHERE {MISMATCH} OR ({LOW_CASH})) AS n_pending,
  count(*) FILTER (WHERE {MISMATCH}) + count(*) FILTER (WHERE {LOW_CASH}) AS n_warnings FROM w""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard counts at most ten companies, since that many are listed."""
    n = wide(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_reports"), F.count_if(quality.manual_status() == "PENDING_REVIEW").alias("n_pending"), F.sum(F.size(quality.manual_warnings())).cast("long").alias("n_warnings"))
    shown = table(spark, sf_dir, "supplier").agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("companies_shown"))
    one = F.lit(1).alias("k")
    return shown.select("*", one).join(n.select("*", one), "k").drop("k")


@query(WIDE + f"""SELECT {KEYS}, strftime(last_day(make_date(year, CASE period WHEN 'Q1' THEN 3 WHEN 'H1' THEN 6 WHEN 'Q3' THEN 9 ELSE 12 END, 1)), '%Y-%m-%d') AS period_end FROM w""")
def period_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select(*facts.KEYS, F.date_format(S.period_end("year", "period"), "yyyy-MM-dd").alias("period_end"))


#: The account that a line is booked on.
USED = "CASE l_partkey % 6 WHEN 0 THEN 'CASH' WHEN 1 THEN 'REV' WHEN 2 THEN 'OCF' WHEN 3 THEN 'AR' WHEN 4 THEN 'COGS' ELSE 'NONE' END"
ACCOUNTS = values(schemas.ACCOUNTS, "code, name, statement_type, value_nature, sort_order")
STATEMENT_ORD = "CASE statement_type WHEN 'INCOME_STATEMENT' THEN 1 WHEN 'BALANCE_SHEET' THEN 2 WHEN 'CASH_FLOW' THEN 3 ELSE 4 END"


@query(f"SELECT code, name, statement_type, value_nature, CAST(sort_order AS INTEGER) AS sort_order, n_used FROM (SELECT * FROM {ACCOUNTS}) JOIN (SELECT {USED} AS code, count(*) AS n_used FROM lineitem GROUP BY 1) USING (code)")
def account_master_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that lines are booked on, in order of statement, sort order and name."""
    used = table(spark, sf_dir, "lineitem").groupBy(F.expr(USED).alias("code")).agg(F.count(F.lit(1)).alias("n_used"))
    got = schemas.accounts(spark).join(used, "code")
    return got.orderBy(S.ordinal("statement_type", schemas.STATEMENTS), "sort_order", "name").select("code", "name", "statement_type", "value_nature", F.col("sort_order"), "n_used")


@query("SELECT statement_type, CAST(coalesce(max(sort_order), 0) + 10 AS INTEGER) AS next_sort FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'CASH_FLOW' WHEN 2 THEN 'BALANCE_SHEET' ELSE 'INCOME_STATEMENT' END AS statement_type, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 10 + p_partkey END AS sort_order FROM part) GROUP BY statement_type")
def account_next_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sort order that the next account of each statement gets; parts stand for accounts."""
    rows = table(spark, sf_dir, "part").select(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'CASH_FLOW' WHEN 2 THEN 'BALANCE_SHEET' ELSE 'INCOME_STATEMENT' END").alias("statement_type"), F.expr("CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size * 10 + p_partkey AS INT) END").alias("sort_order"))
    return mutations.next_sort(rows, "statement_type", "sort_order").withColumn("next_sort", F.col("next_sort").cast("int"))


@query(LONG + f"SELECT code, count(*) AS n_facts FROM f WHERE code NOT IN (SELECT code FROM {ACCOUNTS}) GROUP BY code UNION ALL SELECT code, 0 FROM {ACCOUNTS} WHERE code NOT IN (SELECT code FROM f)")
def dictionary_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of facts without an account, and accounts without a fact."""
    used = facts_long(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n_facts"))
    known = schemas.accounts(spark).select("code")
    return used.join(known, "code", "left_anti").unionByName(known.join(used, "code", "left_anti").withColumn("n_facts", F.lit(0).cast("long")))


@query(LONG + f"""SELECT {KEYS}, max(CASE WHEN code = 'AR' THEN value END) AS ar, max(CASE WHEN code = 'AP' THEN value END) AS ap, bool_or(code = 'AR') AS has_ar, bool_or(code = 'AP') AS has_ap FROM f GROUP BY {KEYS}""")
def diagnostics_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = facts_long(spark, sf_dir).groupBy(*facts.KEYS)
    pick = lambda c: F.max(F.when(F.col("code") == c, F.col("value")))
    return got.agg(pick("AR").alias("ar"), pick("AP").alias("ap"), F.bool_or(F.col("code") == "AR").alias("has_ar"), F.bool_or(F.col("code") == "AP").alias("has_ap"))


@query(WIDE + f""", y AS (SELECT *, lag("REV") OVER (PARTITION BY company, period ORDER BY year) AS before FROM w)
  SELECT {KEYS}, before, "REV" AS rev FROM y WHERE before > 0 AND ("REV" > before * 1.5::DOUBLE OR "REV" * 1.5::DOUBLE < before)""")
def dq_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.jumps(wide(spark, sf_dir), "REV", 1.5).select(*facts.KEYS, "before", F.col("REV").alias("rev"))


@query(WIDE + f"""SELECT {KEYS}, coalesce("OCF", 0) + coalesce(-"CAPEX", 0) + coalesce("TOTAL_DEBT" / 2, 0) - "CASH" AS cash_gap FROM w""")
def dq_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash-flow reconciliation, with stand-ins for the flows that the fixture lacks."""
    got = wide(spark, sf_dir).withColumns({"ICF": -F.col("CAPEX"), "CFF": F.col("TOTAL_DEBT") / 2, "NET_CHANGE_CASH": F.col("CASH")})
    return quality.cash_flow_gap(got).select(*facts.KEYS, "cash_gap")


TREND = """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS net_profit, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS ocf, count(*) AS debt FROM orders GROUP BY 1"""


@query(f"""SELECT year, CAST(net_profit AS DOUBLE) / NULLIF(CAST(revenue AS DOUBLE), 0) AS net_margin, CAST(ocf AS DOUBLE) / NULLIF(CAST(net_profit AS DOUBLE), 0) AS ocf_to_net_profit, CAST(debt - lag(debt) OVER (ORDER BY year) AS DOUBLE) AS debt_change FROM ({TREND})""")
def history_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of each year and the change against the year before; orders' years stand for a company's."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tallyloom_orders")
    h = spark.sql(TREND.replace("FROM orders", "FROM tallyloom_orders"))
    before = h.select((F.col("year") + 1).alias("year"), F.col("debt").alias("before"), F.lit(True).alias("known"))
    d = lambda c: F.col(c).cast("double")
    return h.join(before, "year", "left").select("year", S.ratio(d("net_profit"), d("revenue")).alias("net_margin"), S.ratio(d("ocf"), d("net_profit")).alias("ocf_to_net_profit"), (F.col("debt") - F.col("before")).cast("double").alias("debt_change"))


def shown(x: str, unit: str) -> str:
    """A ratio's text in SQL, whose format rounds halves to even."""
    digits = 1 if unit == "%" else 2
    half = f"CASE WHEN ({x}) * {4 ** digits // digits} % 2 IN (1, -1) THEN sign({x}) * 0.001 ELSE 0.0 END"
    return f"coalesce(format('{{:.{digits}f}}', ({x}) + {half}) || '{unit}', 'N/A')"


@query(WIDE + " UNION ALL ".join(f"SELECT {KEYS}, '{n}' AS ratio, {shown(x, r[3])} AS shown, CASE WHEN {x} {r[4]} {r[5]} THEN 'Healthy' ELSE 'Monitor' END AS verdict FROM w" for x, (n, r) in zip(PAGE, ratios.PAGE.items())))
def ratio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios as they are shown, rounded from the exact binary value."""
    got = ratios.health(wide(spark, sf_dir), facts.KEYS)
    text = F.when(F.col("unit") == "%", S.fixed_text("value", 1)).otherwise(S.fixed_text("value", 2))
    return got.select(*facts.KEYS, "ratio", F.coalesce(F.concat(text, "unit"), F.lit("N/A")).alias("shown"), "verdict")
