"""The list of running and finished extractions, its filters, pages and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import first_given
from tallyloom.sources.schemas import STATUS_GROUPS

UNKNOWN = "AI DETECTING"
COLUMNS = ("id", "kind", "file_name", "status", "ticker", "company_name", "updated_at", "pending", "accepted", "rejected", "committed", "n_candidates")


def job_rows(jobs: DataFrame) -> DataFrame:
    """Background jobs as rows of the list; an issuer that isn't known yet has stand-ins."""
    zero = F.lit(0).cast("bigint")
    return jobs.select(
        "id", F.lit("JOB").alias("kind"), "file_name", "status", first_given("detected_ticker", F.lit(UNKNOWN)).alias("ticker"),
        first_given("detected_name", F.lit("Background extraction in progress")).alias("company_name"), "updated_at",
        zero.alias("pending"), zero.alias("accepted"), zero.alias("rejected"), zero.alias("committed"), zero.alias("n_candidates"),
    )


def run_rows(runs: DataFrame, candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """Extraction runs with their candidates counted by state."""
    n = lambda s: F.count_if(F.col("c_status") == s)
    counted = candidates.select("run_id", F.col("status").alias("c_status")).groupBy("run_id").agg(n("PENDING").alias("pending"), n("ACCEPTED").alias("accepted"), n("REJECTED").alias("rejected"), n("COMMITTED").alias("committed"), F.count(F.lit(1)).alias("n_candidates"))
    got = runs.join(counted, runs["id"] == counted["run_id"], "left").join(companies, "company_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return got.select("id", F.lit("RUN").alias("kind"), "file_name", "status", "ticker", "company_name", "updated_at", *[zero(c) for c in COLUMNS[7:]])


def listed(jobs: DataFrame, runs: DataFrame, most_jobs: int = 100, most_runs: int = 300) -> DataFrame:
    """Both kinds together, of each only the most recent: this cap is what the list shows."""
    top = lambda df, n: df.orderBy(F.col("updated_at").desc(), F.col("id").asc()).limit(n)
    return top(jobs, most_jobs).unionByName(top(runs, most_runs))


def matches(group: str | None, search: str | None) -> Column:
    """Rows of a status group (an unknown one: all) that hold the words searched for."""
    out = F.lit(True)
    if wanted := STATUS_GROUPS.get((group or "ALL").upper()):
        out = out & F.col("status").isin(*wanted)
    if words := (search or "").strip().lower():
        out = out & F.lower(F.concat_ws(" ", "ticker", "company_name", "file_name")).contains(words)
    return out


def page(rows: DataFrame, number: float | None = 1, size: float | None = 20) -> DataFrame:
    """A page of the list, latest first, jobs before runs on ties."""
    number, size = max(1, int(number or 1)), min(50, max(5, int(size or 20)))
    order = [F.col("updated_at").desc(), F.col("kind").asc(), F.col("id").asc()]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(total: int, size: float | None = 20) -> int:
    size = min(50, max(5, int(size or 20)))
    return max(1, -(-total // size))


def page_counts(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """For each status group and page size the rows, and the pages they take: one at least. Sizes are brought within their bounds."""
    counts = summary(rows).select("status_group", F.col("reports").alias("total"))
    bound = F.least(F.lit(50), F.greatest(F.lit(5), F.col("asked")))
    got = counts.withColumn("asked", F.explode(F.array(*map(F.lit, sizes)))).withColumn("size", bound)
    return got.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("size"))).cast("int"))


def summary(rows: DataFrame) -> DataFrame:
    """Reports and known companies of each status group and of all, also of groups without any."""
    known = F.when(F.col("ticker") != UNKNOWN, F.col("ticker"))
    each = [F.count_if(F.col("status").isin(*s)).alias(f"{g}_reports") for g, s in STATUS_GROUPS.items()] + [F.countDistinct(F.when(F.col("status").isin(*s), known)).alias(f"{g}_companies") for g, s in STATUS_GROUPS.items()]
    one = rows.agg(F.count(F.lit(1)).alias("ALL_reports"), F.countDistinct(known).alias("ALL_companies"), *each)
    names = ["ALL", *STATUS_GROUPS]
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("status_group"), F.col(f"{g}_reports").alias("reports"), F.col(f"{g}_companies").alias("companies")) for g in names])).alias("x")).select("x.*")
