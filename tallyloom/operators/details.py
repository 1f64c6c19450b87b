"""Reports, runs and accounts with what belongs to them, and the uploads' own states.

Children are filtered and gathered by their parent's key before they are joined, so a parent with several
kinds of children is never multiplied, and one without any stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import ordinal
from tallyloom.sources.schemas import PERIODS, STATEMENTS

# How statements are named, and how far an upload is by the service's answer.
STATEMENT_LABELS = {"INCOME_STATEMENT": "Income Statement", "BALANCE_SHEET": "Balance Sheet", "CASH_FLOW": "Cash Flow", "OTHER": "Other"}
WAITING = ("queued", "in_progress")


def chosen_label(key: Column, labels: dict[str, str]) -> Column:
    """The label of an enum's value; null if it has none."""
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[key]


def plain_number(value: Column) -> Column:
    """A decimal as text, without zeros at its end."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def strings_of(text: Column) -> Column:
    """The strings of a JSON array, without its other items; of any other value, none."""
    items = F.from_json(text, "array<variant>")
    kept = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(kept, lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>"))


def report_label(ticker: Column, period: Column, year: Column) -> Column:
    return F.concat(ticker, F.lit(" · "), period, F.lit(" "), year.cast("string"))


def active(table: DataFrame, *columns: str) -> DataFrame:
    return table.where("is_active").select(*columns)


def account_master(accounts: DataFrame) -> DataFrame:
    """Active accounts in order of statement, sort order and name, with their ``place`` within the statement."""
    order = [F.col(c) for c in ("sort_order", "name", "account_id")]
    got = accounts.where("is_active").withColumn("place", F.row_number().over(Window.partitionBy("statement_type").orderBy(*order)))
    return got.orderBy(ordinal("statement_type", STATEMENTS), "place")


def extractable(accounts: DataFrame) -> DataFrame:
    """Accounts that a document can state, in order of statement and place."""
    return accounts.where("is_active AND NOT is_calculated").orderBy(ordinal("statement_type", STATEMENTS), "sort_order")


def gathered(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[Column], value: Column) -> DataFrame:
    """``parents`` with an array ``name`` of the children's ``value`` in order, empty if there are none."""
    ordered = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("value"))
    lists = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(ordered)), lambda x: x["value"]).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def nulls_last(value: Column) -> list[Column]:
    """A key that sorts nulls after all else, for arrays of structs."""
    return [value.isNull(), value]


def report_entries(reports: DataFrame, companies: DataFrame, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each report with its company and, one row each, its entries and their accounts; one row if it has none."""
    known = accounts.select("code", F.col("name").alias("account_name"), "statement_type")
    return reports.join(companies, "company_id").join(entries, "report_id", "left").join(known, "code", "left")


def mapping_list(mappings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Mappings with their account, in order of the label."""
    return mappings.join(accounts.select("code", "name", "statement_type"), "code").orderBy("source_label")


def statements_of(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """One statement for each report and type that its entries' accounts have, but for OTHER."""
    kinds = entries.join(accounts.select("code", "statement_type"), "code").where("statement_type <> 'OTHER'")
    return kinds.select("report_id", "statement_type").distinct().withColumn("statement_id", F.concat_ws("-", F.col("report_id").cast("string"), "statement_type"))


def with_statement(entries: DataFrame, accounts: DataFrame, statements: DataFrame) -> DataFrame:
    """Entries with the statement of their account's type, null where the report has none."""
    return entries.join(accounts.select("code", "statement_type"), "code", "left").join(statements, ["report_id", "statement_type"], "left")


def searched(accounts: DataFrame, terms: list[str]) -> DataFrame:
    """Accounts that hold each term in one of their six texts; a blank term finds all."""
    words = F.array_join("aliases", " ")
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("code", "name", "display_name", "description", "definition")]
    hay = F.lower(F.concat_ws(" ", *texts, F.coalesce(words, F.lit(""))))
    return accounts.withColumn("term", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: hay.contains(F.trim(F.lower(t))))))


def objects_of(text: Column, *fields: str) -> Column:
    """The objects of a JSON array, as structs of these fields as text, without its other items; of any other value, none."""
    items = F.from_json(text, "array<variant>")
    kept = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.coalesce(F.transform(kept, lambda x: F.struct(*(F.try_variant_get(x, f"$.{f}", "string").alias(f) for f in fields))), F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"))


def counted_and_dropped(runs: DataFrame, nested: str, status: str, states: Sequence[str]) -> DataFrame:
    """Rows with their nested array counted by a state of its items, and without the array itself."""
    n = lambda s: F.size(F.filter(F.coalesce(F.col(nested), F.array()), lambda x: x[status] == s))
    return runs.withColumns({s.lower(): n(s) for s in states}).withColumn("total", F.coalesce(F.array_size(nested), F.lit(0))).drop(nested)


def in_order(reports: DataFrame) -> DataFrame:
    """Reports of each year with their ``place``: by the company's ticker, then the period's order and the id."""
    order = [F.col("ticker"), ordinal("period", PERIODS), F.col("report_id")]
    return reports.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(*order))).orderBy(F.desc("year"), "place")


def missing_texts(accounts: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Accounts whose dictionary row lacks a text, and which: null, blank, and an empty list are lacking."""
    lacks = lambda c: F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") | (F.col(c).cast("string") == "[]"), F.lit(c))
    return accounts.withColumn("missing", F.array_compact(F.array(*map(lacks, texts)))).where(F.size("missing") > 0)


# -- uploads that a service extracts


def open_jobs(jobs: DataFrame, most: int = 100) -> DataFrame:
    """The latest jobs that no run has come of, without the file's bytes."""
    return jobs.where(F.col("run_id").isNull()).drop("content").orderBy(F.desc("updated_at"), "job_id").limit(most)


def upload_queue(jobs: DataFrame, most: int) -> DataFrame:
    """The next uploads to hand over."""
    return jobs.where((F.col("status") == "UPLOADED") & F.col("response_id").isNull()).orderBy("created_at", "job_id").limit(most)


def handed_over(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """Uploads after they were handed over: ``answers`` has the service's id and state, or an error.

    One that the service has done at once is COMPLETED without a run, and isn't asked for again.
    """
    return jobs.join(answers, "job_id").where((F.col("status") == "UPLOADED") & F.col("response_id").isNull()).withColumns({
        "from_status": F.col("status"),
        "status": F.when(F.col("error").isNotNull(), "FAILED").when(F.col("state").isin(*WAITING), "PROCESSING").otherwise(F.upper("state")),
        "response_id": F.when(F.col("error").isNull(), F.col("answer_id")),
        "error_message": F.col("error"),
    })


def asked_again(jobs: DataFrame, answers: DataFrame, run_of: Column) -> DataFrame:
    """Uploads in progress by the service's answer: still waiting, done with a run, or failed with a reason."""
    failed = ~F.col("state").isin(*WAITING, "completed")
    reason = F.coalesce(F.nullif("error", F.lit("")), F.nullif("reason", F.lit("")), F.concat(F.lit("background response "), "state"))
    return jobs.join(answers, "job_id").where((F.col("status") == "PROCESSING") & F.col("response_id").isNotNull()).withColumns({
        "from_status": F.col("status"),
        "status": F.when(F.col("state").isin(*WAITING), "PROCESSING").when(failed, "FAILED").otherwise("COMPLETED"),
        "run_id": F.when(F.col("state") == "completed", run_of),
        "error_message": F.when(failed, reason).otherwise(F.col("error_message")),
    })


#: What an upload that failed forgets when its file is given again.
FORGOTTEN = ("response_id", "run_id", "detected_ticker", "detected_name", "detected_year", "detected_period", "error_message")


def reset_failed(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """For each upload the number of failed jobs that it resets, ``changed``, and the job as it then is.

    ``uploads``: ``job_id`` and the new file's ``new_name``, ``new_mime``, ``new_size``. Anything but 1 is an error for the caller.
    """
    job = jobs.withColumn("found_", F.lit(True))
    got = uploads.join(job.where(F.col("status") == "FAILED"), "job_id", "left").withColumn("changed", F.when(F.col("found_"), 1).otherwise(0)).drop("found_")
    new = {c: F.lit(None).cast(jobs.schema[c].dataType) for c in FORGOTTEN}
    given = {"file_name": "new_name", "mime_type": "new_mime", "file_size": "new_size"}
    return got.withColumns({"status": F.when(F.col("changed") == 1, "UPLOADED"), **new, **{k: F.when(F.col("changed") == 1, F.col(v)) for k, v in given.items()}}).drop(*given.values())
