"""Staging of extracted facts: matching, review, safe aggregation and commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import clamp, first_given, first_nonzero, issuer_key, ordinal, staged_label
from tallyloom.sources.schemas import STATEMENTS


class UnknownCodes(ValueError):
    """Codes that no account has."""


def accounts_of(rows: DataFrame, accounts: DataFrame, code: str = "code", named: int = 20) -> DataFrame:
    """Rows with their account's ``account_name`` and ``account_statement``; codes that no account has are an error.

    The codes are looked for first, as an anti join of distinct ones; the error names the first ``named`` of them and says how many there are.
    """
    known = accounts.select(F.col("code").alias("code_"), F.col("name").alias("account_name"), F.col("statement_type").alias("account_statement"))
    missing = rows.select(F.col(code).alias("m_")).distinct().join(known, F.col("m_") == F.col("code_"), "left_anti")
    if first := [str(r["m_"]) for r in missing.orderBy("m_").limit(named).collect()]:
        raise UnknownCodes(f"{missing.count()} codes without an account: {', '.join(first)}")
    return rows.join(known, F.col(code) == F.col("code_")).drop("code_")


def match_accounts(candidates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each candidate with its account by upper-cased code, ``account_name`` and ``account_statement`` null if unknown."""
    known = accounts.select(F.upper("code").alias("code_"), F.col("name").alias("account_name"), F.col("statement_type").alias("account_statement"))
    return candidates.join(known, F.upper("canonical_code") == F.col("code_"), "left").drop("code_")


def first_chunk(page: Column, chunks: Column) -> Column:
    """Ordinal of the first chunk, in the array's order, whose pages hold ``page``."""
    return F.get(F.filter(chunks, lambda c: (page >= c["page_start"]) & (page <= c["page_end"])), F.lit(0))["ordinal"]


def attach_chunks(candidates: DataFrame, chunks: DataFrame, key: str = "run_id") -> DataFrame:
    """``chunk_ordinal`` of each candidate. A run's chunks are few and go along as one array, so no range
    join has to compare every candidate with every chunk."""
    lists = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "page_start", "page_end"))).alias("chunks_"))
    return candidates.join(lists, key, "left").withColumn("chunk_ordinal", first_chunk(F.col("source_page"), F.col("chunks_"))).drop("chunks_")


def match_issuers(detected: DataFrame, companies: DataFrame) -> DataFrame:
    """Each detected issuer with a company by ticker, else by name, the first by id; blank keys match nothing."""
    by_ticker = companies.select(issuer_key("ticker").alias("key_t"), F.struct("company_id", "ticker", "name").alias("c")).where("key_t <> ''").groupBy("key_t").agg(F.min("c").alias("by_ticker"))
    by_name = companies.select(issuer_key("name").alias("key_n"), F.struct("company_id", "ticker", "name").alias("c")).where("key_n <> ''").groupBy("key_n").agg(F.min("c").alias("by_name"))
    got = detected.join(by_ticker, issuer_key("detected_ticker") == F.col("key_t"), "left").join(by_name, issuer_key("detected_name") == F.col("key_n"), "left")
    return got.withColumn("matched", F.coalesce("by_ticker", "by_name")).drop("key_t", "key_n", "by_ticker", "by_name")


def gate() -> Column:
    """What keeps an extraction from being staged: issuer first, then period; null if nothing does."""
    issuer = F.col("matched").isNotNull() & (F.coalesce("company_confidence", F.lit(0.0)) >= 0.95)
    period = (F.coalesce("detected_year", F.lit(0)) != 0) & (F.coalesce("detected_period", F.lit("")) != "") & (F.coalesce("period_confidence", F.lit(0.0)) >= 0.75)
    return F.when(~issuer, "COMPANY").when(~period, "PERIOD")


def review_counts(candidates: DataFrame, key: str = "run_id") -> DataFrame:
    """For each run the candidates in each state, the share reviewed, and the run's status."""
    n = lambda s: F.count_if(F.col("status") == s)
    got = candidates.groupBy(key).agg(n("PENDING").alias("pending"), n("ACCEPTED").alias("accepted"), n("REJECTED").alias("rejected"), n("COMMITTED").alias("committed"), F.count(F.lit(1)).alias("total"))
    return got.withColumns({"reviewed": F.col("total") - F.col("pending"), "run_status": F.when(F.col("pending") == 0, "READY_TO_COMMIT").otherwise("PENDING_REVIEW")})


def by_statement(candidates: DataFrame) -> DataFrame:
    """Candidates for each statement, those without one under OTHER, in the statements' order."""
    kind = F.coalesce("statement_type", F.lit("OTHER"))
    got = candidates.groupBy(kind.alias("statement_type")).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("status") == "PENDING").alias("n_pending"))
    return got.withColumn("statement_ord", ordinal("statement_type", STATEMENTS))


# What is noted of a candidate that goes back.
RETURNED = "Returned to pending for review."


def review(candidates: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Candidates after review, with ``outcome``: applied, or why not.

    A candidate of a committed run is locked; accepting needs an account, given now or before.
    """
    d = decisions.select(F.col("candidate_id").alias("id_"), "decision", F.col("account").alias("new_account"), "note")
    got = candidates.join(d, F.col("candidate_id") == F.col("id_"), "left").drop("id_")
    account = F.coalesce("new_account", "canonical_code")
    outcome = F.when(F.col("decision").isNull(), "NONE").when(F.col("run_status") == "COMMITTED", "LOCKED").when((F.col("decision") == "ACCEPTED") & account.isNull(), "NEEDS_ACCOUNT").otherwise("APPLIED")
    got = got.withColumn("outcome", outcome)
    on, back = F.col("outcome") == "APPLIED", F.col("decision") == "PENDING"
    return got.withColumns({
        "status": F.when(on, F.col("decision")).otherwise(F.col("status")),
        "canonical_code": F.when(on, account).otherwise(F.col("canonical_code")),
        "review_note": F.when(on, F.coalesce("note", F.when(back, F.lit(RETURNED)))).otherwise(F.col("review_note")),
        "reviewed_at": F.when(on, F.when(~back, now)).otherwise(F.col("reviewed_at")),
    }).drop("decision", "new_account", "note")


# Words that tell a component's counterparty and a debt's term.
THIRD, RELATED = r"pihak\s+ketiga|third\s+part", r"pihak\s+berelasi|pihak\s+berhubungan|related\s+part"
SHORT, LONG = r"jangka\s+pendek|short[-\s]?term|overdraft|trust\s+receipt", r"jangka\s+panjang|long[-\s]?term"


def party(label: Column) -> Column:
    label = F.lower(label)
    return F.when(label.rlike(THIRD), "THIRD_PARTY").when(label.rlike(RELATED), "RELATED_PARTY")


def term(label: Column) -> Column:
    label = F.lower(label)
    return F.when(label.rlike(SHORT), "SHORT_TERM").when(label.rlike(LONG), "LONG_TERM").otherwise("OTHER_DEBT_FLOW")


def safe_groups(accepted: DataFrame, keys: tuple[str, ...] = ("run_id", "code")) -> DataFrame:
    """Whether the candidates of one account may be added up."""
    kind = F.when(F.col("code").isin("AR", "AP"), party(F.col("reported_label"))).when(F.col("code").isin("DEBT_ISSUED", "DEBT_REPAID"), term(F.col("reported_label")))
    got = accepted.withColumn("kind", kind).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("told"), F.countDistinct("kind").alias("kinds"))
    safe = (F.col("n") <= 1) | F.when(F.col("code").isin("AR", "AP"), (F.col("told") == F.col("n")) & (F.col("kinds") == 2)).when(F.col("code").isin("DEBT_ISSUED", "DEBT_REPAID"), F.col("kinds") == F.col("n")).otherwise(False)
    return got.select(*keys, F.col("n").alias("n_candidates"), safe.alias("is_safe"))


def usable(accepted: DataFrame) -> DataFrame:
    """Accepted candidates that can be committed: those with an account and a number."""
    return accepted.where(F.col("code").isNotNull() & F.col("numeric_value").isNotNull())


def commit_entries(accepted: DataFrame, accounts: DataFrame, runs: DataFrame) -> DataFrame:
    """One entry for each run and account from accepted candidates with an account and a number.

    Equal scales keep their scale and values are added; else values are scaled first. A page stays only if
    it is the only one. ``raw_text`` lists the components in order of ``ord``, or else is the first one's source text or value. An
    entry of several is labelled by its account's name. The currency is the first candidate's, or else the run's or its company's.
    ``accounts``: code, name; ``runs``: run_id, currency, company_currency.
    """
    scale = first_nonzero("scale", F.lit(1))
    line = F.concat(F.col("reported_label"), F.lit(": "), F.col("raw_value"), F.when(F.coalesce("source_page", F.lit(0)) != 0, F.concat(F.lit(" (page "), F.col("source_page").cast("string"), F.lit(")"))).otherwise(""))
    first = F.min(F.struct("ord", "reported_label", "raw_value", "source_text", "currency"))
    got = usable(accepted).groupBy("run_id", "code").agg(
        F.count(F.lit(1)).alias("n"), F.count("scale").alias("scales"), F.min("scale").alias("lo"), F.max("scale").alias("hi"), F.sum("numeric_value").alias("plain"), F.sum(F.col("numeric_value") * scale.cast("decimal(18,0)")).alias("scaled"),
        F.countDistinct("source_page").alias("pages"), F.max("source_page").alias("page"), F.min(F.least(F.coalesce("extraction_confidence", F.lit(0.0)), F.coalesce("mapping_confidence", F.lit(0.0)))).alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), " | ").alias("provenance"), first.alias("first"),
    )
    named = accounts.select(F.col("code").alias("code_"), F.col("name").alias("account_name"))
    terms = runs.select(F.col("run_id").alias("run_"), F.col("currency").alias("run_currency"), "company_currency")
    got = got.join(named, F.col("code") == F.col("code_"), "left").join(terms, F.col("run_id") == F.col("run_"), "left")
    same = (F.col("lo") == F.col("hi")) & (F.col("scales") == F.col("n"))  # a missing scale differs from a given one
    many = F.concat(F.coalesce("account_name", "code"), F.lit(" — aggregated from "), F.col("n").cast("string"), F.lit(" reviewed components"))
    return got.select(
        "run_id", "code", "n", F.when(same, F.col("plain")).otherwise(F.col("scaled")).cast("double").alias("value"), F.when(same, F.col("lo")).otherwise(1).alias("scale"), F.col("scaled").cast("double").alias("scaled_value"),
        F.when(F.col("pages") == 1, F.col("page")).alias("source_page"), "confidence", first_given("provenance", F.col("first.source_text"), F.col("first.raw_value")).alias("raw_text"),
        F.when(F.col("n") > 1, many).otherwise(F.col("first.reported_label")).alias("reported_label"), first_given(F.col("first.currency"), "run_currency", "company_currency").alias("currency"),
    )


def commit_statements(accepted: DataFrame, accounts: DataFrame, runs: DataFrame) -> DataFrame:
    """The statements that a commit needs, one for each run and type of account, with the run's currency, or else its company's, and unit."""
    types = accounts.select("code", "statement_type")
    got = usable(accepted).select("run_id", "code").join(types, "code").select("run_id", "statement_type").distinct().join(runs, "run_id")
    return got.select("run_id", "statement_type", first_given("currency", "company_currency").alias("currency"), first_nonzero("unit_scale", F.lit(1)).alias("unit_scale"))


def commit_candidates(accepted: DataFrame) -> DataFrame:
    """Candidates as a commit leaves them: those it used are COMMITTED, with a note where several make one entry; others stay.

    Components are counted by run and account first and joined back, so a large group is never gathered.
    """
    used = F.col("code").isNotNull() & F.col("numeric_value").isNotNull()
    sizes = usable(accepted).groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("components_"))
    got = accepted.join(sizes, ["run_id", "code"], "left")
    note = F.concat(F.lit("Aggregated into canonical "), "code", F.lit(" with reviewed "), F.col("components_").cast("string"), F.lit(" components."))
    return got.withColumns({"status": F.when(used, "COMMITTED").otherwise(F.col("status")), "review_note": F.when(used & (F.col("components_") > 1), note).otherwise(F.col("review_note"))}).drop("components_")


# What the audit row of a commit says of it.
COMMITTED = (" reviewed PDF candidates committed into ", " canonical financial facts after validation. Safe aggregation supports AR/AP counterparties and DEBT_ISSUED/DEBT_REPAID maturity components; provenance is preserved in FinancialEntry.rawText.")


def commit_audit(accepted: DataFrame) -> DataFrame:
    """One audit row for each committed run."""
    got = usable(accepted).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("facts"))
    note = F.concat(F.col("n").cast("string"), F.lit(COMMITTED[0]), F.col("facts").cast("string"), F.lit(COMMITTED[1]))
    return got.select("run_id", F.lit("PDF_AI_COMMIT").alias("action"), F.lit("web-user").alias("actor"), F.lit("ExtractionRun").alias("entity"), F.col("run_id").cast("string").alias("entity_id"), note.alias("note"))


def commit_verdicts(candidates: DataFrame, runs: DataFrame, reports: DataFrame) -> DataFrame:
    """For each run the first reason that keeps it from being committed, or READY.

    ``runs``: run_id, company, year, period, status, report_id. ``reports``: report_id, company, year, period.
    """
    accepted = (F.col("status") == "ACCEPTED") & F.col("code").isNotNull() & F.col("numeric_value").isNotNull()
    amount = F.col("numeric_value") * first_nonzero("scale", F.lit(1)).cast("decimal(18,0)")
    totals = [F.sum(F.when(accepted & (F.col("code") == c), amount)).cast("double").alias(c) for c in ("TOTAL_ASSETS", "TOTAL_LIAB", "EQUITY")]
    sums = candidates.groupBy("run_id").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(accepted).alias("usable"), *totals)
    unsafe = safe_groups(candidates.where(accepted)).groupBy("run_id").agg(F.count_if(~F.col("is_safe")).alias("unsafe"))
    taken = reports.select(F.col("report_id").alias("other_id"), F.col("company").alias("c_"), F.col("year").alias("y_"), F.col("period").alias("p_"))
    got = runs.join(sums, "run_id", "left").join(unsafe, "run_id", "left")
    got = got.join(taken, (F.col("company") == F.col("c_")) & (F.col("year") == F.col("y_")) & (F.col("period") == F.col("p_")), "left")
    a, rest = F.col("TOTAL_ASSETS"), F.abs(F.col("TOTAL_ASSETS") - F.col("TOTAL_LIAB") - F.col("EQUITY"))
    verdict = (
        F.when(F.col("status") == "COMMITTED", "ALREADY_COMMITTED").when(F.col("year").isNull() | F.col("period").isNull(), "NO_PERIOD").when(F.coalesce("pending", F.lit(0)) > 0, "PENDING")
        .when(F.coalesce("usable", F.lit(0)) == 0, "NOTHING_ACCEPTED").when(F.coalesce("unsafe", F.lit(0)) > 0, "UNSAFE_AGGREGATE").when(rest > F.greatest(F.abs(a) * 0.0001, F.lit(1.0)), "UNBALANCED")
        .when(F.col("other_id").isNotNull() & ~F.col("other_id").eqNullSafe(F.col("report_id")), "REPORT_EXISTS").otherwise("READY")
    )
    return got.select("run_id", verdict.alias("verdict"))


# The chunk that stands for an answer without any, and signs of a chunk's text that are kept.
WHOLE_ANSWER = ("Financial Statements", "SECTION", "AI extraction result")
CHUNK_TEXT = 12_000


def staged_chunks(extractions: DataFrame) -> DataFrame:
    """Chunks of extraction answers, numbered from 1, texts cut and hashed whole; one synthetic chunk for an answer without any."""
    section, kind, text = map(F.lit, WHOLE_ANSWER)
    none = F.lit(None).cast("int")
    alone = F.array(F.struct(section.alias("section"), kind.alias("chunkType"), none.alias("pageStart"), none.alias("pageEnd"), text.alias("textSummary")))
    chunks = F.col("extraction")["chunks"]
    rows = extractions.where("valid").select("run_id", F.posexplode(F.when(F.size(chunks) > 0, chunks).otherwise(alone)).alias("pos", "c"))
    return rows.select("run_id", (F.col("pos") + 1).alias("ordinal"), F.col("c.chunkType").alias("chunk_type"), F.col("c.pageStart").alias("page_start"), F.col("c.pageEnd").alias("page_end"), F.col("c.section").alias("section"), F.substring("c.textSummary", 1, CHUNK_TEXT).alias("text"), F.sha2(F.col("c.textSummary").cast("binary"), 256).alias("text_hash"))


def staged(extractions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Candidates of extraction answers: numbers only, defaults filled in, texts cut, confidences clamped.

    A currency that neither the candidate nor the answer gives is the company's, ``company_currency`` of the rows.
    """
    e = F.col("extraction")
    rows = extractions.where("valid").select("run_id", "company_currency", e["detectedCurrency"].alias("cur_"), e["detectedUnitScale"].alias("scale_"), e["chunks"].alias("chunks_"), F.posexplode(e["candidates"]).alias("pos", "c"))
    value = F.col("c.numericValue")
    rows = rows.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))).withColumn("canonical_code", F.col("c.canonicalCode"))
    got = match_accounts(rows, accounts)
    page = F.col("c.sourcePage")
    numbered_ = F.transform(F.col("chunks_"), lambda x, i: F.struct((i + 1).alias("ordinal"), x["pageStart"].alias("a"), x["pageEnd"].alias("b")))
    at = F.get(F.filter(numbered_, lambda x: (page >= x["a"]) & (page <= x["b"])), F.lit(0))["ordinal"]
    known = F.col("account_name").isNotNull()
    return got.select(
        "run_id", F.col("pos").alias("ord"), F.col("c.statementType").alias("statement_type"), F.substring("c.reportedLabel", 1, 500).alias("reported_label"),
        staged_label("c.reportedLabel").alias("normalized_label"), F.substring("c.rawValue", 1, 250).alias("raw_value"), value.cast("decimal(28,6)").alias("numeric_value"),
        first_given(F.col("c.currency"), "cur_", "company_currency").alias("currency"), first_nonzero("c.scale", "scale_", F.lit(1)).alias("scale"), page.alias("source_page"),
        F.substring("c.sourceText", 1, 2000).alias("source_text"), at.alias("chunk_ordinal"), F.when(known, F.upper("canonical_code")).alias("code"), clamp("c.extractionConfidence").alias("extraction_confidence"),
        F.when(known, clamp("c.mappingConfidence")).otherwise(0.0).alias("mapping_confidence"), F.when(known, "AI").alias("mapping_method"), F.lit("PENDING").alias("status"),
    )


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows with ``ord``, their place within a key."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
