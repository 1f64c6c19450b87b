"""The store's own constraints, declared by table and found broken in one pass a table.

A table's CHECKs are one projection. Its unique keys, partial ones included, are one aggregation: every row gives one key for each of
them, under the constraint's name. Foreign keys of a table go the same way, together: child keys are summed by constraint and key before they
meet their parents' keys, so a key that a third of all rows have is a row a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """Broken where it is false; as in SQL, unknown passes."""

    name: str
    holds: str


@dataclass(frozen=True)
class Unique:
    """Broken where several rows, of those for which ``where`` holds, have one key without nulls."""

    name: str
    columns: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Foreign:
    """Broken where a given key isn't in the parent's column."""

    name: str
    column: str
    parent: str
    parent_column: str = "id"


@dataclass(frozen=True)
class Table:
    """Constraints of a table whose rows have an ``id``; ``required`` columns mustn't be null."""

    checks: Sequence[Check] = ()
    uniques: Sequence[Unique] = ()
    foreign: Sequence[Foreign] = ()
    required: Sequence[str] = ()
    enums: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def row_rules(self) -> dict[str, Column]:
        """Row rules by name."""
        out = {f"{c}_required": F.col(c).isNotNull() for c in self.required}
        out |= {f"{c}_domain": F.col(c).isin(*v) for c, v in self.enums.items()}
        return out | {c.name: F.expr(c.holds) for c in self.checks}


def broken_rows(rows: DataFrame, rules: Mapping[str, Column], key: str = "id") -> DataFrame:
    """``constraint_name`` and ``row_id`` of every row rule that is false."""
    if not rules:
        return rows.select(F.lit("").alias("constraint_name"), F.col(key).cast("string").alias("row_id")).limit(0)
    failed = F.array_compact(F.array(*[F.when(~holds, F.lit(name)) for name, holds in rules.items()]))
    return rows.select(F.explode(failed).alias("constraint_name"), F.col(key).cast("string").alias("row_id"))


def _keys(rows: DataFrame, keyed: Mapping[str, tuple[Sequence[str], Column]]) -> DataFrame:
    """For each row and constraint the key as text, and its hash; those with a null or left out by the constraint aren't given."""
    part = lambda c: F.col(c).cast("string")
    text = lambda columns: part(columns[0]) if len(columns) == 1 else F.concat(*(x for c in columns for x in (F.length(part(c)), F.lit(":"), part(c))))
    entry = lambda name, columns, where: F.when(where & ~F.greatest(*(F.col(c).isNull() for c in columns), F.lit(False)), F.struct(F.lit(name).alias("constraint_name"), text(columns).alias("key")))
    entries = F.array_compact(F.array(*[entry(name, columns, F.coalesce(where, F.lit(False))) for name, (columns, where) in keyed.items()]))
    return rows.select("id", F.explode(entries).alias("k")).select(F.col("id").cast("string").alias("row_id"), "k.constraint_name", "k.key", F.xxhash64("k.key").alias("hash"))


#: What keys are grouped by: the hash comes first, as rows are then sorted by a number and not by names that all begin alike.
KEY = ("hash", "constraint_name", "key")


def repeated(rows: DataFrame, uniques: Sequence[Unique]) -> DataFrame:
    """``constraint_name``, ``row_id`` (the smallest of a key's) and ``n_rows`` of every key that several rows have."""
    count, out = F.count(F.lit(1)).alias("n_rows"), []
    # A key that is the id itself names its rows, so rows of it are only counted, which needs no sort.
    for own in (True, False):
        keyed = {u.name: (u.columns, F.expr(u.where)) for u in uniques if (u.columns == ("id",)) == own}
        if keyed:
            keys = _keys(rows, keyed)
            got = keys.groupBy(*KEY).agg(count).withColumn("row_id", F.col("key")) if own else keys.groupBy(*KEY).agg(F.min("row_id").alias("row_id"), count)
            out.append(got.where("n_rows > 1").select("constraint_name", "row_id", "n_rows"))
    return reduce(DataFrame.unionByName, out)


def orphaned(rows: DataFrame, foreign: Sequence[Foreign], tables: Mapping[str, DataFrame]) -> DataFrame:
    """``constraint_name``, ``row_id`` (the smallest of a key's) and ``n_rows`` of every key that no parent has."""
    entries = F.array(*[F.struct(F.lit(f.name).alias("constraint_name"), F.col(f.column).cast("string").alias("key")) for f in foreign])
    keys = rows.select(F.col("id").cast("string").alias("row_id"), F.explode(entries).alias("k")).where("k.key IS NOT NULL")
    keys = keys.select("row_id", "k.constraint_name", "k.key", F.xxhash64("k.key").alias("hash"))
    children = keys.groupBy(*KEY).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n_rows"))
    parents = None
    for f in foreign:
        part = tables[f.parent].select(F.lit(f.name).alias("constraint_name"), F.col(f.parent_column).cast("string").alias("key"))
        parents = part if parents is None else parents.unionByName(part)
    return children.join(parents.withColumn("hash", F.xxhash64("key")), list(KEY), "left_anti").drop("hash", "key")


def violations(tables: Mapping[str, DataFrame], catalogue: Mapping[str, Table]) -> DataFrame:
    """For each broken constraint ``table_name``, ``constraint_name``, ``n_rows`` that break it and the first of them by id as text.

    A unique key's rows are all that have it. Tables without a declaration aren't looked at, and declared tables that aren't given are skipped.
    """
    out = None
    for name, declared in catalogue.items():
        if name not in tables:
            continue
        rows = tables[name]
        parts = [broken_rows(rows, declared.row_rules()).withColumn("n_rows", F.lit(1).cast("long"))]
        if declared.uniques:
            parts.append(repeated(rows, declared.uniques))
        if declared.foreign:
            parts.append(orphaned(rows, [f for f in declared.foreign if f.parent in tables], tables))
        for p in parts:
            p = p.select(F.lit(name).alias("table_name"), "constraint_name", "row_id", "n_rows")
            out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no table of the catalogue is given")
    return out.groupBy("table_name", "constraint_name").agg(F.sum("n_rows").alias("n_rows"), F.min("row_id").alias("first_id"))


ACTIVE = ("QUEUED", "CLAIMED", "RUNNING", "RETRY_WAIT", "NEEDS_INPUT")
LEAST_PART = 5_242_880
# The constraints of the platform tables.
STORE: dict[str, Table] = {
    "UploadSession": Table(
        checks=(Check("UploadSession_size_check", "expectedSize > 0"), Check("UploadSession_part_size_check", f"(uploadMode = 'SINGLE_PUT' AND partSize IS NULL) OR (uploadMode = 'MULTIPART' AND partSize IS NOT NULL AND partSize >= {LEAST_PART})")),
        uniques=(Unique("UploadSession_pkey", ("id",)), Unique("UploadSession_correlationId_key", ("correlationId",)), Unique("UploadSession_objectKey_key", ("objectKey",))),
        required=("correlationId", "uploadMode", "status", "objectKey", "expectedSize"),
        enums={"uploadMode": ("SINGLE_PUT", "MULTIPART"), "status": ("INITIATED", "UPLOADING", "UPLOADED", "VERIFYING", "VERIFIED", "ABORTED", "FAILED")},
    ),
    "UploadPart": Table(
        checks=(Check("UploadPart_number_check", "partNumber > 0"), Check("UploadPart_size_check", "size > 0")),
        uniques=(Unique("UploadPart_pkey", ("id",)), Unique("UploadPart_uploadSessionId_partNumber_key", ("uploadSessionId", "partNumber"))),
        foreign=(Foreign("UploadPart_uploadSessionId_fkey", "uploadSessionId", "UploadSession"),), required=("uploadSessionId", "partNumber", "etag", "size"),
    ),
    "FinancialDocument": Table(
        checks=(Check("FinancialDocument_size_check", "verifiedSize > 0"),), uniques=(Unique("FinancialDocument_pkey", ("id",)), Unique("FinancialDocument_uploadSessionId_key", ("uploadSessionId",)), Unique("FinancialDocument_objectKey_key", ("objectKey",))),
        foreign=(Foreign("FinancialDocument_uploadSessionId_fkey", "uploadSessionId", "UploadSession"),), required=("objectKey", "verifiedSize"), enums={"status": ("UPLOADED", "VERIFYING", "VERIFIED", "DUPLICATE", "CORRUPT", "FAILED", "DELETED")},
    ),
    "Job": Table(
        checks=(Check("Job_attempt_check", "attemptCount >= 0 AND maxAttempts > 0"), Check("Job_priority_check", "priority >= 0")),
        uniques=(Unique("Job_pkey", ("id",)), Unique("Job_active_deduplicationKey_key", ("deduplicationKey",), f"status IN {ACTIVE}")),
        foreign=(Foreign("Job_documentId_fkey", "documentId", "FinancialDocument"),), required=("correlationId", "type"), enums={"status": (*ACTIVE, "SUCCEEDED", "FAILED", "CANCELLED")},
    ),
    "JobAttempt": Table(
        checks=(Check("JobAttempt_number_check", "attemptNumber > 0"), Check("JobAttempt_duration_check", "durationMs IS NULL OR durationMs >= 0")),
        uniques=(Unique("JobAttempt_pkey", ("id",)), Unique("JobAttempt_jobId_attemptNumber_key", ("jobId", "attemptNumber"))), foreign=(Foreign("JobAttempt_jobId_fkey", "jobId", "Job"),), required=("jobId", "attemptNumber"),
        enums={"status": ("CLAIMED", "RUNNING", "SUCCEEDED", "FAILED", "LEASE_EXPIRED", "CANCELLED")},
    ),
    "JobEvent": Table(uniques=(Unique("JobEvent_pkey", ("id",)),), foreign=(Foreign("JobEvent_jobId_fkey", "jobId", "Job"), Foreign("JobEvent_attemptId_fkey", "attemptId", "JobAttempt")), required=("jobId", "eventType")),
    "MetadataAssertion": Table(
        checks=(Check("MetadataAssertion_confidence_check", "confidence IS NULL OR (confidence >= 0 AND confidence <= 1)"), Check("MetadataAssertion_page_check", "sourcePage IS NULL OR sourcePage > 0")),
        uniques=(Unique("MetadataAssertion_pkey", ("id",)),), foreign=(Foreign("MetadataAssertion_documentId_fkey", "documentId", "FinancialDocument"),), required=("documentId", "field"), enums={"status": ("PROPOSED", "CONFIRMED", "REJECTED")},
    ),
}
