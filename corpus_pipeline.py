"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

All stages but the last return the columns of ``documents``; the last returns the packing plan. A stage's table is deleted once the
next one is written; that of the last but one stays in the shared folder, as the result is read from it.

A null text has no language and goes in the first stage, as an empty one does. Texts of any length go through every stage whole. Rows alike in
id and text are one document from the second stage on; of a group of near copies the smallest id stays, and of rows of that id and other
texts each stays that is first of its own group. Columns beyond those of ``documents`` are dropped by the first stage. An empty
table gives an empty plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import common, jaccard, langid, packing, pii, substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shaped(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    got = langid.classify(docs.select(*COLUMNS), langid.dictionaries(docs))
    return got.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose shingle sets are alike."""
    return jaccard.firsts_of_groups(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that also start earlier."""
    return shaped(substrings.remove(docs.select(*COLUMNS)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return shaped(pii.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Most stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
