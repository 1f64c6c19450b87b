"""Quality rules with cross-document line frequencies.

Each line is normalised and hashed. For each host, the documents that hold a line are counted. Lines above the limits
are boilerplate; a document that keeps too few of its words without them is depleted and rejected.

A document is a row: a page that a host holds sixty times makes its lines frequent there. With ``copies="once"`` exact copies of a
text in a host count as one document, so that they don't drive one another out.

Counts are taken over all documents and summed within each task first, so neither a host nor a line meets in one task
before it is summed. Null and empty texts have no words and fail the base rule. A null host is a host of its own. Rows
with equal ids, and equal rows, are judged each for itself. A very long text is measured whole, a slice of texts at a time. Limits hold from
their value on, so nothing ties. An empty table gives an empty result. Of other columns none is read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

#: A line is boilerplate in a host if this many documents there hold it, and this share of the host's.
LINE_DOCUMENTS, LINE_SHARE = 25, 0.005
#: A document is depleted if it keeps fewer words than this, or less than this share of them.
LEAST_WORDS, LEAST_SHARE = 10, 0.3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
OTHER = re.compile(r"[\W_]+")
DIGIT = re.compile(r"[0-9]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words in windows that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = (key ^ ids[i : i + n]) * MIX
        key ^= key >> np.uint64(29)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    change = np.zeros(len(words) + 1, np.int32)
    change[at] += 1
    np.subtract.at(change, at + window, 1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def normal_line(line: str) -> str:
    """Case, digits, signs and spacing don't count."""
    return DIGIT.sub("0", OTHER.sub(" ", line.lower())).strip()


def measure(text: str) -> tuple[tuple[int, ...], list[int], list[int]]:
    """Base figures, and for each line with a word the hash of its normal form and its words."""
    words = text.encode().split()
    lines = text.split("\n")
    seen: set[str] = set()
    again = 0
    hashes, sizes = [], []
    for line in lines:
        n = len(line.encode().split())
        if not n:
            continue
        again += line in seen
        seen.add(line)
        hashes.append(xxhash.xxh64_intdigest(normal_line(line)) - (1 << 63))
        sizes.append(n)
    chars = len(text) - sum(map(text.count, SPACES))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words)), hashes, sizes


def scan(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: base figures, a hash of its text, and its lines."""
    common.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(host).cast("string").alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = b.column("text").to_pylist()
            got = [measure(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("host"), *(pa.array(c, pa.int64()) for c in zip(*(g[0] for g in got))), pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in texts], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.int32()))],
                ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "lines", "sizes"],
            )

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<long>, sizes array<int>").withColumn("row_", F.monotonically_increasing_id())


def frequent_lines(scanned: DataFrame, least: int = LINE_DOCUMENTS, share: float = LINE_SHARE, copies: str = "each") -> DataFrame:
    """``host``, ``line`` and the documents that hold it, where they are above both limits; ``copies``: each, or once."""
    if copies not in ("each", "once"):
        raise ValueError("copies count each or once")
    n = F.count(F.lit(1)) if copies == "each" else F.countDistinct("text_hash")
    lines = scanned.select("host", "text_hash", F.explode(F.array_distinct("lines")).alias("line"))
    by_line = lines.groupBy("host", "line").agg(n.alias("n_docs")).where(F.col("n_docs") >= least)
    by_host = scanned.groupBy("host").agg(n.alias("host_docs"))
    return by_line.join(by_host, by_line["host"].eqNullSafe(by_host["host"])).where(F.col("n_docs") >= share * F.col("host_docs")).select(by_line["host"], "line", "n_docs")


def judge(docs: DataFrame, host: str = "source", copies: str = "each") -> DataFrame:
    """Base figures and verdict of every document, ``words_left`` without frequent lines included. ``copies``: as of ``frequent_lines``."""
    scanned = common.materialize(scan(docs, host), "lines")
    frequent = frequent_lines(scanned, copies=copies).select(F.col("host").alias("host_"), F.col("line").alias("line_"))
    lines = scanned.select("row_", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("row_", "host", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    cut = lines.join(frequent, (F.col("line") == F.col("line_")) & F.col("host").eqNullSafe(F.col("host_")), "left_semi").groupBy("row_").agg(F.sum("size").alias("cut_words"))
    left = F.col("n_words") - F.coalesce("cut_words", F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("n_words"))
    return (
        scanned.drop("lines", "sizes", "text_hash", "host")
        .join(cut, "row_", "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), left.alias("words_left"))
    )
