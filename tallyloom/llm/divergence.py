"""How far the sources of a language differ in their use of terms, with equal count columns evaluated once.

Terms are counted by language and source. Within a language, each kept term has a column of counts, one for each
source; most terms are rare, so most columns are sparse and many are the same. Terms are grouped by identical sparse
columns; for every distinct column each ordered pair of sources is evaluated once, and what it gives is multiplied by
the number of terms that have the column. Ranks are given to the terms themselves.

All arithmetic is in whole numbers. A source's smoothed share of a term is ``1 + floor(10^9 * (count + 1) / (N + V))``,
with ``N`` its occurrences of kept terms and ``V`` the language's number of them; a pair's divergence is the sum of
``floor((p - q)^2 / q)`` over the kept terms, which fits a long for up to 8 * 10^9 terms.

Tasks count in memory up to ``HELD`` terms at a time before anything is shuffled, and counts are dealt by language,
source and term, so no source and no frequent term meets in one task unsummed. A column has at most as many counts
as its language has sources, and a task that evaluates columns holds one sum for each pair of them: so many rows the
result has too. Sources' totals are handed to those tasks; there are as many as sources.

Null text, language and source are read as empty. A row is a document, also one that is repeated. A text of any length
is one document, counted in one go. Texts without terms still make their source occur. Terms of equal value rank by
their UTF-8 bytes. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import common

#: Documents of its language that hold a kept term, and ranks of terms that are given.
LEAST_DOCUMENTS, RANKS = 3, 200
UNIT = 1_000_000_000
#: Counts that a task holds before it sends them, and numbers of a block of columns.
HELD, BLOCK = 400_000, 1 << 20
#: Letters stay, capital ones as small ones; all other ASCII signs part terms. Bytes of other signs stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def read(docs: DataFrame) -> DataFrame:
    """``lang``, ``source`` and ``text``, nulls as empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language, source and term of a task: occurrences and documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            if times:
                n = len(times)
                terms = pa.array(list(times), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int64))), pa.array([source], pa.string()).take(pa.array(np.zeros(n, np.int64))), terms, pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in times], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in common.slices(batches):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            terms = text.encode().translate(LETTERS).split()
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(times)
            times.update(terms)
            docs.update(set(terms))
            size += len(times) - before
            if size > HELD:
                yield from sent()
                size = 0
    yield from sent()


def columns(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang``, ``term`` and its counts by source, sorted by source, of the terms in enough documents."""
    counts = read(docs).mapInArrow(common.lean(tally), "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts")).where(F.col("docs") >= least).drop("docs")


def groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurring language and source with its occurrences ``n`` of kept terms, the language's ``lang_n``, and ``v``."""
    every = read(docs).select("lang", "source").distinct()
    by_source = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    by_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])).alias("lang_n"))
    zero = F.lit(0).cast("long")
    return every.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("lang_n", zero).alias("lang_n"), F.coalesce("v", zero).alias("v"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Smoothed shares of counts, of which those too large for a long's product are taken as Python's integers."""
    small = count < (1 << 63) // UNIT - 1
    out = 1 + UNIT * (np.where(small, count, 0) + 1) // total
    for i in np.argwhere(~small):
        out[tuple(i)] = 1 + UNIT * (int(count[tuple(i)]) + 1) // int(np.broadcast_to(total, count.shape)[tuple(i)])
    return out


def evaluated(known: dict[str, tuple[list[str], np.ndarray]]):
    """Divergences summed over distinct columns, each times its number of terms, by ordered pair of sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lang: {s: i for i, s in enumerate(sources)} for lang, (sources, _) in known.items()}
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            times = b.column("terms").to_numpy()
            counts = b.column("counts").to_pylist()
            for lang in dict.fromkeys(langs.tolist()):
                at, total = index[lang], known[lang][1]
                rows = np.flatnonzero(langs == lang)
                width = max(1, BLOCK // len(at))
                got = sums.setdefault(lang, np.zeros((len(at), len(at)), np.int64))
                for k in range(0, len(rows), width):
                    part = rows[k : k + width]
                    cells = [(i, at[c["source"]], c["n"]) for i, r in enumerate(part.tolist()) for c in counts[r]]
                    i, j, n = np.array(cells, np.int64).T
                    p = np.zeros((len(part), len(at)), np.int64)
                    p[i, j] = n
                    p = shares(p, total)
                    for s in range(len(at)):
                        d = p[:, s : s + 1] - p
                        got[s] += times[part] @ (d * d // p)
        for lang, got in sums.items():
            names = pa.array(known[lang][0], pa.string())
            for s, name in enumerate(known[lang][0]):  # a source's row at a time
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([name] * n, pa.string()), names, pa.array(got[s])], ["lang", "source", "item", "value"])

    return run


def pairs(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source of the language) and ``value`` of every ordered pair."""
    known: dict[str, tuple[list[str], list[int]]] = {}
    for r in totals.orderBy("lang", "source").collect():  # one row a source; the result has their square
        sources, total = known.setdefault(r["lang"], ([], []))
        sources.append(r["source"])
        total.append(r["n"] + r["v"])
    lookup = {lang: (sources, np.array(total, np.int64)) for lang, (sources, total) in known.items()}
    distinct = terms.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("terms"))
    sums = distinct.mapInArrow(common.lean(evaluated(lookup)), "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    every = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    return every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def share(count: F.Column, total: F.Column) -> F.Column:
    """As ``shares``, a column."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), total.cast("decimal(20,0)")) + 1


def ranked_terms(terms: DataFrame, totals: DataFrame, ranks: int = RANKS) -> DataFrame:
    """The terms that each source uses more than its language does, by their divergence."""
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    rows = terms.select("lang", "term", whole.alias("whole"), F.explode("counts").alias("c")).select("lang", "term", "whole", F.col("c.source").alias("source"), F.col("c.n").alias("times"))
    rows = rows.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("times"), F.col("n") + F.col("v")).alias("p"), share(F.col("whole"), F.col("lang_n") + F.col("v")).alias("q"))
    rows = rows.where(F.col("p") > F.col("q")).select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)


def audit(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank``."""
    common.small_batches(docs.sparkSession)
    terms = common.materialize(columns(docs), "terms")
    totals = common.materialize(groups(docs, terms), "totals")
    sources = pairs(terms, totals).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return sources.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(ranked_terms(terms, totals).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
