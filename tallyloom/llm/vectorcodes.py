"""Vectors as product codes: integer codebooks by rounds of nearest entries and means, found by segment-mean bounds.

Components become integers, ``floor(4096 * x)``, and a vector is cut into equal parts. Each part's nearest codebook
entry is looked for from coarse to fine: the means of an ever finer cut of the part into blocks, and the norms of
what the means leave over, bound every distance from below. Entries whose bound lies above the exact distance of
the entry of smallest bound can't be the nearest; the others go on to the next cut, and who survives all of them gets
an exact integer distance. Bounds are floats and taken with slack, so they drop nothing that ties.

A round is one pass over the integer vectors, in which a task sums what it assigns to each entry: as many numbers
as the codebooks have, whatever the task's rows. Sums are added up as decimals, so neither order nor size matters.
The integer vectors are written to the shared folder once, so no round depends on a lost executor's work.

Rows whose vector is null, or holds null or non-finite components, are left out. Vectors shorter than the longest,
or than a multiple of the number of parts, are filled up with zeros. Integers are clamped to the largest for which
a distance is sure to fit a long (32,768 * 4,096 for up to 64 components). Entries start from the smallest ids; a
repeated id counts once, by its smallest vector, and a null id comes after all others. Repeated rows are coded each
for itself, ties go to the lower index. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

#: Parts of a vector, entries of a part's codebook, rounds of the means, and the scale of components.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: What bounds may be off by: a share, and an amount.
SLACK = (1e-9, 1.0)


def cuts(width: int) -> list[np.ndarray]:
    """Starts of the blocks that a part is cut into, coarse to fine; blocks of one component aren't needed."""
    out, n = [], 1
    while n < width:
        out.append(np.unique(np.arange(n) * width // n))
        n *= 2
    return out or [np.zeros(1, np.int64)]


def outline(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block means, each weighed by the root of its block's length, and the norm of what they leave over."""
    size = np.diff(np.append(starts, x.shape[-1]))
    mean = np.add.reduceat(x, starts, axis=-1) / size
    rest = x - np.repeat(mean, size, axis=-1)
    return mean * np.sqrt(size), np.sqrt((rest * rest).sum(axis=-1))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the nearest entry of ``book``, the lower of equals, and its squared distance."""
    cut = cuts(x.shape[1])
    rows, entries = [outline(x, s) for s in cut], [outline(book, s) for s in cut]
    (mean, rest), (mean_, rest_) = rows[0], entries[0]
    bound = ((mean[:, None, :] - mean_[None]) ** 2).sum(axis=2) + (rest[:, None] - rest_[None]) ** 2
    at = bound.argmin(axis=1)
    limit = ((x - book[at]) ** 2).sum(axis=1)
    slack = limit * (1 + SLACK[0]) + SLACK[1]
    i, k = np.nonzero(bound <= slack[:, None])
    for (mean, rest), (mean_, rest_) in zip(rows[1:], entries[1:]):
        bound = ((mean[i] - mean_[k]) ** 2).sum(axis=1) + (rest[i] - rest_[k]) ** 2
        keep = bound <= slack[i]
        i, k = i[keep], k[keep]
    exact = ((x[i] - book[k]) ** 2).sum(axis=1)
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    least = np.minimum.reduceat(exact, first)
    hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(first, len(i)))))
    hit = hit[np.unique(i[hit], return_index=True)[1]]
    return k[hit], least


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of vectors, and their squared distances summed over parts."""
    width = books.shape[2]
    got = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(len(books))]
    return np.stack([g[0] for g in got], 1), sum(g[1] for g in got)


def block(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def integers(vectors: DataFrame, ids: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """``vec_id``, ``label`` and the integer vector ``q`` of the rows that are kept, and the vectors' length."""
    x = F.col(vector)
    kept = vectors.where(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    most = min(SCALE << 15, int((2**62 / width) ** 0.5) // 2)
    scaled = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(-float(most))), F.lit(float(most)))).cast("int"))
    zeros = F.array_repeat(F.lit(0), F.lit(width) - F.size(vector))
    return kept.select(F.col(ids).alias("vec_id"), F.col(label).alias("label"), F.concat(scaled, zeros).alias("q")), width


def starting(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Each part's first codebook: the parts of the vectors of smallest id. Ids first, so no vector is shuffled for it."""
    ids = rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).select(F.col("vec_id").alias("first_id"))
    first = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("first_id"))).groupBy("vec_id").agg(F.min("q").alias("q"))
    got = [r["q"] for r in first.orderBy(F.asc_nulls_last("vec_id")).collect()]
    if not got:
        return None
    x = np.array(got, np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts that are nearest to them; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.size, np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = block(b.column("q"), parts * width)
            entry = (assigned(x, books)[0] + np.arange(parts) * entries).ravel()
            # A batch's sums are below 2 ** 53, so floats add them up exactly.
            cell = (entry[:, None] * width + np.arange(width)).ravel()
            total += np.bincount(cell, x.ravel(), books.size).astype(np.int64)
            count += np.bincount(entry, minlength=parts * entries)
        used = np.flatnonzero(np.repeat(count, width))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used]), pa.array(np.repeat(count, width)[used])], ["cell", "total", "n"])

    sums = rows.select("q").mapInArrow(common.lean(run), "cell int, total long, n long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.copy().reshape(-1)
    for r in sums.collect():  # one row for each number of the codebooks
        out[r["cell"]] = int(r["total"]) // r["n"]
    return out.reshape(books.shape)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` and ``error`` of every vector."""
    width = books.shape[0] * books.shape[2]
    types = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code, error = assigned(block(b.column("q"), width), books)
            text = code.astype(np.uint8).tobytes().hex()
            n = 2 * code.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(common.lean(run), f"vec_id {types['vec_id'].dataType.simpleString()}, label {types['label'].dataType.simpleString()}, code string, error long")


def digest_of(books: np.ndarray) -> str:
    """Hash of all entries' components, by part, entry and place within the part."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def fitted(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks, parts by entries by components, of integer vectors; None if there are none."""
    books = starting(rows, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = improved(rows, books)
    return books


def compress(vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part")
    common.small_batches(vectors.sparkSession)
    rows, _ = integers(vectors, ids, vector, label, parts)
    rows = common.materialize(rows, "integers")
    books = fitted(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = common.materialize(coded(rows, books), "codes")
    common.discard(rows)
    by_label = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "label_")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("label_"))).select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
