"""Packing of pieces into sequences by best-two-fit.

A sequence is filled greedily, each time with the longest piece that fits. When none fits any more,
its smallest piece is replaced by the two unpacked pieces that fill the widened gap most tightly,
if they fill it better.

Only lengths matter for that, so the plan is made once on the driver from the histogram of lengths,
which has ``most`` entries however many pieces there are; a filling found once is used as often as
the counts allow. Pieces then find their places by their rank among those of the same length. Ranks
are taken within hash buckets, with each bucket's offset added, so that no length is ranked in one task.

Null and empty texts have one piece, of the end id alone. An empty table gives an empty plan. Rows
with equal ids, or equal in all columns, are packed each for itself; pieces of one length tie, and take places
by their other columns, nulls first. A very long text is cut into pieces before. ``pack`` keeps other columns,
whatever their names, but for ``sequence_id`` and ``offset``, which it sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import bpe, common

#: Hash buckets in which pieces of one length are ranked: at least, at most, and pieces of one length in each to aim at.
BUCKETS = (32, 8192, 500_000)


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Fillings for ``counts[length]`` pieces: how often each is used, and its lengths in order."""
    most = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, list[int]]] = []
    if left[most]:
        out.append((int(left[most]), [most]))
        left[most] = 0
    while True:
        held = np.flatnonzero(left)
        if not len(held):
            return out
        bin_, gap, used = [], most, {}
        while gap and (k := int(np.searchsorted(held, gap, "right"))):
            while k and left[held[k - 1]] == used.get(x := int(held[k - 1]), 0):
                k -= 1
            if not k:
                break
            n = min(gap // x, int(left[x]) - used.get(x, 0))
            bin_ += [x] * n
            used[x] = used.get(x, 0) + n
            gap -= x * n
        if gap and len(bin_) > 1:
            small = bin_[-1]
            free = left.copy()
            for x, n in used.items():
                free[x] -= n
            if pair := best_two(free, gap + small, small):
                used[small] -= 1
                bin_[-1:] = pair
                for x in pair:
                    used[x] = used.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in used.items() if n)
        for x, n in used.items():
            left[x] -= n * times
        out.append((times, bin_))


def best_two(free: np.ndarray, room: int, beat: int) -> list[int] | None:
    """Two lengths that fill ``room`` best and more than ``beat``, larger first."""
    held = np.flatnonzero(free[: room])
    if not len(held):
        return None
    rest = room - held
    at = np.searchsorted(held, rest, "right") - 1
    ok = at >= 0
    twice = ok & (held[at] == held) & (free[held] < 2)  # one piece can't be used twice
    at = np.where(twice, at - 1, at)
    ok &= at >= 0
    if not ok.any():
        return None
    total = np.where(ok, held + held[at], -1)
    i = int(total.argmax())
    return sorted((int(held[i]), int(held[at[i]])), reverse=True) if total[i] > beat else None


def layout(fillings: list[tuple[int, list[int]]], most: int) -> dict[str, np.ndarray]:
    """The plan by length: for ranks from ``rank`` on, the first sequence, the offset there and the step.

    Pieces of one length that stand several times in a filling take ranks in runs, so each run of
    ``times`` ranks has consecutive sequences.
    """
    rows, seen, first = [], np.zeros(most + 1, np.int64), 0
    for times, lengths in fillings:
        offset = 0
        for x in lengths:
            rows.append((x, int(seen[x]), first, offset))
            seen[x] += times
            offset += x
        first += times
    cols = np.array(rows, np.int64).reshape(-1, 4)
    order = np.lexsort((cols[:, 1], cols[:, 0]))
    return dict(zip(("length", "rank", "sequence", "offset"), cols[order].T))


def pack(pieces: DataFrame, most: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``most``.

    ``pieces`` should be a written table: it is read three times.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    bucket_, rank_ = common.fresh(pieces, "bucket_", "rank_")
    total = np.zeros(most + 1, np.int64)
    for x in pieces.groupBy("length").count().collect():  # at most `most` rows
        total[x["length"]] = x["count"]
    # Each length has buckets by its own number of pieces, so most lengths have few.
    buckets = np.clip(-(-total // BUCKETS[2]), np.where(total > 1000, BUCKETS[0], 1), BUCKETS[1])
    each = F.element_at(F.lit(buckets.tolist()), F.col("length").cast("int") + 1)
    rows = pieces.withColumn(bucket_, F.pmod(F.xxhash64(*columns), each).cast("int"))
    first = np.cumsum(buckets) - buckets
    counts = np.zeros(int(buckets.sum()), np.int64)
    for x in rows.groupBy("length", bucket_).count().toLocalIterator():  # as many rows as there are buckets at most
        counts[first[x["length"]] + x[bucket_]] = x["count"]
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[first], buckets)
    places = layout(plan(total), most)
    key = places["length"] << 44 | places["rank"]

    ranked = rows.withColumn(rank_, F.row_number().over(Window.partitionBy("length", bucket_).orderBy(*columns)))
    spec = before, first, places, key

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, places, key = spec
        for b in batches:
            length, bucket, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", bucket_, rank_))
            rank = before[first[length] + bucket] + rank - 1
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(places["sequence"][at] + rank - places["rank"][at]), pa.array(places["offset"][at])], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, most: int = 4096, end: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Encode, cut and pack every text: one row per piece, as ``bpe.pieces`` gives them, with its place."""
    return pack(common.materialize(bpe.pieces(docs, most, end, tokenizer), "pieces"), most)
