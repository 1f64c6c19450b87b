"""Exact removal of repeated byte strings by suffix sorting with bucket-pointer refinement.

A byte goes if it is covered by a string of ``DEPTH`` bytes that also starts earlier: in a document with a
smaller id, or before in the same one. Whether two such strings are equal is decided by a suffix array
that is only sorted to that depth. Its buckets begin as q-gram buckets and are refined by sorting on the
bucket identifiers of later offsets; every refinement uses the identifiers the one before has updated.

The array is built in parts that fit a task. Each string holds one chosen q-gram, the least by hash of
all q-grams in it, so equal strings choose the same one at the same offset. Q-grams that a bounded sample
shows to be frequent come after all others, so that strings at the edge of a passage that many texts share
are known by what surrounds it; this choice only affects how evenly strings are dealt. Strings are dealt out by this
q-gram, the first bucket. Strings that stand next to each other and choose the same q-gram travel as one
stretch. Of equal stretches the earliest stays and the others go at once. Where stretches with one q-gram
differ, their bytes are fetched and refined to full depth. A q-gram with many different stretches is dealt
to several tasks, whose survivors then meet by the hash of their whole string. Stretches that repeat one of
their own task are settled there, so a text with many copies doesn't send all of them to one place. Those of a
frequent q-gram are dealt by their content, as only equal ones need to meet; whether a q-gram has several
contents is then told by a count.

Null and empty texts, and those shorter than ``DEPTH``, lose nothing; an empty table stays empty. Rows with
the same id and text are one document and get equal results; of different texts with one id, the order is
that of a hash of the text, of 25 bits. A null id comes before all others. Ids are integers, or text that
reads as one, since their order decides. A very long text is read in pieces. Other columns, whatever their
names, are kept by ``remove`` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

DEPTH, GRAM = 100, 32
#: Kinds of stretches: the first of its content in its task, the same of a frequent q-gram, one that repeats another.
FIRST, HOT, AGAIN = 0, 1, 2
#: Different stretches of a q-gram that one task refines; more are dealt to several.
CROWD = 8_000
#: Rows of the sample that shows which q-grams are frequent, and in how many of them a frequent one is.
FREQUENT = (1_000, 20)
#: Bytes sorted at once, more only where one q-gram's stretches need it.
SORTED = 1 << 20
#: Bytes of text looked at at once; positions must fit the low bits of a key.
PIECE, LOW = 1 << 18, np.uint64((1 << 21) - 1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def raw_column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each row begins."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    key = (key ^ more) * MIX[0]
    key ^= key >> np.uint64(31)
    return key


def string_hash(words: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` bytes from each of the positions on."""
    key = np.full(len(at), seed, np.uint64)
    for k in [*range(0, size - 8, 8), size - 8]:
        key = mixed(key, words[at + k])
    return key * MIX[1]


def grams_of(words: np.ndarray, n: int, gram: int) -> np.ndarray:
    """Hash of the q-gram at each of the first ``n`` positions."""
    key = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        key = mixed(key, words[k : k + n])
    return key


class Late:
    """A set of q-grams that come last in the order."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.unique(grams)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.grams & np.uint64(0xFFFF)).astype(np.int64)] = True

    def found(self, key: np.ndarray) -> np.ndarray:
        """Indexes of the q-grams that are in the set."""
        if not len(self.grams):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(key & np.uint64(0xFFFF)).astype(np.uint16)])
        near = np.minimum(np.searchsorted(self.grams, key[at]), len(self.grams) - 1)
        return at[self.grams[near] == key[at]]

    def order(self, key: np.ndarray) -> np.ndarray:
        """A number for each q-gram that sorts as the order asks, in its high bits."""
        out = key >> np.uint64(1)
        out[self.found(key)] |= np.uint64(1 << 63)
        return out


def frequent_grams(docs: DataFrame, gram: int, rows: int, least: int) -> Late:
    """Q-grams that many texts of a sample hold, the sample being chosen by a hash of id and text.

    About ``rows`` texts are looked at, so what is collected is bounded.
    """
    part = max(1, docs.count() // rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, most=PIECE):
            data, at = raw_column(b.column("text"))
            for i, j in zip(at.tolist(), at[1:].tolist()):
                if j - i >= gram:
                    key = np.unique(grams_of(eights(data[i:j]), j - i - gram + 1, gram))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["gram"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(part)) == 0).select("text")
    found = sample.mapInArrow(run, "gram long").groupBy("gram").count().where(F.col("count") >= least).select("gram").collect()
    return Late(np.array([r["gram"] for r in found], np.int64).view(np.uint64))


def stretches(data: np.ndarray, start: np.ndarray, depth: int, gram: int, late: Late) -> tuple[np.ndarray, ...]:
    """All strings of ``data`` in stretches that choose the same q-gram.

    ``start``: where documents begin, and the end. Returns document, first string's start within it, strings
    less one, hash of the q-gram, hash of the stretch.
    """
    words = eights(data)
    n = len(data) - gram + 1
    key = grams_of(words, n, gram)
    least = (late.order(key) & ~LOW) | np.arange(n, dtype=np.uint64)
    width, have = depth - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    chosen = (least & LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))[: len(chosen)]
    ok = np.arange(len(chosen)) + depth <= start[doc + 1]
    first = ok.copy()
    first[1:] &= (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
    last = ok.copy()
    last[:-1] &= first[1:] | ~ok[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    whole = mixed(mixed(string_hash(words, a, depth), string_hash(words, b, depth, 1)), ((b - a) << 8 | (chosen[a] - a)).astype(np.uint64))
    return doc[a], a - start[doc[a]], b - a, key[chosen[a]], whole


def packed(tag: np.ndarray, at: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Text tag, start and length of a stretch in one number that sorts alike."""
    return tag.astype(np.int64) << 38 | at.astype(np.int64) << 7 | span.astype(np.int64)


class Settled:
    """Tells stretches that repeat an earlier one of the same task, so that copies don't all travel to one place.

    Contents that stood twice in a slice of texts are remembered with their first stretch, up to ``most`` of
    them; which ones are, is only a matter of speed.
    """

    def __init__(self, most: int = 1 << 16):
        self.most = most
        self.rows = np.zeros((0, 5), np.int64)

    def __call__(self, gram: np.ndarray, whole: np.ndarray, doc: np.ndarray, none: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which stretches go on as the first of their content, and which repeat one; of equal rows one is either."""
        first, again = np.ones(len(whole), bool), np.zeros(len(whole), bool)
        rows = np.stack([whole.view(np.int64), gram.view(np.int64), ~none, doc, place], 1)  # null ids come first
        order = np.argsort(rows[:, 0], kind="stable")
        tie = np.append(False, rows[order[1:], 0] == rows[order[:-1], 0])
        few = order[tie | np.append(tie[1:], False)]
        few = few[np.lexsort(rows[few].T[::-1])]
        equal = np.append(False, (rows[few[1:], :2] == rows[few[:-1], :2]).all(axis=1))[: len(few)]
        twin = equal & np.append(False, (rows[few[1:], 2:] == rows[few[:-1], 2:]).all(axis=1))[: len(few)]
        first[few[equal]] = False
        again[few[equal & ~twin]] = True
        known, left = self.rows, np.flatnonzero(first)
        if len(known) and len(left):
            at = np.minimum(np.searchsorted(known[:, 0], rows[left, 0]), len(known) - 1)
            hit = (known[at, :2] == rows[left, :2]).all(axis=1)
            left, old = left[hit], known[at[hit]]
            new = rows[left]
            same = (new[:, 2:] == old[:, 2:]).all(axis=1)
            after = (new[:, 2] > old[:, 2]) | (new[:, 2] == old[:, 2]) & ((new[:, 3] > old[:, 3]) | (new[:, 3] == old[:, 3]) & (new[:, 4] > old[:, 4]))
            first[left[same | after]] = False
            again[left[after]] = True
        lead = few[np.append(equal[1:], False) & ~equal & first[few]] if len(few) else few
        if len(lead):
            known = np.concatenate([known, rows[lead]]) if len(known) + len(lead) <= self.most else rows[lead[: self.most]]
            known = known[np.lexsort(known.T[::-1])]
            self.rows = known[np.append(True, known[1:, 0] != known[:-1, 0])]
        return first, again


def scan(depth: int, gram: int, late: Late):
    """Stretches of every text: ``gram``, ``whole``, ``doc_id``, ``place``, ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled = Settled()
        for b in common.slices(batches, most=PIECE):
            data, at = raw_column(b.column("text"))
            tag = b.column("tag").to_numpy()
            doc, lo, span, key, whole = [], [], [], [], []
            size = np.diff(at)
            rows = np.flatnonzero(size >= depth)
            groups = [rows[size[rows] <= PIECE], *rows[size[rows] > PIECE][:, None]]
            for group in groups:
                if not len(group):
                    continue
                if len(group) > 1 or size[group[0]] <= PIECE:
                    text = np.concatenate([data[at[i] : at[i + 1]] for i in group.tolist()])
                    got = stretches(text, np.append(0, np.cumsum(size[group])), depth, gram, late)
                    parts = [(group[got[0]], *got[1:])]
                else:  # a very long text, in pieces that overlap by a string less one byte
                    i, parts = int(group[0]), []
                    for s in range(0, int(size[i]) - depth + 1, PIECE):
                        text = data[at[i] + s : min(at[i] + s + PIECE + depth - 1, at[i + 1])]
                        got = stretches(text, np.array([0, len(text)]), depth, gram, late)
                        parts.append((np.full(len(got[0]), i), got[1] + s, *got[2:]))
                for d, a, n, k, w in parts:
                    doc.append(d)
                    lo.append(a)
                    span.append(n)
                    key.append(k)
                    whole.append(w)
            if not doc:
                continue
            doc, key, whole = np.concatenate(doc), np.concatenate(key), np.concatenate(whole)
            place = packed(tag[doc], np.concatenate(lo), np.concatenate(span))
            ids = b.column("doc_id")
            first, again = settled(key, whole, ids.fill_null(0).to_numpy()[doc], ids.is_null().to_numpy(zero_copy_only=False)[doc], place)
            kind = np.full(len(key), FIRST, np.int8)
            kind[late.found(key)] = HOT
            kind[again] = AGAIN
            out = np.flatnonzero(first | again)
            yield pa.RecordBatch.from_arrays([pa.array(key[out].view(np.int64)), pa.array(whole[out].view(np.int64)), ids.take(pa.array(doc[out])), pa.array(place[out]), pa.array(kind[out])], ["gram", "whole", "doc_id", "place", "kind"])

    return run


def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches sorted by kind, q-gram, content and order: later equal ones (``open`` false), and the first of
    each content where the q-gram is frequent, or has several contents (``open`` true). Those known to repeat one pass as they are."""
    last: pa.RecordBatch | None = None  # the row before
    held: pa.RecordBatch | None = None  # a first stretch, not known yet to be one of several
    several = False

    def out(rows: pa.RecordBatch, open_: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("gram"), rows.column("doc_id"), rows.column("place"), pa.array(np.full(rows.num_rows, open_))], ["gram", "doc_id", "place", "open"])

    for b in batches:
        again = pa.compute.equal(b.column("kind"), AGAIN)
        if again.true_count:
            yield out(b.filter(again), False)
            b = b.filter(pa.compute.invert(again))
        if not b.num_rows:
            continue
        rows = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        gram, whole, place = (rows.column(c).to_numpy() for c in ("gram", "whole", "place"))
        ids = rows.column("doc_id")
        if ids.null_count:
            doc, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        else:
            doc, none = ids.to_numpy(), np.zeros(len(ids), bool)
        equal = (gram[1:] == gram[:-1]) & (whole[1:] == whole[:-1])
        twin = equal & (doc[1:] == doc[:-1]) & (none[1:] == none[:-1]) & (place[1:] == place[:-1])
        equal, twin = np.append(False, equal), np.append(False, twin)
        # A row that repeats the first row is as the first: it isn't removed, whatever comes between.
        new = ~equal
        if last is not None:
            new[0] = twin[0] = equal[0] = False
        later = equal & ~twin
        if twin.any():  # a repeated row shares the fate of the row it repeats
            lead = np.maximum.accumulate(np.where(~twin, np.arange(len(twin)), 0))
            later = later[lead]
        yield out(rows.filter(pa.array(later)), False)
        firsts = rows.filter(pa.array(new))
        if firsts.num_rows:
            chain = firsts if held is None else pa.Table.from_batches([held, firsts]).combine_chunks().to_batches()[0]
            g = chain.column("gram").to_numpy()
            same = g[1:] == g[:-1]
            hot = chain.column("kind").to_numpy() == HOT  # its other contents may be in other tasks
            keep = np.append(False, same) | np.append(same, False) | hot
            keep[0] |= several
            yield out(chain.slice(0, chain.num_rows - 1).filter(pa.array(keep[:-1])), True)
            held, several = chain.slice(chain.num_rows - 1), bool(keep[-1]) if len(same) else several or bool(hot[-1])
        last = rows.slice(rows.num_rows - 1)
    if held is not None and several:
        yield out(held, True)


def refine(text: np.ndarray, stop: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of all positions of ``text`` to ``depth``.

    ``stop``: for each position, where its stretch ends. Returns the positions whose string of ``depth``
    bytes is in a bucket with others, and their buckets.
    """
    n, none = len(text), -1
    pointer = np.full(n, none, np.int64)
    at = np.arange(n)
    here = at[at + 8 <= stop]
    pointer[here] = np.unique(eights(text)[here], return_inverse=True)[1]
    have = 8
    while have < depth:
        step = min(have, depth - have)
        here = at[(at + have + step <= stop) & (pointer >= 0)]
        here = here[pointer[here + step] >= 0]
        _, ids, counts = np.unique(pointer[here] * (n + 1) + pointer[here + step], return_inverse=True, return_counts=True)
        pointer = np.full(n, none, np.int64)
        if have + step < depth:
            pointer[here] = ids  # buckets of one stay as later offsets of others
        else:
            crowd = counts[ids] > 1
            here, ids = here[crowd], ids[crowd]
            pointer[here] = ids
        have += step
    here = np.flatnonzero(pointer >= 0)
    return here, pointer[here]


def runs_of(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First indexes and lengths less one of consecutive positions in one document, at most 100 each."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    out_first, out_len = [], []
    for f, n in zip(first.tolist(), length.tolist()):
        for k in range(0, n, 100):
            out_first.append(f + k)
            out_len.append(min(100, n - k) - 1)
    return np.array(out_first, np.int64), np.array(out_len, np.int64)


def sort_stretches(depth: int):
    """Of stretches with their bytes, sorted by q-gram, the strings that another one precedes (``lead`` null).

    Of q-grams that were dealt to several tasks, the strings that stay, too, with a hash in ``lead`` and ``check``.
    """

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))  # in order of the documents
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = np.array([len(r[3]) for r in rows])
        end = np.cumsum(size)
        owner = np.repeat(np.arange(len(rows)), size)
        start = end - size
        # Buckets are kept apart by q-gram only through their content, which holds it.
        here, bucket = refine(text, end[owner], depth)
        order = np.lexsort((here, bucket))
        again = np.append(False, bucket[order][1:] == bucket[order][:-1])[: len(order)]
        dup = np.sort(here[order[again]])
        if len(dup):
            who = owner[dup]
            place = np.array([r[2] for r in rows], np.int64)
            tag, lo = place >> 38, (place >> 7) & ((1 << 31) - 1)
            at = lo[who] + dup - start[who]
            first, span = runs_of(who, at)
            who = who[first]
            yield made([rows[i][1] for i in who.tolist()], packed(tag[who], at[first], span), None, None)
        if any(r[4] for r in rows):
            salted = np.array([bool(r[4]) for r in rows])
            every = np.flatnonzero((np.arange(len(text)) + depth <= end[owner]) & salted[owner])
            every = np.setdiff1d(every, dup, assume_unique=True)
            words, who = eights(text), owner[every]
            place = np.array([r[2] for r in rows], np.int64)
            at = ((place >> 7) & ((1 << 31) - 1))[who] + every - start[who]
            yield made([rows[i][1] for i in who.tolist()], packed((place >> 38)[who], at, np.zeros(len(at), np.int64)), string_hash(words, every, depth).view(np.int64), string_hash(words, every, depth, 1).view(np.int64))

    def made(ids: list, place: np.ndarray, lead: np.ndarray | None, check: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(place), none if lead is None else pa.array(lead), none if check is None else pa.array(check)], ["doc_id", "place", "lead", "check"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("gram", "doc_id", "place", "bytes", "salt"))):
                if rows and r == rows[-1]:  # of a repeated row
                    continue
                if size >= SORTED and (rows[-1][0], rows[-1][4]) != (r[0], r[4]):
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield from solve(rows)

    return run


def cut_out(depth: int):
    """The bytes of each stretch that a document is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            data, at = raw_column(b.column("text"))
            wanted = b.column("wanted")
            flat = wanted.flatten()
            row = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(wanted).to_numpy())
            place = flat.field("place").to_numpy()
            first = at[row] + ((place >> 7) & ((1 << 31) - 1))
            stop = first + depth + (place & 127)
            view = memoryview(data)
            cut = [bytes(view[i:j]) for i, j in zip(first.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([flat.field("gram"), b.column("doc_id").take(pa.array(row)), flat.field("place"), pa.array(cut, pa.binary()), flat.field("salt")], ["gram", "doc_id", "place", "bytes", "salt"])

    return run


def repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``tag``, ``places``: runs of strings that also start earlier. ``docs``: doc_id, text and tag."""
    late = frequent_grams(docs, gram, *FREQUENT)
    rows = docs.where(F.octet_length("text") >= depth).mapInArrow(common.lean(scan(depth, gram, late)), "gram long, whole long, doc_id long, place long, kind byte")
    rows = rows.repartition(F.when(F.col("kind") == AGAIN, F.xxhash64("doc_id", "place")).when(F.col("kind") == HOT, F.xxhash64("gram", "whole")).otherwise(F.col("gram")))
    rows = rows.sortWithinPartitions("kind", "gram", "whole", F.col("doc_id").asc_nulls_first(), "place")
    found = common.materialize(rows.mapInArrow(told_apart, "gram long, doc_id long, place long, open boolean"), "stretches")

    common.tidy(docs.sparkSession)
    open_ = found.where("open").select("gram", "doc_id", "place")
    contents = open_.groupBy("gram").count().where((F.col("count") == 1) | (F.col("count") > crowd)).select("gram", F.ceil(F.col("count") / crowd).cast("int").alias("parts"), (F.col("count") == 1).alias("only"))
    open_ = open_.join(contents, "gram", "left").where(~F.coalesce("only", F.lit(False))).drop("only")  # only one content of a frequent q-gram
    open_ = open_.withColumn("salt", F.when(F.col("parts").isNotNull(), 1 + F.pmod(F.xxhash64("doc_id", "place"), F.col("parts")).cast("int")).otherwise(0)).drop("parts")
    asked = open_.groupBy("doc_id", F.shiftright("place", 38).alias("tag")).agg(F.collect_list(F.struct("gram", "place", "salt")).alias("wanted"))
    asked = asked.withColumnsRenamed({"doc_id": "id_", "tag": "tag_"})
    cut = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_"))).select("doc_id", "text", "wanted")
    cut = cut.mapInArrow(cut_out(depth), "gram long, doc_id long, place long, bytes binary, salt int")
    cut = cut.repartition("gram", "salt").sortWithinPartitions("gram", "salt", F.col("doc_id").asc_nulls_first(), "place")
    sorted_ = common.materialize(cut.mapInArrow(common.lean(sort_stretches(depth)), "doc_id long, place long, lead long, check long"), "strings")

    late = sorted_.where(F.col("lead").isNotNull())
    low = late.groupBy("lead", "check").agg(F.min(F.struct("doc_id", "place")).alias("low"))
    late = late.join(low, ["lead", "check"]).where(~(F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("place") == F.col("low.place"))))
    every = found.where("not open").select("doc_id", "place").unionByName(sorted_.where(F.col("lead").isNull()).select("doc_id", "place")).unionByName(late.select("doc_id", "place"))
    places = common.materialize(every.groupBy("doc_id", F.shiftright("place", 38).alias("tag")).agg(F.collect_set("place").alias("places")), "places")
    common.discard(found, sorted_)
    return places


def prepared(docs: DataFrame) -> DataFrame:
    return common.with_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("text"), F.lit(1 << 25)).alias("tag"))


def spans_of(places: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Maximal runs of bytes, as starts and ends, that the strings cover."""
    lo, n = (places >> 7) & ((1 << 31) - 1), places & 127
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], (lo + n + depth)[order]
    hi = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > hi[:-1]) if len(lo) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return np.stack([lo[first], hi[np.append(first[1:], len(lo)) - 1]], 1) if len(lo) else np.zeros((0, 2), np.int64)


def with_places(docs: DataFrame, depth: int, gram: int, crowd: int) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and one more, with its name: the strings to remove (null: none)."""
    common.small_batches(docs.sparkSession)
    id_, tag_, places_ = common.fresh(docs, "id_", "tag_", "places_")
    by_doc = repeats(prepared(docs), depth, gram, crowd).toDF(id_, tag_, places_)
    tag = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1 << 25))
    return docs.join(by_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (tag == F.col(tag_)), "left").drop(id_, tag_), places_


def kept_bytes(raw: bytes, places: np.ndarray, depth: int) -> tuple[bytes, np.ndarray]:
    spans = spans_of(places, len(raw), depth)
    ends = [0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(*ends)]), spans


def digest(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """What is removed from every text, and a hash of what stays."""
    rows, _ = with_places(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), depth, gram, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            out = []
            for text, places in zip(b.column("text").to_pylist(), b.column("places_")):
                raw = text.encode()
                kept, spans = kept_bytes(raw, places.values.to_numpy() if places.is_valid else np.zeros(0, np.int64), depth)
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text``; bytes of a sign that is cut in two go as well."""
    rows, places_ = with_places(docs, depth, gram, crowd)

    @F.udf("string", useArrow=True)
    def kept(text, places):
        if text is None or places is None:
            return text
        return kept_bytes(text.encode(), np.array(places, np.int64), depth)[0].decode(errors="ignore")

    return rows.withColumn("text", kept("text", places_)).drop(places_)
