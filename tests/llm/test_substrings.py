import hashlib

import numpy as np
import pytest

from tallyloom.llm import substrings


def brute(rows, depth):
    """Rows with the same id and text are one document."""
    once = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}, key=lambda x: x[0])
    seen, out = set(), {}
    for key in once:
        raw = key[1].encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for p in range(len(raw) - depth + 1):
            s = raw[p : p + depth]
            if s in seen:
                gone[p] += 1
                gone[p + depth] -= 1
            seen.add(s)
        cut = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.append(0, cut.astype(int))) == 1).sum())
        out[key] = (len(raw), int(cut.sum()), spans, hashlib.sha256(bytes(b for b, c in zip(raw, cut) if not c)).hexdigest())
    return sorted((r[0], *out[(r[0], r[1] or "")]) for r in rows)


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_same_bytes_as_brute_force(docs, rows, crowd):
    got = sorted(tuple(r) for r in substrings.digest(docs, crowd=crowd).collect())
    want = brute(rows, 100)
    assert sum(r[2] > 0 for r in want) > 20
    assert got == want


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_a_repeated_row_with_a_near_copy_keeps_its_text(spark, crowd):
    rng = np.random.default_rng(8)
    a = "".join(rng.choice(list("abcdefgh "), 900))
    rows = [(1, a), (1, a), (2, a[:300] + "x" + a[301:]), (2, a[:300] + "x" + a[301:]), (3, "tail " + a[200:700])]
    got = sorted(tuple(r) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd).collect())
    assert got == brute(rows, 100)


@pytest.mark.parametrize("least", [1, 2, 5])
def test_frequent_grams_change_nothing(docs, rows, monkeypatch, least):
    monkeypatch.setattr(substrings, "FREQUENT", (1000, least))
    assert sorted(tuple(r) for r in substrings.digest(docs).collect()) == brute(rows, 100)


@pytest.mark.parametrize("crowd", [8_000, 5])
def test_contents_of_a_frequent_gram_meet_from_several_tasks(spark, monkeypatch, crowd):
    """One run of signs holds every q-gram of many texts, which differ around it; some are equal, some rows repeated."""
    monkeypatch.setattr(substrings, "FREQUENT", (1000, 2))
    rng = np.random.default_rng(11)
    core = "".join(rng.choice(list("abcdefgh "), 95))
    rows = [(i, f"{i % 37:02d}{core}{i % 11}{core[: i % 60]}") for i in range(150)]
    rows += [rows[3], rows[80], (500, core * 3), (None, None), (501, "")]
    got = [sorted(tuple(r) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), crowd=crowd).where("doc_id IS NOT NULL").collect()) for n in (1, 6)]
    assert got[0] == got[1] == brute([r for r in rows if r[0] is not None], 100)


def test_frequent_grams_are_dealt_by_content_and_told_apart():
    import pyarrow as pa

    hot, cold = substrings.HOT, substrings.FIRST
    rows = [(5, 1, 1, 0, cold), (6, 1, 1, 9, cold), (6, 2, 2, 9, cold), (7, 1, 1, 0, hot), (7, 1, 4, 0, hot), (8, 3, 1, 0, hot), (9, 1, 2, 5, substrings.AGAIN)]
    whole = pa.Table.from_arrays([pa.array(c, pa.int8() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows))], ["gram", "whole", "doc_id", "place", "kind"])
    for size in (1, 2, 7):
        got = [tuple(r.values()) for b in substrings.told_apart(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(got) == [(6, 1, 9, True), (6, 2, 9, True), (7, 1, 0, True), (7, 4, 0, False), (8, 1, 0, True), (9, 2, 5, False)]


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = "".join(rng.choice(list("abcdefgh "), 5000))
    rows = [(2, a), (1, a[1000:1400] + "x" + a[3000:4000]), (3, a + a)]
    monkeypatch.setattr(substrings, "PIECE", 700)
    got = sorted(tuple(r) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == brute(rows, 100)


def test_refinement_finds_the_buckets_of_equal_strings():
    rng = np.random.default_rng(2)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 3000)
    text[1000:1300] = text[200:500]
    stop = np.where(np.arange(3000) < 1500, 1500, 3000)
    here, bucket = substrings.refine(text, stop, 100)
    seen = {}
    for p in range(3000):
        if p + 100 <= stop[p]:
            seen.setdefault(text[p : p + 100].tobytes(), []).append(p)
    want = sorted(v for v in seen.values() if len(v) > 1)
    got = {}
    for p, b in zip(here.tolist(), bucket.tolist()):
        got.setdefault(b, []).append(p)
    assert sorted(got.values()) == want


def test_empty_table_and_removal(spark, none):
    assert substrings.digest(none).count() == 0
    t = "é" * 120
    got = {r["doc_id"]: r["text"] for r in substrings.remove(spark.createDataFrame([(1, t, "x"), (2, t + "tail", "y"), (None, None, None)], "doc_id long, text string, tag string")).collect()}
    assert got[1] == "é" and got[2] == "tail" and got[None] is None


def test_stretches_of_one_string_are_told_apart(spark):
    """Texts of just over the depth that share their q-gram but not the whole string."""
    rng = np.random.default_rng(5)
    core = "".join(rng.choice(list("abcdefgh "), 90))
    rows = [(i, f"{rng.integers(10**9)}-{core}-{rng.integers(10**9)}") for i in range(60)]
    got = sorted(tuple(r) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 100)


def test_given_documents_as_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(tuple(r) for r in substrings.digest(docs).collect()) == brute([tuple(r) for r in docs.collect()], 100)
