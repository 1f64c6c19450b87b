import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import bpe, langid, packing, toxicity

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCé èßΣσİñ'’.,!12½Ⅷ中あ́  \x1c\n\t<|>_-😀🏽ſǅ‍\xad"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_ids_and_decoding_equal_the_library(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["<|startoftext|>x<|endoftext|>", "a" * 5000, "<|startoftext", "don't we'll I'VE '''s", "", "  ", "internationalization " * 50]
    codec = bpe.Codec(bpe.default_tokenizer())
    for ids, want in zip(codec.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    assert 0 < codec.stats["failed"] < codec.stats["words"]


def test_caches_may_run_over(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 40)
    rng = random.Random(2)
    codec = bpe.Codec(bpe.default_tokenizer())
    for _ in range(5):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 300))) for _ in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_verification_accepts_only_exact_words():
    codec = bpe.Codec(bpe.default_tokenizer())
    rng = random.Random(3)
    words = ["".join(rng.choice("theringsouablwhcdf") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]
    tokens, begin = codec.propose(words)
    good = codec.verify(tokens, begin)
    for i, w in enumerate(words):
        exact = codec.merge([*codec.base[np.frombuffer(w[:-1], np.uint8)].tolist(), int(codec.last[w[-1]])])
        assert good[i] == (tokens[begin[i] : begin[i + 1]].tolist() == exact)


def test_digest_of_every_row(docs, rows, library):
    got = sorted(tuple(r) for r in bpe.digest(docs).collect())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_packing_places_every_piece_once(docs, rows, library):
    got = packing.pack_documents(docs, most=64).collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[r[0], k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(g["length"] for g in got) // 64) + 2


def test_best_two_replace_the_smallest():
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy leaves 6+3, best two make 6+2+2
    assert sorted(packing.plan(counts)) == [(1, [3]), (1, [6, 2, 2])]
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 101)
    counts[0] = 0
    found = np.zeros(101, int)
    for times, lengths in packing.plan(counts):
        assert times > 0 and sum(lengths) <= 100
        for x in lengths:
            found[x] += times
    assert (found == counts).all()


def test_empty_tables(none, spark):
    assert bpe.digest(none).count() == 0 and packing.pack_documents(none).count() == 0
    assert langid.classify(none, langid.dictionaries(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.classify(docs, langid.dictionaries(docs)).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "12 !?", "k"), (4, "the and of the " * 3000, "k")], "doc_id long, text string, score string")
    out = {r["doc_id"]: r for r in langid.classify(odd, langid.dictionaries(docs)).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]


def test_toxicity_of_held_out_texts(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    y, p = np.array([r["toxic"] for r in got]), np.array([r["score"] for r in got])
    assert ((p >= 0.5) == y).mean() > 0.97 and ((p >= 0.5) & (y == 1)).sum() > 0.85 * y.sum()
    plain, odd = toxicity.text_features(machine, ["such an idiot it is", "such an i d i o t it is"])[:, 0]
    gapped = toxicity.text_features(machine, ["such an id-iot it is", "such an idi*ot it is"])[:, 0]
    clean = toxicity.text_features(machine, ["such an notion it is"])[0, 0]
    assert min(plain, odd) > 0 > clean and gapped.min() > clean
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (3, "idiot " * 9)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(texts, machine).collect())


def test_one_kind_of_label_scores_nothing(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {0.0}


def test_packing_with_clashing_names_ties_and_nulls(spark):
    rows = [(i % 3 or None, 1 + i % 4, None if i % 2 else i, "r", 5) for i in range(200)] + [(1, 4, 1, "r", 5)] * 3
    got = packing.pack(spark.createDataFrame(rows, "id long, length long, bucket_ long, rank_ string, sequence_id long"), most=4)
    assert got.columns == ["id", "length", "bucket_", "rank_", "sequence_id", "offset"]
    by = {}
    for r in got.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, by.values())) == len(rows)
    for places in by.values():
        end = 0
        for a, n in sorted(places):
            assert a == end
            end = a + n
        assert end <= 4


def test_a_length_with_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", (4, 8, 10))
    got = packing.pack(spark.range(3000).selectExpr("id", "1 + id % 2 AS length"), most=4).collect()
    cells = [(r["sequence_id"], r["offset"] + k) for r in got for k in range(r["length"])]
    assert len(got) == 3000 and len(cells) == len(set(cells)) and max(c[1] for c in cells) < 4


def test_langid_and_bpe_with_clashing_names_and_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "y"), (2, "le chat et le chien", "fr", "y"), (3, None, None, None), (4, "", "xx", "z"), (5, "a" * 300_000, "en", "z"), (6, "i", "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = langid.classify(docs, langid.dictionaries(docs))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"] and got.count() == 7
    assert {r["lang_pred"] for r in got.where("text IS NULL OR text = ''").collect()} == {"und"}
    assert bpe.encode(docs.withColumn("ids", docs["lang"])).count() == 7
