import random
import zlib

import numpy as np

from tallyloom.llm import catalog, common, subwords

LABELS = "doc_id long, quality int, toxic int, text string"


def plain_features(text):
    """As ``subwords``, one feature at a time."""
    words, out = text.split(), []
    for w in words:
        out += subwords.of_words([w])[0].tolist()
    return out + [subwords.AGAIN for a, b in zip(words, words[1:]) if a == b]


def test_logits_are_averages_of_features():
    model = subwords.Model(np.random.default_rng(1).normal(size=subwords.BUCKETS))
    texts = ["one two two three", "", " \t\n", "é 𝒳😀 x x x", "a" * 5000 + " b", "two"]
    want = [np.mean(model.value[f]) if (f := plain_features(t)) else 0.0 for t in texts]
    assert np.allclose(model.logits(texts), want)
    assert np.allclose([model.logits([t])[0] for t in texts], want)


def test_features_of_a_word_are_its_grams():
    feature, n = subwords.of_words(["abc", "", "abc"])
    assert n.tolist() == [1 + 3 + 2 + 1, 1, 7] and (feature[:7] == feature[8:]).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = catalog.op13_subwords(spark, folder).join(common.table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 500
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.98 * len(got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in got)


def test_labels_of_the_held_out_fold_are_not_seen(docs, rows, spark):
    marks = [(r[0], i % 2, 0, "clash") for i, r in enumerate(rows)] + [(None, 1, 0, ""), (rows[0][0], None, 0, ""), (10**6, 1, 0, "")]
    turned = [(d, q if d is None or q is None or zlib.crc32(str(d).encode()) % 4 != 2 else 1 - q, t, x) for d, q, t, x in marks]
    a, b = (subwords.train(docs, spark.createDataFrame(m, LABELS)) for m in (marks, turned))
    assert (a.value == b.value).all()
    got = subwords.score(docs, a).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    empty = {r[0] for r in rows if not (r[1] or "").strip()}
    assert all(r["score"] == 0.5 for r in got if r["doc_id"] in empty)


def test_no_labels_or_one_kind(docs, none, rows, spark):
    for marks in ([], [(rows[0][0], 1, 0, "")]):
        model = subwords.train(docs, spark.createDataFrame(marks, LABELS))
        assert model is None
        assert {r["score"] for r in subwords.score(docs, model).collect()} == {0.5}
    assert subwords.score(none, None).collect() == []


def test_a_long_text_is_scored_whole():
    rng = random.Random(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(40)]
    bad = [" ".join(rng.choice(["###", "$$$", "&&&"]) for _ in range(30)) for _ in range(40)]
    model = subwords.trained(good + bad, [1] * 40 + [0] * 40)
    mixed = " ".join(good * 3) + " " + " ".join(bad * 300)
    assert model.logits([good[0]])[0] > 2 and model.logits([mixed])[0] < 0 and model.logits([" ".join(good * 300)])[0] > 2
