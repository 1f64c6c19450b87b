"""Quality by supervised subword embeddings: learned vectors of hashed words and n-grams, averaged, and softmax.

A text's features are its words, the n-grams of their signs between word borders, and pairs of words; a pair of equal
words is one feature whatever the word, as repetition is what such a pair tells. Each feature is hashed to one of a
fixed number of learned vectors. A text is the average of its features' vectors, and a softmax layer over it gives the
classes. Vectors and layer are trained together by stochastic gradient descent in numpy, one text at a step.

Training sees a bounded sample of labelled rows (``SAMPLE``), and of a longer text a stretch from anywhere in it.
Scoring sees whole texts: as the layer is linear in the average, every feature has one number, and a text's logit is
the average of them, so a text of any length costs time in proportion and the memory of its distinct words.

Null and empty texts have no features and score 0.5, as does everything if labels are of one kind or there are none.
Of several labels of one id the highest counts; a null label is none. Rows with equal ids, or equal rows, are scored each
for itself, ties don't occur. An empty table gives an empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

#: Labelled texts of each kind that are trained on, and the signs of one that are seen.
SAMPLE = (1_500, 4_000)
#: Vectors, their length, signs of an n-gram.
BUCKETS, SIZE, GRAMS = 1 << 17, 8, (3, 4, 5)
EPOCHS, RATE = 5, 0.5
STEP = np.uint64(0x9E3779B97F4A7C15)
#: What a pair of equal words is hashed to.
AGAIN = xxhash.xxh64_intdigest(b"the same word again") % BUCKETS


def of_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of words, end to end, and how many each has."""
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))
    who, key = [np.arange(len(words))], [np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = (code ^ text[at + k]) * STEP
            code ^= code >> np.uint64(32)
        who.append(owner[at])
        key.append(code)
    who, key = np.concatenate(who), np.concatenate(key)
    order = np.argsort(who, kind="stable")
    return (key[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(who, minlength=len(words))


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts, the word at each place, and where each text's places begin and end."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    offsets = lists.offsets.to_numpy()
    coded = lists.values.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    if "" in words:  # white space at a text's ends
        keep = index != words.index("")
        kept = np.concatenate(([0], np.cumsum(keep)))
        return words, index[keep], kept[offsets]
    return words, index, offsets


def pairs(index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of each pair of words: here, of equal words."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero((index[1:] == index[:-1]) & (text[1:] == text[:-1])) if len(index) else np.zeros(0, np.int64)
    return text[at], np.full(len(at), AGAIN)


@dataclass
class Model:
    """The number of each feature: how much more it speaks for the second class than for the first."""

    value: np.ndarray

    def logits(self, texts: list[str]) -> np.ndarray:
        """The average of each text's features, 0 where there are none."""
        words, index, offsets = cut(texts)
        if not len(index):
            return np.zeros(len(texts))
        total, count = np.zeros(len(words)), np.zeros(len(words))
        for k in range(0, len(words), 20_000):  # a block's features are what memory holds
            feature, n = of_words(words[k : k + 20_000])
            total[k : k + 20_000] = np.add.reduceat(self.value[feature], np.cumsum(np.append(0, n[:-1])))
            count[k : k + 20_000] = n
        text, feature = pairs(index, offsets)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        top = np.bincount(owner, total[index], len(texts)) + np.bincount(text, self.value[feature], len(texts))
        return top / np.maximum(np.bincount(owner, count[index], len(texts)) + np.bincount(text, minlength=len(texts)), 1)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct features and their shares."""
    words, index, offsets = cut(texts)
    feature, n = of_words(words)
    first = np.cumsum(np.append(0, n))
    text, pair = pairs(index, offsets)
    out = []
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        word, times = np.unique(index[a:b], return_counts=True)
        parts = [feature[first[w] : first[w + 1]] for w in word.tolist()] + [pair[text == t]]
        weight = np.concatenate([np.repeat(times, n[word]), np.ones(len(parts[-1]))])
        ids, at = np.unique(np.concatenate(parts), return_inverse=True)
        share = np.bincount(at, weight, len(ids))
        out.append((ids, share / max(1, share.sum())))
    return out


def trained(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    """Vectors and softmax layer by stochastic gradient descent, folded into one number a feature."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    rows = bags(texts)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    layer = rng.uniform(-1 / SIZE, 1 / SIZE, (2, SIZE))
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            ids, share = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            hidden = share @ vectors[ids]
            out = layer @ hidden
            out = np.exp(out - out.max())
            error = out / out.sum()
            error[labels[i]] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, hidden)
            # However many features a text has, its average moves by the rate times the gradient.
            vectors[ids] -= rate * np.outer(share / (share @ share), back)
    return Model(vectors @ (layer[1] - layer[0]))


def sampled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> tuple[list[str], list[int]]:
    """Texts and labels that are trained on, chosen by a hash of their ids; of a long text a stretch at a place so chosen."""
    most, size = SAMPLE
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (common.crc_fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.max(label).alias("label_"))
    spare = F.greatest(F.length("text") - size, F.lit(0)) + 1
    texts, marks = [], []
    for mark in (0, 1):
        # Ids first, so that the texts are never shuffled: their number is bounded.
        ids = known.where(F.col("label_") == mark).select("doc_id", F.xxhash64("doc_id").alias("order_")).orderBy("order_", "doc_id").limit(most)
        rows = common.with_text(docs).where(F.length("text") > 0).join(F.broadcast(ids), "doc_id")
        got = rows.select("order_", F.expr("substring(text, cast(1 + pmod(order_, greatest(length(text) - {0}, 0) + 1) as int), {0})".format(size)).alias("text")).orderBy("order_", "text").limit(most).collect()
        texts += [r["text"] for r in got]
        marks += [mark] * len(got)
    return texts, marks


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2) -> Model | None:
    """The model for a label of ``docs``, from rows outside the held-out fold."""
    return trained(*sampled(docs, labels, label, folds, held))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, the second class) of every whole text."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            x = np.zeros(b.num_rows) if model is None else model.logits(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], ["doc_id", "score"])

    return common.with_text(docs).mapInArrow(common.lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
