"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Instances are words with their borders marked; runs of single letters count as one word, and long runs of
signs are seen through windows. Two instances are alike by the subsequences of three and four signs that
they share, each with up to two gaps, and weighed down by its gaps. So an insult is still itself with signs
put in between or left out.

The kernel to a set of landmark instances gives Nyström features, on which the machine is trained. Labels
hold for texts, not words, so the words that bear a toxic text's label are found in rounds (multiple
instances): those that the machine so far ranks highest. Sentences of clean texts give the others. A text's
score is a logistic function of its three highest words and its length.

As the kernel is an inner product of subsequence counts, landmarks and weights fold into one weight for
each of their subsequences; a word is scored in one pass, whatever the number of landmarks.

The machine is fitted on a bounded sample (``SAMPLE``) of labelled rows. Null and empty texts have no words
and get the score of a text whose words are all as clean as can be. If labels are of one kind, or there are
none, all scores are 0. Very long texts are scored whole, in blocks of words. Rows with equal ids, or equal
rows, are scored each for itself, and words of equal score tie without effect. An empty table gives an empty
result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common
from tallyloom.llm.bpe import Lookup

#: Labelled texts that the machine is fitted on: toxic, clean, and the signs that such a text has at most.
SAMPLE = (1_200, 2_000, 8_000)
#: Landmarks from words that look toxic, and from others; instances of clean words in training.
LANDMARKS, CLEAN = (80, 112), 6_000
DECAY, ROUNDS, SLACK = 0.6, 3, 30.0
#: Altered copies of bearing words that training sees: least share of toxic texts that hold the word, copies of each.
ALTERED = (0.1, 12)
#: Words scored at once.
BLOCK = 8_000
#: Longest word seen at once, and words whose score a Python worker keeps.
WINDOW, CACHED = 24, 400_000
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¡¿"
#: Offsets of a subsequence's signs after the first.
SHAPES = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4), (1, 2, 5), (1, 3, 5), (1, 4, 5), (2, 3, 5), (2, 4, 5), (3, 4, 5)]
STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(word: str) -> list[str]:
    """A word between its borders, long ones as overlapping parts."""
    word = f"^{word}$"
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, hash and weight of each occurrence of a subsequence."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))
    who, key, weight = [], [], []
    for shape in SHAPES:
        at = np.flatnonzero(left > shape[-1])
        code = text[at] + np.uint64(len(shape))
        for k in shape:
            code = code * STEP + text[at + k]
            code ^= code >> np.uint64(29)
        # The last sign is mixed in as the others are; a key drops the lowest bit.
        code *= STEP
        code ^= code >> np.uint64(32)
        who.append(owner[at])
        key.append((code >> np.uint64(1)).view(np.int64))
        weight.append(np.full(len(at), DECAY ** (shape[-1] - len(shape)), np.float32))
    return np.concatenate(who), np.concatenate(key), np.concatenate(weight)


@dataclass
class Machine:
    """Weights of subsequences and of the text model."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    text: list[float] = field(default_factory=list)
    _table: Lookup | None = None
    _known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None, "_known": {}}

    def score(self, words: list[str]) -> np.ndarray:
        """The machine's value of each instance."""
        if self._table is None:
            self._table = Lookup(self.keys, np.arange(len(self.keys), dtype=np.int32))
        out = np.zeros(len(words))
        for k in range(0, len(words), BLOCK):  # a block's occurrences are what memory holds
            part = words[k : k + BLOCK]
            who, key, weight = subsequences(part)
            at = self._table.get(key)
            hit = np.flatnonzero(at >= 0)
            norm = np.sqrt(np.bincount(who, weight * weight, minlength=len(part)))
            out[k : k + BLOCK] = np.bincount(who[hit], self.weights[at[hit]] * weight[hit], minlength=len(part)) / np.maximum(norm, 1e-9)
        return out + self.bias

    def words(self, words: list[str]) -> list[float]:
        """Scores of words, the highest of its windows for each."""
        got = list(map(self._known.get, words))
        if None in got:
            new = [w for w, x in zip(words, got) if x is None]
            if len(self._known) + len(new) > CACHED:
                self._known.clear()
            parts = [windows(w) for w in new]
            for k in range(0, len(new), 20_000):
                some = parts[k : k + 20_000]
                value = self.score([x for p in some for x in p])
                first = np.cumsum([0, *map(len, some)])[:-1]
                self._known.update(zip(new[k : k + 20_000], np.maximum.reduceat(value, first).tolist()))
            fresh = self._known
            got = [fresh[w] if x is None else x for w, x in zip(words, got)]
        return got


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts, the word at each place, and where each text's places begin and end.

    Runs of three or more single letters come as further words, after all others of their text.
    """
    lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    coded = lists.values.dictionary_encode()
    words = [c.strip(EDGE) for c in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy()
    single = np.array([len(w) == 1 and w.isalpha() for w in words] or [False])
    if not single.any():
        return words, index, offsets
    mark = single[index]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    new = np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])) if len(mark) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(mark)))
    runs = [(int(text[f]), "".join(words[i] for i in index[f : f + n].tolist())) for f, n in zip(first.tolist(), length.tolist()) if n >= 3 and mark[f]]
    if not runs:
        return words, index, offsets
    at = np.searchsorted(text, [t for t, _ in runs], "right")
    index = np.insert(index, at, np.arange(len(words), len(words) + len(runs)))
    return words + [w for _, w in runs], index, offsets + np.concatenate(([0], np.cumsum(np.bincount([t for t, _ in runs], minlength=len(texts)))))


def text_features(machine: Machine, texts: list[str]) -> np.ndarray:
    """The three highest words of each text, and the logarithm of its number of words."""
    words, index, offsets = cut(texts)
    floor = -1.5
    value = np.maximum(np.array(machine.words(words), float), floor)[index] if words else np.zeros(0)
    out = np.full((len(texts), 5), floor)
    out[:, 3] = np.log1p(np.diff(offsets))
    out[:, 4] = 1.0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if n := min(3, b - a):
            top = np.partition(value[a:b], b - a - n)[b - a - n :]
            out[i, :n] = np.sort(top)[::-1]
    return np.minimum(out, [3, 3, 3, 20, 1])


def sampled(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> tuple[list[str], list[int]]:
    """Texts and labels that the machine is fitted on, chosen by a hash of their ids."""
    toxic, clean, size = SAMPLE
    known = labels.where(F.col("toxic").isNotNull() & (common.crc_fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where((F.length("text") <= size) & (F.length("text") > 0))
    texts, marks = [], []
    for mark, n in ((1, toxic), (0, clean)):
        # The ids to look for are at most 2 * n, so the other side is never shuffled.
        ids = known.where(F.col("toxic") == mark).select("doc_id", F.xxhash64("doc_id").alias("order_")).orderBy("order_", "doc_id").limit(2 * n)
        got = rows.join(F.broadcast(ids), "doc_id").orderBy("order_", "text").limit(n).select("text").collect()
        texts += [r["text"] for r in got]
        marks += [mark] * len(got)
    return texts, marks


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, the last one being the bias, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float(ridge @ (w * w) / 2 + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    for _ in range(rounds):
        on = np.flatnonzero(y * (x @ w) < 1)
        xs = x[on] * c[on, None]
        grad = ridge * w - 2 * xs.T @ (y[on] * (1 - y[on] * (x[on] @ w)))
        step = np.linalg.solve(np.diag(ridge) + 2 * xs.T @ x[on], grad)
        size, before = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > before:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-5:
            break
    return w


def kernel(words: list[str], keys: np.ndarray, table: Lookup, marks: np.ndarray) -> np.ndarray:
    """Kernel of words with landmarks whose subsequence weights are the columns of ``marks``."""
    out = np.zeros((len(words), marks.shape[1]), np.float32)
    for k in range(0, len(words), 1000):
        part = words[k : k + 1000]
        who, key, weight = subsequences(part)
        norm = np.sqrt(np.bincount(who, weight * weight, minlength=len(part)))
        at = table.get(key)
        hit = np.flatnonzero(at >= 0)
        order = hit[np.argsort(who[hit], kind="stable")]
        if len(order):
            who_ = who[order]
            first = np.flatnonzero(np.append(True, who_[1:] != who_[:-1]))
            got = np.add.reduceat(weight[order, None] * marks[at[order]], first, axis=0)
            out[k + who_[first]] = got / np.maximum(norm[who_[first]], 1e-9)[:, None]
    return out


def fitted(texts: list[str], labels: list[int]) -> Machine | None:
    """The machine for labelled texts."""
    if len(set(labels)) < 2:
        return None
    words, index, offsets = cut(texts)
    label = np.array(labels)
    cuts = [windows(w) for w in words]
    first = np.cumsum([0, *map(len, cuts)])
    parts = [x for p in cuts for x in p]
    places = [np.unique(index[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    if len(parts) > len(words):  # a long word stands for all of its windows
        places = [np.concatenate([np.arange(first[i], first[i + 1]) for i in p.tolist()]) if len(p) else p for p in places]
    df = np.zeros((2, len(parts)))
    for t, p in zip(label, places):
        df[t, p] += 1
    # Which pieces of words tell toxic texts from clean ones, to begin with.
    grams: tuple[Counter, Counter] = Counter(), Counter()
    pieces = lambda w: {w[i : i + 4] for i in range(len(w) - 3)}
    for i in np.flatnonzero(df[1]).tolist():
        for g in pieces(parts[i]):
            grams[1][g] += df[1, i]
    for i in np.flatnonzero(df[0]).tolist():
        for g in pieces(parts[i]):
            if g in grams[1]:
                grams[0][g] += df[0, i]
    total = np.bincount(label, minlength=2)
    odds = {g: math.log((n + 0.5) / total[1]) - math.log((grams[0][g] + 0.5) / total[0]) for g, n in grams[1].items() if n >= 3}
    value = np.array([max((odds.get(g, -5.0) for g in pieces(w)), default=-5.0) for w in parts])
    value[df[1] == 0] = -5.0
    rng = np.random.default_rng(7)
    clean = np.flatnonzero(df[0] > 0)
    if len(clean) > CLEAN:
        clean = rng.choice(clean, CLEAN, replace=False, p=np.sqrt(df[0, clean]) / np.sqrt(df[0, clean]).sum())
    every_clean = np.flatnonzero((df[0] > 0))
    bearers = chosen(value, places, label, 2.0)
    if not len(bearers):
        return None
    best = bearers[np.argsort(-df[1, bearers], kind="stable")]
    half = LANDMARKS[0] // 2
    landmark = np.concatenate([best[:half], rng.permutation(best[half:])[: LANDMARKS[0] - half], rng.permutation(clean)[: LANDMARKS[1]]])
    marks = [parts[i] for i in dict.fromkeys(landmark.tolist())]
    who, key, weight = subsequences(marks)
    keys, at = np.unique(key, return_inverse=True)
    phi = np.zeros((len(keys), len(marks)), np.float32)
    np.add.at(phi, (at, who), weight)
    phi /= np.sqrt(np.bincount(who, weight * weight, minlength=len(marks)))
    table = Lookup(keys, np.arange(len(keys), dtype=np.int32))
    values, vectors = np.linalg.eigh(phi.T.astype(float) @ phi)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    machine = Machine(keys, np.zeros(len(keys)))
    hard = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        negative = np.union1d(clean, hard)
        often = bearers[df[1, bearers] >= ALTERED[0] * total[1]]
        more = [altered(parts[i], rng) for i in often.tolist() if len(parts[i]) > 5 for _ in range(ALTERED[1])]
        rows = [parts[i] for i in bearers] + more + [parts[i] for i in negative]
        y = np.repeat([1.0, -1.0], [len(bearers) + len(more), len(negative)])
        x = kernel(rows, keys, table, phi) @ root
        seen = df[1, bearers].clip(1)
        c = np.concatenate([SLACK / len(bearers) * seen / seen.mean(), np.full(len(more), 0.2 * SLACK / max(1, len(more))), np.full(len(negative), 3 * SLACK / len(negative))])
        w = svm(x, y, c * len(rows) / 20)
        machine = Machine(keys, phi.astype(float) @ (root @ w[:-1]), float(w[-1]))
        value = machine.score(parts)
        hard = every_clean[np.argsort(-value[every_clean], kind="stable")[:2000]]
        bearers = chosen(np.where(df[0] > 0.02 * df[1], -5.0, value), places, label, 0.0)
        if not len(bearers):
            return None
    x = np.concatenate([text_features(machine, texts[k : k + 500]) for k in range(0, len(texts), 500)])
    machine.text = logistic(x, label).tolist()
    return machine


def altered(word: str, rng: np.random.Generator) -> str:
    """A word with a sign put in somewhere inside."""
    at = int(rng.integers(2, len(word) - 1))
    return word[:at] + "-*._!1034"[int(rng.integers(9))] + word[at:]


def chosen(value: np.ndarray, places: list[np.ndarray], label: np.ndarray, least: float) -> np.ndarray:
    """Words that bear toxic texts' labels: the best of each, and all others of at least ``least``."""
    out = set(np.flatnonzero(value >= least).tolist())
    for t, p in zip(label, places):
        if t and len(p) and value[i := p[np.argmax(value[p])]] > -1:
            out.add(int(i))
    return np.array(sorted(out), np.int64)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, both kinds of text counting alike."""
    c = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (c * (y - p)) - 0.5 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Machine | None:
    """The machine for ``labels`` of ``docs``, from rows outside the held-out fold."""
    return fitted(*sampled(docs, labels, folds, held))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text."""
    common.small_batches(docs.sparkSession)
    held: list[Machine | None] = [machine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held[0]
        for b in common.slices(batches):
            if m is None:
                value = np.zeros(b.num_rows)
            else:
                x = text_features(m, b.column("text").to_pylist())
                value = 1 / (1 + np.exp(-np.clip(x @ np.array(m.text), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    return common.with_text(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
