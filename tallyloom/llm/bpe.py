"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match, for all new words of a batch at once.
A guess equals the BPE result exactly if each of its tokens encodes to itself and every pair of
neighbours is compatible, that is, no merge that BPE would do earlier crosses their border. These
checks are vectorised over all pairs; only words that fail one are merged exactly.

The vocabulary is a tokenizer file whose model is BPE with an end-of-word suffix, normalised by NFC,
white space and lower case, and split into letters, single digits and other signs. Since no token
crosses white space, results are cached by white-space-separated chunk.

Null and empty texts encode to no tokens. A text's special tokens are recognised as the file says,
before it is normalised. Of pairs that could merge at one rank the leftmost does, as the file's library has it. Rows with equal
ids, or equal rows, are encoded each for itself, very long texts whole. An empty table gives an empty result. Other columns aren't
read, whatever their names. All caches start anew when they grow large.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tallyloom.llm import common

TOKENIZER = "word_bpe_49k.json"
#: Chunks kept per Python worker; beyond it the cache starts anew, which costs time but changes nothing.
CACHE_CHUNKS = 1_000_000
#: Pairs of tokens whose compatibility a Python worker keeps.
PAIRS = 1_000_000
#: Unicode's White_Space.
SPACE = "\t-\r \x85\xa0  -     　"

END = 256


def default_tokenizer() -> str:
    """Path of the public word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the rest follows from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Lookup:
    """Vectorised map from 64-bit keys to int32 values, -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):  # each round, every free slot takes one of the keys that ask for it
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]
            won = free & (self.keys[at] == keys[todo])
            self.values[at[won]] = values[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, todo, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self.slot(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (there != -1)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    """Encodes and decodes as the tokenizer file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.token = {i: t for t, i in {**self.vocab, **self.special}.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.parts = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        #: Merges by pair: rank and result.
        self.merges = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(self.parts)}
        size = max(self.token) + 1
        #: For each token its rank, and the two tokens it is merged from (itself if it is a base one).
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        abc = np.array(self.parts, np.int64).reshape(-1, 3)
        self.rank[abc[:, 2]], self.left[abc[:, 2]], self.right[abc[:, 2]] = np.arange(len(abc)), abc[:, 0], abc[:, 1]
        self.result = abc[:, 2]
        self.pair_rank = Lookup(abc[:, 0] << 32 | abc[:, 1], np.arange(len(abc), dtype=np.int32))
        self.alphabet = byte_alphabet()
        self.base = np.array([self.vocab[c] for c in self.alphabet], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in self.alphabet], np.int64)
        self.longest = 0
        self._trie()
        self.word_re = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.ascii_re = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.space_re = re.compile(f"[{SPACE[5:]}]")  # those beyond ASCII
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Ids of chunks and of words.
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pair_ok: dict[int, bool] = {}
        self.whole_ok: dict[int, bool] = {}
        self.stats = {"words": 0, "failed": 0}

    def _trie(self) -> None:
        """Edges (node, byte or END) -> node, and the token that ends at a node."""
        of = {c: b for b, c in enumerate(self.alphabet)}
        edges: dict[int, int] = {}
        ends = [-1]
        for t, i in self.vocab.items():
            closed = t.endswith(self.suffix) and len(t) > len(self.suffix)
            at, path = 0, [of[c] for c in (t[: -len(self.suffix)] if closed else t)] + [END] * closed
            self.longest = max(self.longest, len(path))
            for x in path:
                key = at << 9 | x
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                at = edges[key]
            ends[at] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        self.edges = Lookup(keys, np.fromiter(edges.values(), np.int32, len(edges)))
        self.ends = np.array(ends, np.int64)

    # -- speculation

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of each word: all tokens in order, and where each word's begin."""
        n = np.array([len(w) for w in words], np.int64)
        start = np.concatenate(([0], np.cumsum(n + 1)))
        text = np.full(start[-1], END, np.int64)
        inside = np.ones(start[-1], bool)
        inside[start[1:] - 1] = False
        text[inside] = np.frombuffer(b"".join(words), np.uint8)
        stop, pos, active = start[1:], start[:-1].copy(), np.arange(len(words))
        who, got = [], []
        while len(active):
            at, node = pos[active].copy(), np.zeros(len(active), np.int64)
            best, best_at = np.full(len(active), -1, np.int64), at.copy()
            go = np.arange(len(active))
            while len(go):
                node[go] = self.edges.get(node[go] << 9 | text[at[go]])
                go = go[node[go] >= 0]
                at[go] += 1
                token, rest = self.ends[node[go]], stop[active[go]] - at[go]
                fits = (token >= 0) & (rest != 1)  # what leaves only the end sign is no token here
                best[go[fits]], best_at[go[fits]] = token[fits], at[go[fits]]
                go = go[rest > 0]
            who.append(active)
            got.append(best)
            pos[active] = best_at
            active = active[best_at < stop[active]]
        who, got = np.concatenate(who), np.concatenate(got)
        order = np.argsort(who, kind="stable")
        return got[order], np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(words)))))

    # -- verification

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether BPE keeps the border between them.

        Both are taken apart, the later merge first. A merge across the border that comes before the
        merge just taken apart would have been done, so the pair can't stand.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, todo = np.zeros(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(todo):
            across = self.pair_rank.get(a << 32 | b).astype(np.int64)
            ra, rb = self.rank[a], self.rank[b]
            broken = (across >= 0) & (across < limit)
            done = ~broken & (ra < 0) & (rb < 0)
            ok[todo[done]] = True
            stay = ~(broken | done)
            a, b, ra, rb, todo = a[stay], b[stay], ra[stay], rb[stay], todo[stay]
            take_a = ra > rb
            limit = np.where(take_a, ra, rb + 1)
            a, b = np.where(take_a, self.right[a], a), np.where(take_a, b, self.left[b])
        return ok

    def _checked_pairs(self, pairs: np.ndarray) -> np.ndarray:
        keys, back = np.unique(pairs, return_inverse=True)
        if len(self.pair_ok) > PAIRS:
            self.pair_ok.clear()
        known = [self.pair_ok.get(k) for k in keys.tolist()]
        new = np.array([k for k, x in zip(keys.tolist(), known) if x is None], np.int64)
        if len(new):
            self.pair_ok.update(zip(new.tolist(), self.compatible(new >> 32, new & 0xFFFFFFFF).tolist()))
            known = [self.pair_ok[k] for k in keys.tolist()]
        return np.array(known, bool)[back]

    def _checked_tokens(self, tokens: np.ndarray) -> np.ndarray:
        keys, back = np.unique(tokens, return_inverse=True)
        for t in keys.tolist():
            if t not in self.whole_ok:
                text = self.token[t]
                closed = text.endswith(self.suffix) and len(text) > len(self.suffix)
                signs = list(text[: -len(self.suffix)] if closed else text)
                if closed:
                    signs[-1] += self.suffix
                self.whole_ok[t] = self.merge([self.vocab[c] for c in signs]) == [t]
        return np.array([self.whole_ok[t] for t in keys.tolist()], bool)[back]

    def verify(self, tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each word whether its guess stands."""
        word = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        fails = ~self._checked_tokens(tokens) if len(tokens) else np.zeros(0, bool)
        bad = np.bincount(word[fails], minlength=len(begin) - 1) > 0
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(tokens) else np.zeros(0, np.int64)
        if len(inner):
            wrong = ~self._checked_pairs(tokens[inner] << 32 | tokens[inner + 1])
            bad |= np.bincount(word[inner[wrong]], minlength=len(begin) - 1) > 0
        return ~bad

    # -- exact merging

    def merge(self, ids: list[int]) -> list[int]:
        """Exact BPE: the merge of least rank, leftmost first, until none is left."""
        n = len(ids)
        ids, after, before = ids[:], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, c, a, b) for rank, c, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, c, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q < n and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, m[1], ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many short words side by side: in each round, every word does its next merge.

        Returns all ids in order, and the number of each word's.
        """
        n = np.array([len(w) for w in words])
        width = int(n.max())
        ids = np.full((len(words), width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < n[:, None]] = self.base[np.frombuffer(b"".join(words), np.uint8)]
        ids[np.arange(len(words)), n - 1] = self.last[[w[-1] for w in words]]
        none = np.iinfo(np.int32).max

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.full(len(a), none, np.int32)
            there = np.flatnonzero((a >= 0) & (b >= 0))
            got = self.pair_rank.get(a[there].astype(np.int64) << 32 | b[there])
            out[there] = np.where(got < 0, none, got)
            return out

        rank = np.full((len(words), width + 1), none, np.int32)
        rank[:, :-1] = ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        todo, row, cols = np.arange(len(words)), np.arange(len(words)), np.arange(width)
        done, flat, count = [], [], []
        while len(todo):
            at = rank.argmin(axis=1)
            best = rank[row, at]
            ended = best == none
            if ended.any():
                rest = ids[ended]
                here = rest >= 0
                done.append(todo[ended])
                flat.append(rest[here])
                count.append(here.sum(axis=1))
                go = ~ended
                todo, ids, rank, at, best = todo[go], ids[go], rank[go], at[go], best[go]
                row = np.arange(len(todo))
                if not len(todo):
                    break
            after = cols > at[:, None]
            ids[row, at] = self.result[best]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(after, rank[:, 1:], rank[:, :-1])
            rank[row, at] = ranks(ids[row, at], ids[row, at + 1])
            prev = np.flatnonzero(at > 0)
            rank[prev, at[prev] - 1] = ranks(ids[prev, at[prev] - 1], ids[prev, at[prev]])
        done, flat, count = (np.concatenate(x) for x in (done, flat, count))
        order = np.argsort(done)
        begin = np.cumsum(count) - count
        n = count[order]
        ends = np.cumsum(n)
        return flat[np.repeat(begin[order] - ends + n, n) + np.arange(ends[-1])], n

    def _encode_words(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        tokens, begin = self.propose(raw)
        good = self.verify(tokens, begin)
        flat, cut = tokens.astype("<u4").tobytes(), (begin * 4).tolist()
        self.words.update(zip(words, [flat[i:j] for i, j in zip(cut, cut[1:])]))
        failed = np.flatnonzero(~good)
        self.stats["words"] += len(words)
        self.stats["failed"] += len(failed)
        length = np.array([len(w) for w in raw])
        failed = failed[np.argsort(length[failed], kind="stable")].tolist()
        for k in range(0, len(failed), 4096):
            part = failed[k : k + 4096]
            if length[part[-1]] <= 48:
                ids, counts = self.merge_all([raw[i] for i in part])
                flat, cut = ids.astype("<u4").tobytes(), [0, *(np.cumsum(counts) * 4).tolist()]
                self.words.update(zip([words[i] for i in part], [flat[i:j] for i, j in zip(cut, cut[1:])]))
                continue
            for i in part:
                ids = self.merge([*self.base[np.frombuffer(raw[i][:-1], np.uint8)].tolist(), int(self.last[raw[i][-1]])])
                self.words[words[i]] = np.array(ids, "<u4").tobytes()

    # -- texts

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # each sign for itself, so no final sigma
        return self.space_re.sub(" ", text)

    def _fill(self, chunks: list[str]) -> None:
        """Encode the chunks that the cache doesn't hold yet."""
        if len(self.cache) + len(chunks) > CACHE_CHUNKS:
            self.cache.clear()
        if len(self.words) > CACHE_CHUNKS // 2:
            self.words.clear()
        split = []
        for c in chunks:
            if c.isalpha():
                split.append((c,))
            elif c[:-1].isalpha() and c[-1] in ".,;:!?":
                split.append((c[:-1], c[-1]))
            else:
                split.append(self.ascii_re.findall(c) if c.isascii() else self.word_re.findall(c))
        known = self.words
        if words := list({w for ws in split for w in ws if w not in known}):
            self._encode_words(words)
        self.cache.update([(c, known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])) for c, ws in zip(chunks, split)])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Each distinct chunk of the batch is looked up once, and ids are gathered from there.
        """
        cuts = [self.special_re.split(x) if self.special_re is not None and "<" in x else [x] for x in texts]
        parts = [self.normalize(x) for cut in cuts for x in cut[::2]]
        lists = pc.ascii_split_whitespace(pa.array(parts, pa.large_string()))
        coded = lists.values.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        got = list(map(self.cache.get, chunks))
        if new := [c for c, x in zip(chunks, got) if x is None]:
            self._fill(new)
            held = self.cache
            if len(held) < len(chunks) or None in (more := list(map(held.get, chunks))):  # it has started anew
                more = [held[c] if x is None else x for c, x in zip(chunks, got)]
            got = more
        flat = np.frombuffer(b"".join(got), "<u4")
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        begin = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[index]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(begin[index] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        at = (np.concatenate(([0], ends))[lists.offsets.to_numpy()] * 4).tolist()
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B") if len(ids) else memoryview(b"")
        pieces = [bytes(raw[i:j]) for i, j in zip(at, at[1:])]
        if len(pieces) == len(texts):
            return pieces
        out, k = [], 0
        for cut in cuts:
            own = [self.special[x].to_bytes(4, "little") if i % 2 else pieces[k + i // 2] for i, x in enumerate(cut)]
            k += (len(cut) + 1) // 2
            out.append(b"".join(own))
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens of ids in that form, joined by a space, as for a file without a decoder."""
        return " ".join(map(self.token.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` of every text."""
    path = tokenizer or default_tokenizer()
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in common.slices(batches):
            got = c.encode_batch(b.column("text").to_pylist())
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(c.decode, got)))], ["doc_id", "ids", "decoded"])

    return common.with_text(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text."""
    path = tokenizer or default_tokenizer()
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for b in common.slices(batches):
            got = c.encode_batch(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([sha(x).hexdigest() for x in got]), pa.array([sha(c.decode(x).encode()).hexdigest() for x in got])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.with_text(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def pieces(docs: DataFrame, most: int = 4096, end: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Every text's ids and the id ``end``, cut into pieces of at most ``most`` tokens.

    Returns ``doc_id``, ``piece`` (from 0), ``start`` (ids before it), ``length`` and ``ids_crc32``.
    """
    path = tokenizer or default_tokenizer()
    common.small_batches(docs.sparkSession)
    tail, step = int(end).to_bytes(4, "little"), 4 * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in common.slices(batches):
            row, piece, length, crc = [], [], [], []
            for i, x in enumerate(c.encode_batch(b.column("text").to_pylist())):
                x += tail
                for k in range(0, len(x), step):
                    part = x[k : k + step]
                    row.append(i)
                    piece.append(k // step)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            piece = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(piece * most), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return common.with_text(docs).mapInArrow(common.lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")
