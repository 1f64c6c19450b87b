import itertools
import random
from collections import defaultdict

import numpy as np

from tallyloom.llm import toxicity


def plain(word):
    """Weights of a word's subsequences of three and four signs, one at a time."""
    out = defaultdict(float)
    for size, gaps in ((3, 2), (4, 2)):
        for at in itertools.combinations(range(len(word)), size):
            if at[-1] - at[0] + 1 - size <= gaps:
                out["".join(word[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1 - size)
    return out


def dot(a, b):
    return sum(x * b[k] for k, x in a.items() if k in b)


def hashed(words):
    who, key, weight = toxicity.subsequences(words)
    out = [defaultdict(float) for _ in words]
    for w, k, x in zip(who.tolist(), key.tolist(), weight.tolist()):
        out[w][k] += x
    return out


def test_kernel_equals_enumeration():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéx^$") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    for a, b, x, y in zip(words[::2], words[1::2], hashed(words)[::2], hashed(words)[1::2]):
        for p, q, u, v in ((a, b, x, y), (a, a, x, x)):
            assert np.isclose(dot(plain(p), plain(q)), dot(u, v), atol=1e-5), (p, q)


def test_every_short_string_has_its_own_key():
    signs = "abcdefghijklmnopqrstuvwxyz^$"
    words = ["".join(p) for p in itertools.product(signs, repeat=3)]
    who, key, _ = toxicity.subsequences(words)
    assert len(who) == len(words) == len(np.unique(key))
