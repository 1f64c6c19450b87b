import hashlib
import math
import random

import numpy as np
import pytest

from tallyloom.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, q int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Every distance in Python's whole numbers."""
    kept = [(i, [float(np.float32(x)) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, [math.floor(4096 * x) for x in v] + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, v, _ in kept:
        first[i] = min(v, first.get(i, v))
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    books = [[part(first[i], p) for i in ids] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(v, p):
        return min((far(part(v, p), c), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(ids)):
                mine = [part(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), label) for i, v, label in kept]
    by_label = {label: sum(e for _, _, e, x in out if x == label) for *_, label in out}
    return [(i, code, e, by_label[label], digest) for i, code, e, label in out]


def text(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_equals_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(24)], rng.choice([None, 1, 2]), "x", 1) for i in range(60)]
    rows += [(i, rows[i % 5][1], 1, None, None) for i in range(60, 80)]  # copies and ties
    rows += [rows[0], (3, [0.5] * 24, 2, "", 0), (None, [0.25] * 24, 2, "", 0), (81, [rng.random()] * 13, None, "", 0), (82, [], 1, "", 0)]
    rows += [(90, None, 1, "", 0), (91, [1.0, None] * 12, 1, "", 0), (92, [math.nan] * 24, 1, "", 0), (-1, [math.inf] * 24, 1, "", 0)]
    got = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert text(got.collect()) == text(brute(rows))


def test_few_vectors_and_none(spark):
    rows = [(7, [0.1] * 8, 1, "", 0), (5, [-0.1] * 8, 1, "", 0)]
    assert text(vectorcodes.compress(spark.createDataFrame(rows, SCHEMA)).collect()) == text(brute(rows))
    for none in ([], [(1, None, 1, "", 0)]):
        assert vectorcodes.compress(spark.createDataFrame(none, SCHEMA)).collect() == []


def test_large_components_are_clamped(spark):
    rows = [(1, [3e38] * 8, 1, "", 0), (2, [-3e38] * 8, 1, "", 0), (3, [0.0] * 8, 1, "", 0)]
    got = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["error"] for r in got) == [0, 0, 0]


@pytest.mark.parametrize("width", [1, 2, 3, 8, 13])
def test_bounds_drop_no_nearest_entry(width):
    rng = np.random.default_rng(width)
    for spread in (3, 4000, 2**26):
        x, book = rng.integers(-spread, spread + 1, (500, width)), rng.integers(-spread, spread + 1, (16, width))
        book[5] = book[2]
        every = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        code, far = vectorcodes.nearest(x, book)
        assert (far == every.min(axis=1)).all() and (code == every.argmin(axis=1)).all()
