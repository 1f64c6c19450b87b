import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "One", "a b c d", "A b  c d", "é" * 250, "a" * 400, "ab" * 300, "\n\n", "𝒳😀 x", "…", "123 456", "<|endoftext|> and <|startoftext|>x"]
    base = [sentence(rng, rng.choice([3, 12, 60, 200])) for _ in range(25)]
    shared = sentence(rng, 45)
    for k, t in enumerate(base):
        texts.append(t)
        if k % 2:
            texts.append(t)
        if k % 3 == 0:
            w = t.split()
            for _ in range(4):
                v = w[:]
                for _ in range(max(1, len(v) // 60)):
                    v[rng.randrange(len(v))] = "zz"
                texts.append(" ".join(v))
        if k % 4 == 0:
            texts.append(sentence(rng, 15) + "\n" + shared + "\n" + sentence(rng, 10))
    texts.append(" ".join(base) * 3)
    rng.shuffle(texts)
    rows = [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s", "t", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[3], (rows[4][0], "another text under the same id", None, "s", 5)]
