import hashlib
import random
import re

import pytest

from tallyloom.llm import pii

KIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in KIND.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


CASES = [
    "mail a.b@c.de, x@y@z.com a@b.c_d@e.f @x.y a@b a@-.-. 1@2.3.4.5 ü@x.de",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.01 999.1.1.1.1 1.2.3 4..5.6.7 1.2.3.4@x.y",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111, 5500005555555559 " + "1" * 400,
    "+1 (743) 555-3824 +49 (0) 30.1234567- +12 +1+2+3 12 34 56 78 90 + 1234567890",
    "é😀 x@y.zz ünï +33 1 23 45 67 89 😀",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" but (743) 555-3824 and jane [at] site [dot] org',
    None, "", "a" * 50_000 + "@", "1" * 30_000, "+1" + "(" * 30_000, "1." * 5_000, "x@y.z " * 800,
]


@pytest.fixture(scope="module")
def got(spark):
    rng = random.Random(1)
    more = ["".join(rng.choice("0123456789.+-@ ()ab_%é") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    texts = CASES + more + [CASES[5]]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows, {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_base_spans_as_by_brute_force(got):
    rows, out = got
    for i, t in rows:
        want = base(t)
        assert [out[i][f"n_{k}"] for k in KIND] == [sum(w[0] == k for w in want) for k in KIND], t and t[:80]
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(out[i]["spans"].split(","))


def test_method_adds_spans(got):
    _, out = got
    assert "secret:9:49" in out[5]["spans"].split(",") or "secret:8:50" in out[5]["spans"].split(",")


def test_redaction(spark):
    rows = [(1, "é a@b.cd and +1 (743) 555-3824.", "k"), (1, "clean", "k"), (2, None, "k"), (1, "é a@b.cd and +1 (743) 555-3824.", "k")]
    out = sorted((r["doc_id"], r["text"] or "", r["base"]) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect())
    assert out == [(1, "clean", "k"), (1, "é <EMAIL> and <PHONE>.", "k"), (1, "é <EMAIL> and <PHONE>.", "k"), (2, "", "k")]


def test_long_secrets_and_masked_addresses_are_proposed(spark):
    rng = random.Random(4)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    token = "eyJ" + "".join(rng.choice(sign) for _ in range(300)) + "." + "".join(rng.choice(sign) for _ in range(342))
    late = "".join(rng.choice(sign[:52]) for _ in range(150)) + "4711"
    texts = [f'token = "{token}"', f"key: {token[:201]}", f"key: {late}", "jane [at] site [dot] org", "jane (at) site (dot) org", "x" * 2_000_000, "y" * 500_000 + "1"]
    rows = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "spans").collect()
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in rows for s in r["spans"] if s["kind"] in ("secret", "masked_email")}
    assert got == {(0, "secret", 9, 9 + len(token)), (1, "secret", 5, 206), (2, "secret", 5, 159), (3, "masked_email", 0, 24), (4, "masked_email", 0, 24), (6, "secret", 0, 500_001)}


def test_long_secrets_and_masked_addresses_are_redacted(spark):
    rng = random.Random(6)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    rows = [(i, 'token = "eyJ' + "".join(rng.choice(sign) for _ in range(200 + 9 * i)) + '" ends') for i in range(30)]
    rows += [(100 + i, f"contact jane{chr(97 + i)} [at] site [dot] org today 1") for i in range(20)]
    rows += [(200 + i, "page 000000000000000000000 of " + "0" * 40) for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {out[i] for i in range(30)} == {'token = "<SECRET>" ends'}
    assert {out[100 + i] for i in range(20)} == {"contact <MASKED_EMAIL> today 1"}


def test_redaction_as_by_hand(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a@b.cd", "é😀 ", "+1 (743) 555-3824", "10.1.2.3", "word ", "\n", "4111111111111111 ", "." * rng.randint(1, 1500)]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: sorted((s["start"], s["end"], s["kind"]) for s in r["spans"]) for r in pii.label(docs).collect()}
    for r in pii.redact(docs).collect():
        out, at = "", 0
        for a, b, k in spans[r["doc_id"]]:
            if a >= at:
                out += texts[r["doc_id"]][at:a] + f"<{k.upper()}>"
            at = max(at, b)
        assert r["text"] == out + texts[r["doc_id"]][at:]


def test_time_in_proportion_to_a_texts_spans(spark):
    import time

    took = []
    for n in (4_000, 32_000):
        docs = spark.createDataFrame([(1, "a1@b.c 1 " * n)], "doc_id long, text string")
        start = time.perf_counter()
        assert pii.redact(docs).first()["text"] == "<EMAIL> 1 " * n
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 2


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "to a@b.cd", 1, 2, [1], "x"), (1, "to a@b.cd", 1, 2, [1], "x"), (None, None, None, None, None, None)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, id_ long, hash_ long, spans_ array<int>, kind string"))
    assert out.columns == ["doc_id", "text", "id_", "hash_", "spans_", "kind"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(["(1, 'to <EMAIL>', 1, 2, [1], 'x')"] * 2 + ["(None, None, None, None, None, None)"])


def test_no_python_on_the_path(docs):
    plan = pii.digest(docs.drop("n_chars"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(none):
    assert pii.digest(none).count() == 0


def test_em_finds_the_reliable_labeler():
    counts = [((1, 1, 1, 1, 0), 80), ((1, 1, 1, 0, 0), 40), ((-1, -1, -1, 0, 0), 100), ((0, 1, -1, 0, 0), 10)]
    share, rates = pii.reliabilities(counts)
    assert pii.likelihood((1, 1, 1, 1, 0), share, rates) > 0.9 > 0.1 > pii.likelihood((-1, -1, -1, 0, 0), share, rates)
