from collections import Counter, defaultdict

import numpy as np

from tallyloom.llm import divergence


def terms_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def brute(rows, ranks=200):
    docs = [(r[2] or "", r[3] or "", terms_of(r[1])) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        holders = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = [t for t, n in holders.items() if n >= 3]
        count = defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                count[source].update(t for t in terms if holders[t] >= 3)
        whole = sum(count.values(), Counter())

        def share(of, t):
            return 1 + 10**9 * (of[t] + 1) // (sum(of.values()) + len(kept))

        for a in count:
            pairs = [(-sum((share(count[a], t) - share(count[b], t)) ** 2 // share(count[b], t) for t in kept), b.encode(), b) for b in count if b != a]
            out += [(lang, a, "pair", b, -v, i + 1) for i, (v, _, b) in enumerate(sorted(pairs))]
            mine = [(-((share(count[a], t) - share(whole, t)) ** 2 // share(whole, t)), t.encode(), t) for t in kept if count[a][t] and share(count[a], t) > share(whole, t)]
            out += [(lang, a, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(mine)[:ranks])]
    return out


def test_equals_brute_force_with_odd_rows(docs, rows):
    assert sorted(map(tuple, divergence.audit(docs).collect())) == sorted(brute(rows))


def test_sources_of_many_kinds(spark):
    rows = [(i, f"the word{chr(97 + i % 7)} É ÉCOLE the a-b_c {'zz ' * (i % 4)}", "xx", f"s{i % 5}", 0, "clash", i) for i in range(90)]
    rows += [(200, None, "xx", "quiet", 0, "", 0), (201, "alone", "yy", "s", 0, "", 0), (202, "9 8 7", "zz", "s", 0, "", 0), (203, "", "zz", "t", 0, "", 0), (204, "tie tie", None, None, 0, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, term string, n long")
    assert sorted(map(tuple, divergence.audit(df.repartition(4)).collect())) == sorted(brute(rows))


def test_ranks_end_where_they_should(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(k, " ".join(words), "en", "a", 0) for k in range(3)] + [(9, "other", "en", "b", 0)]
    got = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).where("part = 'term'").orderBy("rank").collect()
    assert got == [] or [r["item"] for r in got] == sorted(words)[:200]


def test_counts_are_sent_in_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "BLOCK", 5)
    import pyarrow as pa

    texts = [(r[2] or "", r[3] or "", r[1] or "") for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*texts)], ["lang", "source", "text"])
    total = Counter()
    parts = list(divergence.tally(iter([batch])))
    for b in parts:
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in b.columns)):
            total[lang, source, term] += n
    assert len(parts) > 5
    assert total == Counter((lang, source, t) for lang, source, text in texts for t in terms_of(text))


def test_shares_of_large_counts():
    count, total = np.array([[5, 10**13]]), np.array([10, 3 * 10**13])
    assert divergence.shares(count, total).tolist() == [[1 + 10**9 * 6 // 10, 1 + 10**9 * (10**13 + 1) // (3 * 10**13)]]


def test_empty_table(none):
    assert divergence.audit(none).collect() == []
