import re
from collections import Counter

import duckdb
import pytest

from tallyloom.llm import catalog, quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, again = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def test_base_figures(docs, rows):
    got = sorted(tuple(r)[:6] for r in quality.judge(docs).collect())
    assert got == sorted((r[0], *base(r[1])) for r in rows)


def test_verdict(spark):
    line = "This page is hosted by nobody in particular at all today, number {}."
    def own(i):
        return " ".join(w + chr(97 + i % 26) + chr(97 + i // 26 % 26) for w in "word another third more again some other text here now and then".split())

    rows = [(i, line.format(i) + "\n" + own(i), "a") for i in range(30)]
    rows += [(100, line.format(1) + "\nfew words", "a"), (101, line.format(1) + "\nfew words too", "b"), (102, line.format(7), "a"), (103, None, None)]
    rows += [(200 + i, own(999), "c") for i in range(60)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["words_left"]) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (False, True, 12)
    assert got[100] == (False, False, 2) and got[102] == (False, False, 0)
    assert got[101] == (False, True, 16)
    assert got[103] == (True, False, 0)
    assert got[200] == (False, False, 0)  # a page of which its host holds sixty
    once = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), copies="once").collect()}
    assert once[200] and once[259] and not once[100]
    with pytest.raises(ValueError):
        quality.frequent_lines(quality.scan(spark.createDataFrame(rows[:1], "doc_id long, text string, source string")), copies="never")


def test_empty_table(none):
    assert quality.judge(none).count() == 0


def test_null_hosts_long_texts_and_clashing_names(spark):
    line = "a line that everybody has"
    rows = [(i, f"{line}\n" + " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + k)}" for k in range(11)), None, 1, "mine") for i in range(40)] + [(99, "word " * 200_000 + "\n" + " ".join(f"end{k}" for k in range(99)), None, 2, "mine")]
    schema = "doc_id long, text string, source string, line int, host string"
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
    assert {(got[i]["kept"], got[i]["words_left"]) for i in range(40)} == {(True, 11)}
    assert got[99]["n_words"] == 200_099 and got[99]["base_failed"] and got[99]["n_repeat_words"] == 200_000


def test_sql_equals_the_operator(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = catalog.op8_quality(spark, folder)
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {names} FROM ({catalog.QUALITY})").fetchall())
