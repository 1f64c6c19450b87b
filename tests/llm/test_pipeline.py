import re

import corpus_pipeline as cp
import pytest

from tallyloom.llm import bpe, langid
from test_jaccard import brute as groups
from test_pii import base
from test_substrings import brute as cuts


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    from conftest_rows import SCHEMA

    at = tmp_path_factory.mktemp("pipeline")
    mail = [(10_000 + i, f"{r[1]} write to x{i}@mail.com", r[2], r[3], None) for i, r in enumerate(rows[:6]) if r[1]]
    spark.createDataFrame(rows + mail, SCHEMA).write.parquet(f"{at}/documents.parquet")
    return str(at)


def as_rows(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_stages_as_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spec = langid.dictionaries(docs)
    rows = as_rows(docs)
    step = cp.common.materialize(cp.identify_language(spark, docs, folder), "t")
    kept = as_rows(step)
    told = {r["doc_id"]: r for r in langid.classify(docs, spec).collect()}
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if not told[r[0]]["rejected"] or [k for k in kept if k == r])
    assert 0 < len(kept) < len(rows) and not any(r[1] is None for r in kept)

    step = cp.common.materialize(cp.drop_near_duplicates(spark, step, folder), "t")
    first = as_rows(step)
    label = {(g[0], r[1]): g[2] for g, r in zip(sorted(groups(kept)), sorted(kept, key=lambda r: r[0]))}
    assert {r[0] for r in first} == {g[2] for g in groups(kept)} and len(first) == len(set(first)) and label

    step = cp.common.materialize(cp.cut_repeats(spark, step, folder), "t")
    cut = as_rows(step)
    want = {r[0]: r for r in cuts(first, 100)}
    assert {r[0] for r in cut} == {r[0] for r in first}
    for r in cut:
        assert abs(len((r[1] or "").encode()) - (want[r[0]][1] - want[r[0]][2])) <= 3 * want[r[0]][3] and r[4] == len(r[1])

    step = cp.common.materialize(cp.mask_personal_data(spark, step, folder), "t")
    clean = as_rows(step)
    assert len(clean) == len(cut) and not any(base(r[1]) for r in clean)
    assert sum("<EMAIL>" in r[1] for r in clean) == sum(bool(base(r[1])) for r in cut) > 0

    got = cp.pack(spark, step, folder).collect()
    codec = bpe.codec(bpe.default_tokenizer())
    assert sum(g["length"] for g in got) == sum(len(x) // 4 + 1 for x in codec.encode_batch([r[1] for r in clean]))


def test_run_packs_what_the_stages_keep(spark, folder):
    got = cp.run(spark, folder).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert got and {g["doc_id"] for g in got} < ids
    assert [n for n, _ in cp.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "pii", "packing"]
    assert not re.search("localCheckpoint", open(cp.__file__).read())


def test_other_columns_and_an_empty_table(spark, rows, tmp_path):
    from conftest_rows import SCHEMA

    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS score", "1 AS node", "'x' AS rejected", "2 AS piece")
    more.write.parquet(f"{tmp_path}/wide/documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/plain/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    key = lambda d: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in cp.run(spark, f"{tmp_path}/{d}").collect())
    assert key("wide") == key("plain") and key("none") == []
