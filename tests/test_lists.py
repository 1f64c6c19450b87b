"""Byte ranges of files, nested arrays and lists on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import details, pipeline
from tallyloom.plans import catalog
from tallyloom.sources import ranges


def read(spark, path, **options):
    ranges.register(spark)
    reader = spark.read.format("byte_ranges").option("path", str(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return sorted((os.path.basename(r["path"]), r["start"], bytes(r["content"])) for r in reader.load().collect())


def test_heads_tails_and_parts(spark, tmp_path):
    for name, content in (("a.bin", b"0123456789"), ("b.bin", b""), ("c.txt", b"skip"), ("d.bin", b"xyz")):
        (tmp_path / name).write_bytes(content)
    assert read(spark, tmp_path, suffix=".bin", length=4, page=2) == [("a.bin", 0, b"0123"), ("b.bin", 0, b""), ("d.bin", 0, b"xyz")]
    assert read(spark, tmp_path, suffix=".bin", start=-4, length=9) == [("a.bin", 6, b"6789"), ("b.bin", 0, b""), ("d.bin", 0, b"xyz")]
    assert read(spark, tmp_path / "a.bin", part=4) == [("a.bin", 0, b"0123"), ("a.bin", 4, b"4567"), ("a.bin", 8, b"89")]
    assert read(spark, f"file://{tmp_path}", suffix=".bin", start=8, length=5) == [("a.bin", 8, b"89"), ("b.bin", 0, b""), ("d.bin", 3, b"")]
    assert read(spark, tmp_path, suffix=".none") == []
    with pytest.raises(ValueError):
        ranges.Reader({"path": "x", "page": "0"})


def test_a_head_is_read_without_its_body(spark, tmp_path):
    with open(tmp_path / "huge.bin", "wb") as f:  # a terabyte of holes; no worker could hold or read it
        f.write(b"%PDF-")
        f.truncate(1 << 40)
    got = ranges.heads(spark, str(tmp_path), 5).collect()
    assert [(r["size"], r["length"], bytes(r["content"])) for r in got] == [(1 << 40, 5, b"%PDF-")]
    assert read(spark, tmp_path, start=-3, length=3) == [("huge.bin", (1 << 40) - 3, b"\0\0\0")]


def test_pages_of_a_listing_follow_their_marker(tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}").write_bytes(b"x" * i)
    marker, seen = "", []
    while page := ranges.listing(str(tmp_path), after=marker, most=2):
        seen.append([size for _, size in page])
        marker = page[-1][0]
    assert seen == [[0, 1], [2, 3], [4]]


def test_objects_and_strings_of_mixed_arrays(spark):
    rows = [(1, '[{"a":1,"b":"x"},"s",null,[{"a":2}],{"c":3}]'), (2, "{}"), (3, None), (4, "no json"), (5, "[]")]
    got = spark.createDataFrame(rows, "id int, j string").select("id", details.objects_of(F.col("j"), "a", "b").alias("o"), details.strings_of(F.col("j")).alias("s")).orderBy("id").collect()
    assert [[tuple(x) for x in r["o"]] for r in got] == [[("1", "x"), (None, None)], [], [], [], []]
    assert got[0]["s"] == ["s"]


def test_nested_arrays_are_counted_and_dropped(spark):
    rows = [(1, [("A",), ("B",), ("A",)]), (2, []), (3, None)]
    got = details.counted_and_dropped(spark.createDataFrame(rows, "id int, c array<struct<status:string>>"), "c", "status", ["A", "B"])
    assert got.columns == ["id", "a", "b", "total"] and sorted(map(tuple, got.collect())) == [(1, 2, 1, 3), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_pages_of_an_empty_list(spark):
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in pipeline.COLUMNS))
    assert {(r["total"], r["size"], r["pages"]) for r in pipeline.page_counts(none, [1, 99]).collect()} == {(0, 5, 1), (0, 50, 1)}


def test_entries_are_not_shuffled_by_their_few_codes(spark):
    for name in ("statement_lookup", "report_detail", "mapping_accounts"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(code#" not in plan, name
