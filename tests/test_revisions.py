"""Revisions, outliers, units and derived facts on small fixtures."""

from pyspark.sql import functions as F

from tallyloom.operators import consistency, revisions
from tallyloom.sources.readers import kept

REVISION = "revision_id long, parent_id long, status string"


def rooted(spark, rows):
    return {r["revision_id"]: (r["root_id"], r["depth"]) for r in revisions.rooted(spark.createDataFrame(rows, REVISION), kept).collect()}


def test_long_chains_forks_and_missing_parents(spark):
    rows = [(i, i - 1 if i else None, "SUPERSEDED") for i in range(300)] + [(1000, 299, "DRAFT"), (1001, 299, "PUBLISHED"), (2000, 77777, "PUBLISHED")]
    got = rooted(spark, rows)
    assert all(got[i] == (0, i) for i in range(300))
    assert got[1000] == got[1001] == (0, 300) and got[2000] == (2000, 0)


def test_circles_have_no_root(spark):
    got = rooted(spark, [(1, 2, "DRAFT"), (2, 3, "DRAFT"), (3, 1, "DRAFT"), (4, 4, "DRAFT"), (5, 1, "DRAFT"), (9, None, "PUBLISHED"), (10, 9, "DRAFT")])
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [(None, None)] * 5 and got[10] == (9, 1)
    assert rooted(spark, []) == {}


def test_current_of_drafts_and_forks(spark):
    rows = [(1, None, "SUPERSEDED"), (2, 1, "PUBLISHED"), (3, 2, "DRAFT"), (4, 1, "PUBLISHED"), (8, None, "DRAFT")]
    got = {r["root_id"]: tuple(r)[1:] for r in revisions.current(revisions.rooted(spark.createDataFrame(rows, REVISION), kept)).collect()}
    assert got == {1: (4, 1, 4, 1, True), 8: (None, None, 1, 1, False)}


def test_publishing_supersedes_and_refuses_stale_drafts(spark):
    rows = [(1, None, "PUBLISHED"), (2, 1, "DRAFT"), (3, 1, "DRAFT"), (4, 99, "DRAFT"), (5, None, "SUPERSEDED"), (6, 5, "DRAFT"), (7, None, "DRAFT")]
    table = spark.createDataFrame(rows, REVISION)
    got = {r["revision_id"]: (r["status"], r["outcome"]) for r in revisions.publish(table, table.where("revision_id IN (1, 2, 3, 4, 6)").select("revision_id")).collect()}
    assert got == {1: ("SUPERSEDED", "NOT_A_DRAFT"), 2: ("PUBLISHED", "PUBLISHED"), 3: ("DRAFT", "STALE"), 4: ("PUBLISHED", "PUBLISHED"), 5: ("SUPERSEDED", None), 6: ("DRAFT", "STALE"), 7: ("DRAFT", None)}


def test_differences_tell_a_null_from_a_missing_fact(spark):
    facts = spark.createDataFrame([(1, "A", 1.0), (1, "B", None), (1, "C", 3.0), (2, "A", 1.0), (2, "B", 2.0), (2, "D", None)], "revision_id long, code string, value double")
    pairs = spark.createDataFrame([(2, 1)], "revision_id long, before_id long")
    got = {r["code"]: (r["before"], r["after"], r["change"]) for r in revisions.differences(facts, pairs).collect()}
    assert got == {"B": (None, 2.0, "CHANGED"), "C": (3.0, None, "REMOVED"), "D": (None, None, "ADDED")}


def test_outliers_need_spread_and_values(spark):
    rows = [("a", v) for v in (10.0, 11.0, 9.0, 10.0, 12.0, 500.0, None, float("nan"))] + [("b", v) for v in (1.0, 1.0, 1.0, 1.0, 90.0)] + [("c", v) for v in (1.0, 2.0, 300.0)]
    got = consistency.outliers(spark.createDataFrame(rows, "company string, value double").withColumn("code", F.lit("REV"))).collect()
    assert [(r["company"], r["value"], r["median"], r["deviation"]) for r in got] == [("a", 500.0, 10.0, 1.0)]


def test_powers_of_a_thousand(spark):
    rows = [(1000.0, 1.0), (1.0, 1000.0), (4.0e6, 1.0), (6.0, 1.0), (1.0, 0.0), (None, 1.0), (0.0, 5.0), (-2000.0, 1.0), (2.5e-9, 1.0), (1e12, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(consistency.power_of_thousand(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [1, -1, 2, 0, None, None, None, 1, -3, 0]


def test_units_and_currencies_of_small_reports(spark):
    rows = [(1, y, "FY", c, 10.0 * (1000 if (y, c) == (2021, "X") else 1), s, cur) for y in (2020, 2021) for c, s, cur in (("W", 1, "IDR"), ("X", 1, "IDR"), ("Y", 5 if y == 2021 else 1, "USD"), ("Z", 0, None))]
    got = consistency.unit_and_currency(spark.createDataFrame(rows, "company int, year int, period string, code string, value double, scale int, currency string")).collect()
    assert sorted((r["year"], r["code"], r["rule"], r["found"], r["expected"]) for r in got) == [(2020, "Y", "CURRENCY", "USD", "IDR"), (2021, "X", "UNIT_JUMP", "1", "0"), (2021, "Y", "CURRENCY", "USD", "IDR"), (2021, "Y", "SCALE", "5", "1")]


def test_derived_quarters_name_their_sources(spark):
    rows = [("q1", 1, 2020, 1, "REV", 10.0), ("h1", 1, 2020, 2, "REV", 25.0), ("fy", 1, 2020, 4, "REV", 70.0), ("n1", 2, 2020, 1, "REV", None), ("n2", 2, 2020, 2, "REV", 9.0), ("s", 1, 2020, 1, "CASH", 1.0)]
    got = consistency.derived_quarters(spark.createDataFrame(rows, "fact_id string, company int, year int, period_ord int, code string, value double"), ["REV"]).orderBy("quarter").collect()
    assert [(r["quarter"], r["value"], r["formula"], r["source_ids"]) for r in got] == [("Q1", 10.0, "REV[Q1]", ["q1"]), ("Q2", 15.0, "REV[H1] - REV[Q1]", ["h1", "q1"])]
