"""Request bodies, constraints, audit rows and uploads on small fixtures."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit, bodies, constraints, uploads

VALUES = {"REV": 1, "NET_PROFIT": -1.5, "TOTAL_ASSETS": 10, "TOTAL_LIAB": 4, "EQUITY": 6, "OCF": 0}
GOOD = {"companyId": "c", "year": 2020, "periodType": "FY", "values": VALUES}


def errors(spark, check, cases):
    rows = [(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(cases)]
    return [r["errors"] for r in check(spark.createDataFrame(rows, "id int, body string")).orderBy("id").collect()]


def test_every_problem_of_a_report_has_its_path(spark):
    cases = [GOOD, GOOD | {"year": 2020.0, "audited": False, "sourceFile": "x" * 255, "extra": [1]}, {"year": "2020", "periodType": "MONTHLY", "companyId": ""}, GOOD | {"values": {k: None for k in VALUES}}, GOOD | {"values": []}, GOOD | {"year": 1999, "audited": 1, "sourceFile": "x" * 256}, "no", "[]", None, ""]
    got = errors(spark, bodies.reports, cases)
    assert got[0] == [] and got[1] == []
    assert got[2] == ["companyId: TOO_SHORT", "year: TYPE", "periodType: DOMAIN", "values: REQUIRED"]
    assert got[3] == [f"values.{k}: TYPE" for k in bodies.BODY_VALUES]
    assert got[4] == ["values: TYPE"] and got[5] == ["year: MIN", "audited: TYPE", "sourceFile: TOO_LONG"]
    assert got[6] == ["body: JSON"] and got[7] == ["body: TYPE"] and got[8] == ["body: JSON"] and got[9] == ["body: JSON"]


def test_companies_are_stored_in_capitals_with_defaults(spark):
    cases = [{"ticker": " ab\t", "name": "No"}, {"ticker": "x", "name": "Name", "country": "sg", "currency": "usd", "fiscalYearEnd": "3"}, {"ticker": " ", "name": "a", "country": "s", "currency": "us", "fiscalYearEnd": "x"}]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "id int, body string")
    got = bodies.companies(rows).orderBy("id").collect()
    assert [(r["ticker"], r["country"], r["currency"]) for r in got] == [("AB", "ID", "IDR"), ("X", "SG", "USD"), (None, None, None)]
    assert got[2]["errors"] == ["ticker: TOO_SHORT", "name: TOO_SHORT", "country: TOO_SHORT", "currency: LENGTH", "fiscalYearEnd: TYPE"]


def test_accounts_have_domains_and_patterns(spark):
    good = {"code": " CASH_2 ", "name": "Cash", "statementType": "OTHER", "valueNature": "STOCK"}
    got = errors(spark, bodies.accounts, [good, good | {"normalBalance": "DEBIT"}, good | {"normalBalance": None, "code": "a-b", "statementType": "X"}, {"code": "A"}])
    assert got[:2] == [[], []] and got[2] == ["code: PATTERN", "statementType: DOMAIN", "normalBalance: TYPE"]
    assert got[3] == ["code: TOO_SHORT", "name: REQUIRED", "statementType: REQUIRED", "valueNature: REQUIRED"]


def test_clashing_columns_of_bodies_stay(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD), "mine", "own")], "id int, body string, parsed_ string, raw_ string")
    got = bodies.reports(df).collect()[0]
    assert (got["parsed_"], got["raw_"], got["errors"]) == ("mine", "own", [])


def test_constraints_of_each_kind(spark):
    table = constraints.Table(checks=(constraints.Check("positive", "n > 0"),), uniques=(constraints.Unique("pair", ("a", "n")), constraints.Unique("part", ("a",), "n < 5")), foreign=(constraints.Foreign("fk", "a", "P"),), required=("n",), enums={"a": ("x", "y")})
    rows = spark.createDataFrame([("1", "x", 1), ("2", "x", 9), ("3", "x", 9), ("4", "z", -1), ("5", None, None), ("6", None, 1), ("7", "x", 2)], "id string, a string, n int")
    parents = spark.createDataFrame([("x",), (None,)], "id string")
    got = {(r["constraint_name"]): (r["n_rows"], r["first_id"]) for r in constraints.violations({"T": rows, "P": parents}, {"T": table, "absent": table}).collect()}
    assert got == {"positive": (1, "4"), "n_required": (1, "5"), "a_domain": (1, "4"), "pair": (2, "2"), "part": (2, "1"), "fk": (1, "4")}
    assert constraints.violations({"T": rows.limit(0), "P": parents}, {"T": table}).collect() == []
    with pytest.raises(ValueError):
        constraints.violations({}, {"T": table})


def test_audit_rows_of_nulls_and_equal_rows(spark):
    schema = "id int, a string, b double"
    before = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "gone", None), (4, "same", None), (None, "n", 1.0)], schema)
    after = spark.createDataFrame([(1, "y", 1.0), (2, "now", None), (4, "same", None), (5, "new", None), (None, "n", 2.0)], schema)
    got = {r["id"]: (r["action"], {k: tuple(v) for k, v in r["fields"].items()}, r["before"], r["after"]) for r in audit.changes(before, after, ["id"], "T").collect()}
    assert got == {
        1: ("UPDATE", {"a": ("x", "y")}, '{"a":"x"}', '{"a":"y"}'), 2: ("UPDATE", {"a": (None, "now"), "b": ("2.0", None)}, '{"a":null,"b":"2.0"}', '{"a":"now","b":null}'),
        3: ("DELETE", {"a": ("gone", None)}, '{"a":"gone"}', None), 5: ("INSERT", {"a": (None, "new")}, None, '{"a":"new"}'), None: ("UPDATE", {"b": ("1.0", "2.0")}, '{"b":"1.0"}', '{"b":"2.0"}'),
    }
    with pytest.raises(ValueError):
        audit.changes(before, after.drop("b"), ["id"], "T")


def test_a_wrong_count_aborts_and_leaves_nothing(spark, tmp_path):
    rows = spark.range(3)
    audit.write_exactly(rows, f"file://{tmp_path}/good", 3)
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 3
    with pytest.raises(audit.WrongCount):
        audit.write_exactly(rows, f"file://{tmp_path}/bad", 1)
    assert not (tmp_path / "bad").exists()


def test_gaps_at_both_ends_and_expiry(spark):
    now = datetime(2024, 1, 1)
    soon, past = now + timedelta(1), now - timedelta(1)
    sessions = [(1, "UPLOADING", 95, 10, soon), (2, "INITIATED", 20, 10, soon), (3, "UPLOADING", 20, 10, past), (4, "INITIATED", 7, None, soon), (5, "VERIFIED", 20, 10, past), (6, "UPLOADING", 20, 10, soon), (7, "INITIATED", 20, 10, now)]
    parts = [(1, p, 10) for p in (2, 3, 3, 6, 99, 0)] + [(2, 1, 10), (2, 2, 10), (4, 1, 7), (6, 1, 10), (6, 2, 9), (8, 1, 1)]
    df = uploads.states(spark.createDataFrame(sessions, "session_id int, status string, expected_size int, part_size int, expires_at timestamp"), spark.createDataFrame(parts, "session_id int, part_number int, size int"), F.lit(now))
    got = {r["session_id"]: (r["state"], [tuple(x) for x in r["missing"]]) for r in df.collect()}
    assert got == {1: ("UPLOADING", [(1, 1), (4, 5), (7, 10)]), 2: ("UPLOADED", []), 3: ("ABORTED", [(1, 2)]), 4: ("UPLOADED", []), 5: ("VERIFIED", [(1, 2)]), 6: ("FAILED", []), 7: ("INITIATED", [(1, 2)])}


def test_own_keys_are_counted_without_a_sort_and_long_keys_stay_apart(spark):
    rows = spark.createDataFrame([("x", "1:2", "3"), ("x", "1", "2:3"), ("y", "1", "2:3"), ("z", None, "q")], "id string, a string, b string")
    own = constraints.repeated(rows, [constraints.Unique("pkey", ("id",))])
    assert "SortAggregate" not in own._jdf.queryExecution().executedPlan().toString()
    got = constraints.repeated(rows, [constraints.Unique("pkey", ("id",)), constraints.Unique("both", ("a", "b"))])
    assert sorted(map(tuple, got.collect())) == [("both", "x", 2), ("pkey", "x", 2)]
