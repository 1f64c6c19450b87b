"""Rules against values worked out by hand."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import documents, facts, mutations, pipeline, quality, ratios, staging
from tallyloom.plans import catalog
from tallyloom.sources import readers, schemas

WIDE = "company long, year int, period_ord int, period string, " + ", ".join(f"{c} double" for c in facts.CODES)


def report(spark, **values):
    row = {"company": 1, "year": 2024, "period_ord": 4, "period": "FY"} | {c: None for c in facts.CODES} | values
    return spark.createDataFrame([tuple(row[c] for c in ("company", "year", "period_ord", "period", *facts.CODES))], WIDE)


FULL = dict(REV=1000.0, COGS=600.0, OPERATING_PROFIT=200.0, NET_PROFIT=150.0, TOTAL_ASSETS=2000.0, EQUITY=800.0, TOTAL_LIAB=1200.0, TOTAL_DEBT=500.0, CASH=100.0, OCF=180.0, CAPEX=60.0, FINANCE_COST=40.0, CURRENT_ASSETS=700.0, CURRENT_LIAB=350.0, AR=120.0, INV=90.0, AP=75.0)


def test_library_ratios(spark):
    got = ratios.library(report(spark, **FULL)).select(*ratios.LIBRARY).first()
    want = [0.4, 0.2, 0.15, 0.075, 0.1875, 2, 0.625, 400, 5, 1.2, 120, 43.8, 54.75, 45.625, 52.925]
    assert list(got) == pytest.approx(want, abs=1e-9)
    zero = ratios.library(report(spark, **dict.fromkeys(FULL, 0.0))).select(*ratios.LIBRARY).first().asDict()
    assert {k: v for k, v in zero.items() if v is not None} == {"net_debt": 0, "free_cash_flow": 0, "cash_conversion_cycle": 0}


def verdicts(spark, **values):
    got = ratios.health(report(spark, **values), facts.KEYS).collect()
    return {r["ratio"]: (r["value"], r["verdict"]) for r in got}


def test_page_ratios(spark):
    got = verdicts(spark, **FULL)
    assert {k: (round(v, 4), h) for k, (v, h) in got.items()} == {
        "Net Profit Margin": (15.0, "Healthy"), "ROE": (18.75, "Healthy"), "ROA": (7.5, "Healthy"), "Debt to Equity": (1.5, "Monitor"), "Liabilities / Assets": (60.0, "Monitor"), "OCF / Net Profit": (1.2, "Healthy"),
    }
    assert verdicts(spark, **FULL | {"REV": 0.0})["Net Profit Margin"] == (None, "Monitor")
    assert verdicts(spark, **FULL | {"EQUITY": -100.0, "TOTAL_LIAB": 50.0})["Debt to Equity"] == (-0.5, "Healthy")


@pytest.mark.parametrize(("gap", "library", "manual", "commit"), [(0, 0, 0, 0), (500, 0, 0, 1), (1000, 0, 0, 1), (2000, 1, 0, 1), (10000, 1, 1, 1)])
def test_balance_tolerances(spark, gap, library, manual, commit):
    df = report(spark, TOTAL_ASSETS=1e6, TOTAL_LIAB=4e5, EQUITY=6e5 - gap)
    got = df.select(quality.library_balance(), F.size(quality.manual_warnings()) > 0, quality.commit_blocked()).first()
    assert [int(x) for x in got] == [library, manual, commit]


def test_odd_values_in_checks(spark):
    got = report(spark, TOTAL_ASSETS=float("nan"), TOTAL_LIAB=1.0, EQUITY=1.0).select(quality.assets_invalid(), quality.library_balance()).first()
    assert list(got) == [True, False]
    assert list(report(spark, TOTAL_ASSETS=100.0, TOTAL_LIAB=50.0, EQUITY=49.5).select(quality.library_balance(), quality.commit_blocked()).first()) == [False, False]
    assert report(spark, TOTAL_ASSETS=100.0, EQUITY=1.0).select(quality.commit_blocked()).first()[0] is False


@pytest.mark.parametrize(("profit", "cash", "library", "manual"), [(100, 55, 1, 0), (100, 49, 1, 1), (-10, -50, 0, 0), (100, 60, 0, 0)])
def test_cash_rules(spark, profit, cash, library, manual):
    df = report(spark, NET_PROFIT=float(profit), OCF=float(cash))
    assert [int(x) for x in df.select(quality.library_cash(), F.size(quality.manual_warnings()) > 0).first()] == [library, manual]


@pytest.mark.parametrize(("rev", "ar", "prev", "fires"), [(900, 111, 1000, 1), (900, 110, 1000, 0), (900, 111, 0, 0), (1001, 120, 1000, 0)])
def test_receivable_divergence(spark, rev, ar, prev, fires):
    df = report(spark, year=2023, REV=float(prev), AR=100.0).unionByName(report(spark, REV=float(rev), AR=float(ar)))
    assert quality.receivable_divergence(df).count() == fires


def one(spark, text, *columns):
    return list(spark.createDataFrame([(text,)], "x string").select(*columns).first())


def test_normalizers(spark):
    x = "  Piutang Usaha – Pihak Ketiga (Neto) "
    assert one(spark, x, S.label_key("x"), S.mapping_key("x"), S.issuer_key("x"), S.staged_label("x")) == ["piutang usaha pihak ketiga neto", "piutang usaha pihak ketiga neto ", "piutangusahapihakketiganeto", "piutang usaha – pihak ketiga (neto)"]
    assert one(spark, " \tnet  sales\n", S.trim_all("x"), S.code_key("x")) == ["net  sales", "NET_SALES"]
    assert one(spark, None, S.issuer_key("x"), S.flag("x"), S.flag("x", True)) == ["", False, True]


def test_exact_rounding(spark):
    numbers = [1.005, 2.675, 12345.65, 0.35, 18.75, -0.5, None, 0.125, 0.375, -2.25, 0.995, 0.9999, -0.001, 0.0, 99.995, 1e15 + 0.25, *(k / 1000 for k in range(-2000, 2000, 7)), *(k / 7 for k in range(300))]
    for digits in (1, 2):
        got = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", S.fixed_text("x", digits).alias("t")).orderBy("i").collect()
        assert [r["t"] for r in got] == [None if x is None else str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in numbers]


@pytest.mark.parametrize(("code", "labels", "safe"), [
    ("AR", ["pihak ketiga", "related party"], True), ("AR", ["pihak ketiga", "third party"], False), ("AR", ["pihak ketiga", "third parties", "pihak berelasi"], True), ("AR", ["pihak ketiga", "other"], False), ("AR", ["other"], True),
    ("DEBT_ISSUED", ["short-term loan", "long term loan"], True), ("DEBT_ISSUED", ["short term", "overdraft"], False), ("DEBT_REPAID", ["shortterm", "jangka panjang", "bonds"], True), ("DEBT_REPAID", ["short-term", "long-term", "bonds", "notes"], False),
    ("REV", ["a", "b"], False), ("AP", ["third parties and related parties", "pihak berelasi"], True),
])
def test_safe_aggregation(spark, code, labels, safe):
    df = spark.createDataFrame([(1, code, x) for x in labels], "run_id long, code string, reported_label string")
    assert staging.safe_groups(df).first()["is_safe"] is safe


CANDIDATE = "run_id long, ord int, code string, reported_label string, raw_value string, numeric_value decimal(28,6), scale int, source_page int, extraction_confidence double, mapping_confidence double, currency string, source_text string"
RUN = "run_id long, currency string, company_currency string, unit_scale int"


def entry(spark, *rows):
    from decimal import Decimal

    made = [(1, i, "AR", lab, str(v), Decimal(v), scale, page, a, b, None, "said") for i, (lab, v, scale, page, a, b) in enumerate(rows)]
    return staging.commit_entries(spark.createDataFrame(made, CANDIDATE), schemas.accounts(spark), spark.createDataFrame([(1, "", "USD", None)], RUN)).first()


def test_commit_entries(spark):
    got = entry(spark, ("x", 100, 1_000_000, 12, 0.98, 0.9), ("y", 25, 1_000_000, 12, 0.95, None))
    assert (got["value"], got["scale"], got["source_page"], got["confidence"], got["raw_text"]) == (125, 1_000_000, 12, 0, "x: 100 (page 12) | y: 25 (page 12)")
    got = entry(spark, ("x", 100, 1_000_000, 12, 1.0, 1.0), ("y", 25, 1_000, 13, 1.0, 1.0))
    assert (got["value"], got["scale"], got["source_page"]) == (100_025_000, 1, None)
    assert (got["reported_label"], got["currency"]) == ("Accounts Receivable — aggregated from 2 reviewed components", "USD")
    assert entry(spark, ("own label", 5, 0, None, 1.0, 1.0))["reported_label"] == "own label"


def test_commit_falls_back_to_source_text_and_run(spark):
    rows = [(1, 0, "AR", "x", None, Decimal(1), None, None, 1.0, 1.0, "", "said"), (1, 1, "AR", "y", None, Decimal(2), None, None, 1.0, 1.0, "EUR", None), (2, 0, "NEW", "z", "3", Decimal(3), 5, 1, 1.0, 1.0, None, None)]
    runs = spark.createDataFrame([(1, "SGD", "USD", 0), (2, None, "USD", 7)], RUN)
    df = spark.createDataFrame(rows, CANDIDATE)
    got = {r["run_id"]: r for r in staging.commit_entries(df, schemas.accounts(spark), runs).collect()}
    assert (got[1]["raw_text"], got[1]["currency"], got[1]["value"], got[1]["scale"]) == ("said", "SGD", 3.0, 1)
    assert (got[2]["raw_text"], got[2]["currency"], got[2]["reported_label"]) == ("z: 3 (page 1)", "USD", "z")
    assert [tuple(r) for r in staging.commit_statements(df, schemas.accounts(spark), runs).collect()] == [(1, "BALANCE_SHEET", "SGD", 1)]
    notes = {(r["run_id"], r["ord"]): (r["status"], r["review_note"]) for r in staging.commit_candidates(df.withColumns({"status": F.lit("ACCEPTED"), "review_note": F.lit("old")})).collect()}
    assert notes == {(1, 0): ("COMMITTED", "Aggregated into canonical AR with reviewed 2 components."), (1, 1): ("COMMITTED", "Aggregated into canonical AR with reviewed 2 components."), (2, 0): ("COMMITTED", "old")}


def test_an_unknown_code_is_an_error(spark):
    df = spark.createDataFrame([("AR",), ("NOPE",), ("NEITHER",), (None,)], "code string")
    with pytest.raises(staging.UnknownCodes, match="3 codes.*NEITHER"):
        staging.accounts_of(df, schemas.accounts(spark))
    assert staging.accounts_of(df.where("code = 'AR'"), schemas.accounts(spark)).first()["account_name"] == "Accounts Receivable"


def test_a_key_is_put_in_once(spark):
    old = spark.createDataFrame([(1, "old")], "id int, name string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "a"), (None, "x"), (3, None)], "id int, name string")
    assert sorted(map(tuple, mutations.insert_new(old, new, ["id"]).collect()), key=str) == [(1, "old"), (2, "a"), (3, None)]
    assert sorted(map(tuple, mutations.upsert(old, new, ["id"], [F.col("name") != "c"]).collect()), key=str) == [(1, "b"), (2, "c"), (3, None)]
    assert sorted((r["id"] or 0, r["n_rows"]) for r in mutations.rejected(new, ["id"]).collect()) == [(0, 1), (2, 2)]


def test_a_bad_switch_is_an_error_where_it_has_a_name(spark):
    df = spark.createDataFrame([("maybe",)], "x string")
    assert df.select(S.flag("x")).first()[0] is None
    with pytest.raises(Exception, match="UPLOAD_V2 must be one of"):
        df.select(S.flag("x", name="UPLOAD_V2")).collect()


def test_period_ends(spark):
    df = spark.createDataFrame([(2024, p) for p in schemas.PERIODS], "y int, p string")
    assert [str(r[0]) for r in df.select(S.period_end("y", "p")).collect()] == ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31", "2024-12-31"]


def test_chunks(spark):
    assert one(spark, "aaaa\n\nbbbb\n \ncccccccccccccc", documents.chunks_of(F.col("x"), 10)) == [["aaaa\n\nbbbb", "c" * 10, "c" * 4]]
    rng = random.Random(0)
    for _ in range(30):
        text = "".join(rng.choice("ab \n\n") for _ in range(rng.randint(0, 80)))
        (got,) = one(spark, text, documents.chunks_of(F.col("x"), 12))
        assert "".join("".join(got).split()) == "".join(text.split()) and all(0 < len(c) <= 12 for c in got)


@pytest.mark.parametrize(("t", "f", "i", "mode"), [(3, 0, 0, "NATIVE_TEXT"), (3, 0, 9, "HYBRID"), (3, 0, 8, "NATIVE_TEXT"), (0, 2, 9, "HYBRID"), (10, 0, 20, "NATIVE_TEXT"), (10, 0, 21, "HYBRID"), (0, 1, 50, "VISION_OCR_FALLBACK"), (2, 1, 0, "VISION_OCR_FALLBACK")])
def test_preflight(spark, t, f, i, mode):
    body = b"\xe9" + b" BT" * t + b" /Font" * f + b" /Subtype /Image" * i + b" BTx /Fonts \xff"
    got = documents.preflight(spark.createDataFrame([(bytearray(body),)], "content binary"), documents.sample_text(F.col("content"))).first()
    assert (got["n_text"], got["n_font"], got["n_image"], got["mode"]) == (t, f, i, mode)


def test_files_are_read_and_known_by_their_first_bytes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 text")
    (tmp_path / "b.pdf").write_bytes(b"plain")
    got = readers.files(spark, f"file://{tmp_path}/*.pdf").select("size", documents.is_pdf(F.col("content")).alias("pdf"), "checksum").orderBy("size").collect()
    assert [(r["size"], r["pdf"], len(r["checksum"])) for r in got] == [(5, False, 64), (13, True, 64)]


@pytest.mark.parametrize(("company", "period", "year", "want"), [(0.95, 0.75, 2024, None), (0.949, 0.75, 2024, "COMPANY"), (0.95, 0.749, 2024, "PERIOD"), (None, 0.9, 2024, "COMPANY"), (1.0, None, 2024, "PERIOD"), (1.0, 1.0, None, "PERIOD")])
def test_gates(spark, company, period, year, want):
    df = spark.createDataFrame([("c", company, year, "H1", period)], "matched string, company_confidence double, detected_year int, detected_period string, period_confidence double")
    assert df.select(staging.gate()).first()[0] == want


def test_quarters_add_up_to_the_year(spark):
    long = spark.createDataFrame([(1, 2024, i, p, "REV", v) for i, (p, v) in enumerate(zip(facts.YTD, (10.0, 25.0, 45.0, 80.0)), 1)] + [(1, 2024, 4, "FY", "OCF", 9.0)], "company long, year int, period_ord int, period string, code string, value double")
    got = {(r["code"], r["quarter"]): r["value"] for r in facts.standalone_quarters(long, ("REV", "OCF")).collect()}
    assert got == {("REV", "Q1"): 10, ("REV", "Q2"): 15, ("REV", "Q3"): 20, ("REV", "Q4"): 35, ("OCF", "Q4"): None}


def test_scale_is_ignored_unless_asked_for(spark):
    long = spark.createDataFrame([(1, 2024, 4, "FY", "REV", 5.0, 1000)], "company long, year int, period_ord int, period string, code string, value double, scale int")
    assert facts.to_wide(long, ["REV"]).first()["REV"] == 5 and facts.to_wide(long, ["REV"], scaled=True).first()["REV"] == 5000


def test_pages():
    assert [pipeline.pages(*x) for x in [(0, 20), (20, 20), (21, 20), (10, 1), (1000, 999)]] == [1, 1, 2, 2, 20]


def test_tables_are_declared(spark):
    assert len(schemas.TABLES) == 20 and len(schemas.ACCOUNTS) == 46
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).count() == 0
    assert schemas.schema("FinancialEntry")["value"].dataType.simpleString() == "decimal(28,6)"
    assert not math.isnan(schemas.HISTORY[0][1])


def test_staged_rows_have_their_label_whole(spark):
    got = catalog.QUERIES["staged_values"](spark, "/root/testdata/sf0.001")
    assert {r["label"] for r in got.select("label").distinct().collect()} >= {"AFtext", "NOtext"}


def test_facts_are_widened_by_one_group_a_report(spark):
    rows = [(1, 2020, 4, "FY", "REV", 2.0), (1, 2020, 4, "FY", "CASH", float("nan")), (2, 2020, 4, "FY", "NOT_KNOWN", 1.0)]
    got = facts.to_wide(spark.createDataFrame(rows, "company long, year int, period_ord int, period string, code string, value double"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "pivotfirst" not in plan.lower()
    a, b = got.orderBy("company").collect()
    assert a["REV"] == 2.0 and math.isnan(a["CASH"]) and a["AP"] is None and b["REV"] is None
