"""Validation of JSON request bodies: every problem of every field, by its path.

A body is parsed once into a variant. Each rule looks at one path and gives the first thing that is wrong there, as
``path: problem``; all paths' problems come together as an array, in the rules' order. A body that isn't JSON, or not an object, has that
one problem. Fields that no rule names are ignored.

Problems are REQUIRED (absent; null where a value is needed), TYPE (another JSON type than asked for), INTEGER, MIN, MAX (a number's bounds), TOO_SHORT,
TOO_LONG, LENGTH (a text's), PATTERN and DOMAIN.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import trim_all
from tallyloom.sources.schemas import BODY_PERIODS, BODY_VALUES, NATURES, STATEMENTS

NUMBER, TEXT, FLAG, OBJECT = "number", "text", "flag", "object"


@dataclass(frozen=True)
class Rule:
    """What a path must hold. ``trim``: a text is looked at without white space around it. ``coerced``: a text that reads as a
    number counts as one. ``within``: a path that must be an object for this rule to be asked at all."""

    path: str
    kind: str
    required: bool = True
    integer: bool = False
    low: float | None = None
    high: float | None = None
    shortest: int | None = None
    longest: int | None = None
    exact: int | None = None
    pattern: str | None = None
    domain: Sequence[str] = ()
    trim: bool = False
    coerced: bool = False
    within: str | None = None


def json_type(schema: Column) -> Column:
    """number, text, flag, object, array or null, of a variant's schema; NULL where there is none."""
    number = schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(schema.isNull(), None).when(number, NUMBER).when(schema == "STRING", TEXT).when(schema == "BOOLEAN", FLAG).when(schema.startswith("OBJECT"), OBJECT).when(schema.startswith("ARRAY"), "array").otherwise("null")


def problem(rule: Rule, kind: Column, text: Column, within: Column | None) -> Column:
    """The first problem at a rule's path, or null, by the value's JSON type and text, and its parent's type."""
    seen = trim_all(text) if rule.trim else text
    number = text.try_cast("double")
    if rule.coerced:
        number = F.when(kind == TEXT, F.when(trim_all(text) == "", 0.0).otherwise(trim_all(text).try_cast("double"))).when(kind == FLAG, F.when(text == "true", 1.0).otherwise(0.0)).when(kind == "null", 0.0).when(kind == NUMBER, number)
    out = F.when(kind.isNull(), F.lit("REQUIRED") if rule.required else None)
    out = out.when(number.isNull() | F.isnan(number), "TYPE") if rule.coerced else out.when(kind != rule.kind, "TYPE")
    for wrong, name in (
        (rule.integer and (F.floor(number) != number), "INTEGER"), (rule.low is not None and (number < F.lit(rule.low)), "MIN"), (rule.high is not None and (number > F.lit(rule.high)), "MAX"),
        (rule.exact is not None and (F.length(seen) != F.lit(rule.exact)), "LENGTH"), (rule.shortest is not None and (F.length(seen) < F.lit(rule.shortest)), "TOO_SHORT"), (rule.longest is not None and (F.length(seen) > F.lit(rule.longest)), "TOO_LONG"),
        (rule.pattern is not None and ~seen.rlike(rule.pattern or ""), "PATTERN"), (bool(rule.domain) and ~seen.isin(*rule.domain), "DOMAIN"),
    ):
        if wrong is not False:
            out = out.when(wrong, name)
    if within is not None:
        out = F.when(within == OBJECT, out)
    return F.when(out.isNotNull(), F.concat(F.lit(f"{rule.path}: "), out))


def checked(rows: DataFrame, rules: Sequence[Rule], column: str = "body") -> DataFrame:
    """Rows with ``errors``, an array of problems that is empty for a valid body.

    A body is parsed once, and each path is looked up once for its type and once for its text; rules only see those.
    """
    names = ["parsed_", "raw_", "kinds_"]
    while set(names) & set(rows.columns):
        names = [n + "_" for n in names]
    body, raw, kinds = map(F.col, names)
    at = {r.path: f"p{i}" for i, r in enumerate(rules)}
    look = lambda path: F.try_variant_get(body, f"$.{path}", "variant")
    got = rows.withColumn(names[0], F.try_parse_json(column))
    got = got.withColumn(names[1], F.struct(F.schema_of_variant(body).alias("whole"), *(F.schema_of_variant(look(p)).alias(n) for p, n in at.items()), *(F.try_variant_get(body, f"$.{p}", "string").alias(f"t{n}") for p, n in at.items())))
    got = got.withColumn(names[2], F.struct(*(json_type(raw[n]).alias(n) for n in ("whole", *at.values()))))
    whole = F.when(kinds["whole"].isNull(), F.array(F.lit("body: JSON"))).when(kinds["whole"] != OBJECT, F.array(F.lit("body: TYPE")))
    found = [problem(r, kinds[at[r.path]], raw[f"t{at[r.path]}"], kinds[at[r.within]] if r.within else None) for r in rules]
    return got.withColumn("errors", whole.otherwise(F.array_compact(F.array(*found)))).drop(*names)


# The rules of the three bodies.
REPORT = (
    Rule("companyId", TEXT, shortest=1), Rule("year", NUMBER, integer=True, low=2000, high=2100), Rule("periodType", TEXT, domain=BODY_PERIODS), Rule("audited", FLAG, required=False), Rule("sourceFile", TEXT, required=False, longest=255), Rule("values", OBJECT),
    *(Rule(f"values.{code}", NUMBER, within="values") for code in BODY_VALUES),
)
COMPANY = (
    Rule("ticker", TEXT, trim=True, shortest=1, longest=12), Rule("name", TEXT, trim=True, shortest=2), Rule("sector", TEXT, required=False), Rule("subsector", TEXT, required=False), Rule("country", TEXT, required=False, trim=True, shortest=2, longest=2),
    Rule("currency", TEXT, required=False, trim=True, exact=3), Rule("fiscalYearEnd", NUMBER, required=False, integer=True, low=1, high=12, coerced=True),
)
ACCOUNT = (
    Rule("code", TEXT, trim=True, shortest=2, longest=50, pattern="^[A-Z0-9_]+$"), Rule("name", TEXT, trim=True, shortest=2, longest=160), Rule("description", TEXT, required=False, trim=True, longest=500), Rule("statementType", TEXT, domain=STATEMENTS),
    Rule("valueNature", TEXT, domain=NATURES), Rule("normalBalance", TEXT, required=False, domain=("DEBIT", "CREDIT")),
)


def reports(rows: DataFrame, column: str = "body") -> DataFrame:
    return checked(rows, REPORT, column)


def companies(rows: DataFrame, column: str = "body") -> DataFrame:
    """With ``errors``, and the fields as they are stored: trimmed, in capitals, defaults filled in; null where the body is invalid."""
    got = checked(rows, COMPANY, column)
    body = F.try_parse_json(column)
    text = lambda path, default=None: F.coalesce(F.upper(trim_all(F.try_variant_get(body, f"$.{path}", "string"))), F.lit(default))
    good = F.size("errors") == 0
    stored = {"ticker": text("ticker"), "country": text("country", "ID"), "currency": text("currency", "IDR")}
    return got.withColumns({k: F.when(good, v) for k, v in stored.items()})


def accounts(rows: DataFrame, column: str = "body") -> DataFrame:
    return checked(rows, ACCOUNT, column)
