"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripting runtimes trim it; Spark's own trim only takes spaces.
SPACE = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"^{SPACE}+|{SPACE}+$", "")


def label_key(x: Column | str) -> Column:
    """A reported label: lower case, signs to spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def mapping_key(x: Column | str) -> Column:
    """A mapping's label: trimmed before signs become spaces, so one may stand at the end."""
    return F.regexp_replace(trim_all(F.lower(col(x))), "[^a-z0-9]+", " ")


def issuer_key(x: Column | str) -> Column:
    """An issuer's ticker or name: letters and digits only; null as empty."""
    return F.regexp_replace(F.lower(trim_all(F.coalesce(col(x), F.lit("")))), "[^a-z0-9]", "")


def staged_label(x: Column | str, most: int = 500) -> Column:
    return F.substring(F.lower(trim_all(x)), 1, most)


def code_key(x: Column | str) -> Column:
    return F.regexp_replace(F.upper(trim_all(x)), r"\s+", "_")


def unquoted(x: Column | str) -> Column:
    return F.regexp_replace(col(x), '^"|"$', "")


def cut(x: Column | str, most: int) -> Column:
    return F.substring(col(x), 1, most)


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null stays null, although least and greatest skip nulls."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(col(a), col(b))


def first_given(*xs: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(x), F.lit("")) for x in xs])


def first_nonzero(*xs: Column | str) -> Column:
    """The first that is neither null nor 0."""
    return F.coalesce(*[F.nullif(col(x), F.lit(0)) for x in xs])


def finite(x: Column | str) -> Column:
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ordinal(x: Column | str, domain: Sequence[str]) -> Column:
    """A value's place in its domain from 1, 0 outside."""
    return F.array_position(F.array(*map(F.lit, domain)), col(x)).cast("int")


def choose(x: Column | str, cases: Mapping[str, str], other: Column | None = None) -> Column:
    out = F
    for k, v in cases.items():
        out = out.when(col(x) == k, F.lit(v))
    return out.otherwise(other) if other is not None else out


def period_end(year: Column | str, period: Column | str) -> Column:
    """Last day of a reporting period; months and anything else end with the year."""
    month = F.when(col(period) == "Q1", 3).when(col(period) == "H1", 6).when(col(period) == "Q3", 9).otherwise(12)
    return F.last_day(F.make_date(col(year).cast("int"), month, F.lit(1)))


def flag(x: Column | str, default: bool = False, name: str | None = None) -> Column:
    """A switch's text as a boolean. One that isn't a switch's is null, or with the switch's ``name`` given an error that says so."""
    x = F.lower(trim_all(F.coalesce(col(x), F.lit(""))))
    out = F.when(x == "", F.lit(default)).when(x.isin("1", "true", "yes", "on"), F.lit(True)).when(x.isin("0", "false", "no", "off"), F.lit(False))
    return out if name is None else out.otherwise(F.raise_error(F.lit(f"{name} must be one of true/false, 1/0, yes/no, or on/off.")).cast("boolean"))


def friendly_status(x: Column | str) -> Column:
    return F.when(col(x) == "PENDING_REVIEW", "NEED REVIEW").otherwise(F.replace(col(x), F.lit("_"), F.lit(" ")))


def action_label(x: Column | str) -> Column:
    x = col(x)
    return F.when(x == "COMMITTED", "View Review Audit").when(x == "READY_TO_COMMIT", "Final Review").when(x == "FAILED", "Error Details").when(x.isin("PROCESSING", "UPLOADED"), "AI Processing…").otherwise("Continue Review")


def badge_style(x: Column | str) -> Column:
    """The first style whose name a status has, or begins with before an underscore."""
    x = F.upper(F.replace(col(x), F.lit(" "), F.lit("_")))
    names = ("NEED_REVIEW", "READY_TO_COMMIT", "COMMITTED", "FAILED", "PENDING", "ACCEPTED", "REJECTED")
    out = F
    for n in names:
        out = out.when((x == n) | x.startswith(f"{n}_"), n)
    return out.otherwise("NEUTRAL")


def job_state(x: Column | str) -> Column:
    """A provider's state as a job status."""
    return F.when(col(x).isin("queued", "in_progress"), "PROCESSING").otherwise(F.upper(col(x)))


def grouped_number(x: Column | str) -> Column:
    """A number with points between thousands and a comma before decimals."""
    return F.translate(F.regexp_replace(F.format_number(col(x), 3), r"\.?0+$", ""), ",.", ".,")


def fixed_text(x: Column | str, digits: int) -> Column:
    """A number below 2^63 with so many decimals, rounded by its exact binary value, halves away from zero.

    Spark's own formats round the decimal form. Here the fraction's product with a power of ten is kept in two
    doubles, the rounded product and its exact error, which alone decides where the first ends in a half.
    """
    x, scale = col(x).cast("double"), float(10**digits)
    whole = F.floor(F.abs(x))
    part = F.abs(x) - whole
    high = part * 134217729.0 - (part * 134217729.0 - part)  # the upper half of the fraction's bits
    product = part * scale
    error = (high * scale - product) + (part - high) * scale
    rest = product - F.floor(product)
    n = F.floor(product) + F.when((rest > 0.5) | ((rest == 0.5) & (error >= 0)), 1).otherwise(0)
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, (whole + F.when(n == int(scale), 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % int(scale)).cast("string"), digits, "0"))
