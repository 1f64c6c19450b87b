"""Rules that look across a report's entries, its years and its company: outliers, currency, unit, and derived facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A deviation of normal values is about so many median deviations; a value is far off beyond ``TIMES`` of them.
NORMAL, TIMES = 1.4826, 3.5
#: Values of a percentile sketch; groups of fewer values get exact medians.
ACCURACY = 10_000
#: A jump by a power of a thousand may be off by this factor, since the year's own growth is in it.
OFF = 5.0


def outliers(long: DataFrame, keys: Sequence[str] = ("company", "code"), value: str = "value", times: float = TIMES, least: int = 5) -> DataFrame:
    """Rows further from their group's median than ``times`` of its normal deviation, with both and the ``score``.

    The deviation is the median of distances from the median, so a few wild values don't widen it. Both medians are
    percentile sketches with partial aggregation: a group of any size is never in one place, and two rounds of a small
    aggregate are joined back. Groups of fewer than ``least`` values, and those more than half of whose values are equal, have no outliers.
    """
    rows = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    middle = rows.groupBy(*keys).agg(F.percentile_approx(value, 0.5, ACCURACY).alias("median"), F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") >= least)
    far = F.abs(F.col(value) - F.col("median"))
    with_middle = rows.join(middle, list(keys))
    spread = with_middle.groupBy(*keys).agg(F.percentile_approx(far, 0.5, ACCURACY).alias("deviation")).where("deviation > 0")
    got = with_middle.join(spread, list(keys)).withColumn("score", far / (F.col("deviation") * NORMAL))
    return got.where(F.col("score") > times)


def most_common(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Each group's most common given value, the smallest of equally common ones, with ``n_values`` different ones.

    Counted by value first, so that a large group is summed before it meets.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n_"))
    best = F.min(F.struct((-F.col("n_")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*keys).agg(best["v"].alias(f"common_{column}"), F.count(F.lit(1)).alias("n_values"))


def power_of_thousand(value: Column, before: Column, off: float = OFF) -> Column:
    """By which power of a thousand a value jumped, between -3 and 3; 0 for none; null where nothing can be told."""
    ratio = F.abs(F.try_divide(value, before))
    out = F.when(ratio.isNull() | (ratio == 0), None)
    for k in (1, 2, 3):
        out = out.when((ratio > 1000.0**k / off) & (ratio < 1000.0**k * off), k).when((ratio < off / 1000.0**k) & (ratio > 1 / (1000.0**k * off)), -k)
    return out.otherwise(0)


def unit_and_currency(entries: DataFrame) -> DataFrame:
    """Entries that depart from their report's common currency or scale, or whose amount jumped by a power of a thousand.

    ``entries``: company, year, period, code, value, scale, currency, one for each report and code. ``rule`` is CURRENCY, SCALE or UNIT_JUMP,
    ``found`` what is there and ``expected`` what was: the common one, or for a jump the amount of the year before.
    A missing currency or scale isn't a departure; a scale of 0 counts as missing, amounts then as given.
    """
    report = ["company", "year", "period"]
    rows = entries.withColumn("scale", F.nullif("scale", F.lit(0)))
    w = Window.partitionBy("company", "period", "code").orderBy("year")
    amount = F.col("value") * F.coalesce("scale", F.lit(1))
    rows = rows.withColumn("amount", amount)
    rows = rows.withColumn("amount_before", F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("amount").over(w)))
    got = rows.join(most_common(rows, report, "currency").drop("n_values"), report, "left").join(most_common(rows, report, "scale").drop("n_values"), report, "left")
    jump = power_of_thousand(F.col("amount"), F.col("amount_before"))
    issue = lambda ok, rule, found, expected: F.when(ok, F.struct(F.lit(rule).alias("rule"), found.cast("string").alias("found"), expected.cast("string").alias("expected")))
    issues = F.array_compact(F.array(
        issue(F.col("currency") != F.col("common_currency"), "CURRENCY", F.col("currency"), F.col("common_currency")),
        issue(F.col("scale") != F.col("common_scale"), "SCALE", F.col("scale"), F.col("common_scale")),
        issue(jump != 0, "UNIT_JUMP", jump, F.lit(0)),
    ))
    return got.select(*report, "code", F.explode(issues).alias("i")).select(*report, "code", "i.rule", "i.found", "i.expected")


#: Version of the formulas below; it goes along with every derived fact.
CALCULATION = "standalone-1"
QUARTERS = ("Q1", "H1", "Q3", "FY")


def derived_quarters(facts: DataFrame, flows: Sequence[str], version: str = CALCULATION) -> DataFrame:
    """Single quarters of flow codes as derived facts, each with its formula, version, basis and source facts.

    ``facts``: fact_id, company, year, period_ord, code, value. A first quarter is the reported fact itself; others are the year to
    date less the one before, and there is no derived fact where that one is missing or either value is null.
    Reported facts are only read: nothing derived takes their place.
    """
    w = Window.partitionBy("company", "year", "code").orderBy("period_ord")
    before = F.lag(F.struct("fact_id", "period_ord", "value")).over(w)
    rows = facts.where(F.col("code").isin(*flows)).withColumn("before", before)
    follows = F.col("before.period_ord") == F.col("period_ord") - 1
    first = F.col("period_ord") == 1
    name = lambda at: F.get(F.array(*map(F.lit, QUARTERS)), at - 1)
    got = rows.where((first | follows) & F.col("value").isNotNull() & (first | F.col("before.value").isNotNull()))
    return got.select(
        "company", "year", F.concat(F.lit("Q"), "period_ord").alias("quarter"), "code", F.when(first, F.col("value")).otherwise(F.col("value") - F.col("before.value")).alias("value"),
        F.when(first, F.concat("code", F.lit("[Q1]"))).otherwise(F.concat("code", F.lit("["), name(F.col("period_ord")), F.lit("] - "), "code", F.lit("["), name(F.col("period_ord") - 1), F.lit("]"))).alias("formula"),
        F.lit(version).alias("version"), F.lit("STANDALONE").alias("basis"),
        F.when(first, F.array("fact_id")).otherwise(F.array("fact_id", "before.fact_id")).alias("source_ids"),
    )
