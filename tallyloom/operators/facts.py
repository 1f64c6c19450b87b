"""Canonical facts of reports: from line items, as long rows, and widened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("company", "year", "period_ord", "period")
CODES = ("REV", "COGS", "OPERATING_PROFIT", "NET_PROFIT", "OCF", "TOTAL_ASSETS", "TOTAL_LIAB", "EQUITY", "AR", "CASH", "INV", "AP", "TOTAL_DEBT", "CAPEX", "FINANCE_COST", "CURRENT_ASSETS", "CURRENT_LIAB")
YTD = ("Q1", "H1", "Q3", "FY")


def _sum(value: str, when: str | None = None) -> Column:
    return F.sum(value if when is None else F.when(F.expr(when), F.col(value)))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Year-to-date facts of each supplier, year and period, one column a code, as doubles.

    Sums are exact decimals. Only three sums for each quarter and pair of flags are made of the rows, before the shuffle. What
    comes out is then dealt by company and year; later periods repeat it within a task, and later groups and windows by company
    and year need no other shuffle.
    """
    e = F.col("l_extendedprice").cast("decimal(18,2)")
    base = lineitem.select(
        F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
        e.alias("e"), (e * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("n"), (e * F.col("l_tax").cast("decimal(4,2)")).alias("t"),
    )
    quarters = base.groupBy("company", "year", "quarter", "rf", "ls").agg(*[F.sum(c).alias(c) for c in ("e", "n", "t")])
    spread = quarters.repartition("company", "year").withColumn("period_ord", F.explode(F.sequence("quarter", F.lit(4))))
    parts = {
        "rev": _sum("n"), "cogs": _sum("n", "rf <> 'R'"), "op": _sum("n", "rf = 'R' AND ls = 'F'"), "tax_r": _sum("t", "rf = 'R'"),
        "ocf_n": _sum("n", "rf = 'R' AND ls = 'O'"), "e_all": _sum("e"), "e_liab": _sum("e", "rf <> 'N'"), "e_n": _sum("e", "rf = 'N'"),
        "ar": _sum("e", "ls = 'O' AND rf = 'N'"), "cash": _sum("e", "rf = 'N' AND ls = 'F'"), "inv": _sum("e", "rf = 'A' AND ls = 'O'"),
        "ap": _sum("e", "rf = 'R' AND ls = 'O'"), "debt": _sum("e", "rf = 'A'"), "capex": _sum("t", "rf = 'A'"), "interest": _sum("t", "rf = 'R' AND ls = 'F'"),
        "ca": _sum("e", "ls = 'O'"), "cl": _sum("e", "rf = 'R'"),
    }
    sums = spread.groupBy("company", "year", "period_ord").agg(*[v.alias(k) for k, v in parts.items()])
    share = "CAST(CASE company % 7 WHEN 0 THEN 0.01 WHEN 1 THEN 0.002 WHEN 2 THEN 0.0005 ELSE 0 END AS DECIMAL(5,4))"
    value = {
        "REV": "rev", "COGS": "cogs", "OPERATING_PROFIT": "op", "NET_PROFIT": "op - tax_r", "OCF": "ocf_n - tax_r", "TOTAL_ASSETS": "e_all", "TOTAL_LIAB": "e_liab", "EQUITY": f"e_n + e_all * {share}",
        "AR": "ar", "CASH": "cash", "INV": "inv", "AP": "ap", "TOTAL_DEBT": "debt", "CAPEX": "capex", "FINANCE_COST": "interest", "CURRENT_ASSETS": "ca", "CURRENT_LIAB": "cl",
    }
    period = F.element_at(F.array(*map(F.lit, YTD)), F.col("period_ord"))
    return sums.select("company", "year", "period_ord", period.alias("period"), *[F.expr(f"CAST({value[c]} AS DOUBLE)").alias(c) for c in CODES])


def to_long(wide: DataFrame, codes: Sequence[str] = CODES, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each code that has a value. Rows stay in their partitions, so groups by the same keys need no other shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("value")) for c in codes])
    return wide.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull())


def to_wide(long: DataFrame, codes: Sequence[str] = CODES, keys: Sequence[str] = KEYS, scaled: bool = False) -> DataFrame:
    """One column for each code of a fixed list, one group a report rather than one for each of its codes. ``scaled``: values times their row's ``scale``, which plain reading ignores."""
    value = F.col("value") * F.coalesce(F.nullif("scale", F.lit(0)), F.lit(1)) if scaled else F.col("value")
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("code") == c, value)).alias(c) for c in codes])


def standalone_quarters(long: DataFrame, flows: Sequence[str]) -> DataFrame:
    """Single quarters of flow codes: the year to date less the year to date before it.

    Where the period before is missing, nothing can be told and the value is null.
    """
    w = Window.partitionBy("company", "year", "code").orderBy("period_ord")
    before, prev = F.lag("value").over(w), F.lag("period_ord").over(w)
    value = F.when(F.col("period_ord") == 1, F.col("value")).when(prev == F.col("period_ord") - 1, F.col("value") - before)
    return long.where(F.col("code").isin(*flows)).select("company", "year", "period_ord", F.concat(F.lit("Q"), "period_ord").alias("quarter"), "code", value.alias("value"))


def growth(wide: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Change of each code against the same period of the year before; null without one, or if it was 0."""
    w = Window.partitionBy("company", "period").orderBy("year")
    fits = F.lag("year").over(w) == F.col("year") - 1
    out = [F.when(fits, F.try_divide(F.col(c) - F.lag(c).over(w), F.abs(F.lag(c).over(w)))).alias(f"{c.lower()}_growth") for c in codes]
    return wide.select(*KEYS, *out)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")
