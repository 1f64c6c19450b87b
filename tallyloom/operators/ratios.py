"""Ratios of a report's facts, one row a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import ratio


def library(wide: DataFrame) -> DataFrame:
    """The fifteen ratios; null where a denominator is 0. The cash cycle takes a missing part as 0."""
    c = F.col
    days = lambda a, b: ratio(c(a) * 365, b)
    return wide.withColumns({
        "gross_margin": ratio(c("REV") - c("COGS"), "REV"),
        "operating_margin": ratio("OPERATING_PROFIT", "REV"),
        "net_margin": ratio("NET_PROFIT", "REV"),
        "roa": ratio("NET_PROFIT", "TOTAL_ASSETS"),
        "roe": ratio("NET_PROFIT", "EQUITY"),
        "current_ratio": ratio("CURRENT_ASSETS", "CURRENT_LIAB"),
        "debt_to_equity": ratio("TOTAL_DEBT", "EQUITY"),
        "net_debt": c("TOTAL_DEBT") - c("CASH"),
        "interest_coverage": ratio("OPERATING_PROFIT", "FINANCE_COST"),
        "ocf_to_net_profit": ratio("OCF", "NET_PROFIT"),
        "free_cash_flow": c("OCF") - c("CAPEX"),
        "receivable_days": days("AR", "REV"),
        "inventory_days": days("INV", "COGS"),
        "payable_days": days("AP", "COGS"),
        "cash_conversion_cycle": F.coalesce(days("AR", "REV"), F.lit(0.0)) + F.coalesce(days("INV", "COGS"), F.lit(0.0)) - F.coalesce(days("AP", "COGS"), F.lit(0.0)),
    })


LIBRARY = ("gross_margin", "operating_margin", "net_margin", "roa", "roe", "current_ratio", "debt_to_equity", "net_debt", "interest_coverage", "ocf_to_net_profit", "free_cash_flow", "receivable_days", "inventory_days", "payable_days", "cash_conversion_cycle")
#: The analysis page's ratios: numerator, denominator, factor, unit, and the bound of a healthy value.
PAGE = {
    "Net Profit Margin": ("NET_PROFIT", "REV", 100.0, "%", ">", 10.0),
    "ROE": ("NET_PROFIT", "EQUITY", 100.0, "%", ">", 12.0),
    "ROA": ("NET_PROFIT", "TOTAL_ASSETS", 100.0, "%", ">", 5.0),
    "Debt to Equity": ("TOTAL_LIAB", "EQUITY", 1.0, "x", "<", 1.0),
    "Liabilities / Assets": ("TOTAL_LIAB", "TOTAL_ASSETS", 100.0, "%", "<", 60.0),
    "OCF / Net Profit": ("OCF", "NET_PROFIT", 1.0, "x", ">=", 1.0),
}


def _page(name: str) -> Column:
    a, b, times, *_ = PAGE[name]
    return F.when(F.col(b).isNotNull() & (F.col(b) != 0), F.try_divide(F.col(a), F.col(b)) * times)


def page(wide: DataFrame) -> DataFrame:
    """The page's six ratios as columns."""
    return wide.withColumns({f"r{i}": _page(name) for i, name in enumerate(PAGE, 1)})


def health(wide: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row a report and ratio, with its verdict; a missing ratio is to be monitored."""
    rows = []
    for name, (*_, unit, sign, bound) in PAGE.items():
        x = _page(name)
        good = {">": x > bound, "<": x < bound, ">=": x >= bound}[sign]
        rows.append(F.struct(F.lit(name).alias("ratio"), x.alias("value"), F.lit(unit).alias("unit"), F.when(x.isNotNull() & good, "Healthy").otherwise("Monitor").alias("verdict")))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")
