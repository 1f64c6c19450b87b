"""Data-quality rules over reports. The three balance tolerances and two cash limits differ on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import finite, ratio



def assets() -> Column:
    return F.col("TOTAL_ASSETS")


def claims_on_assets() -> Column:
    return F.col("TOTAL_LIAB") + F.col("EQUITY")


def gap() -> Column:
    return F.abs(assets() - F.col("TOTAL_LIAB") - F.col("EQUITY"))


def _sure(x: Column) -> Column:
    """True or false; what can't be told is false."""
    return F.coalesce(x, F.lit(False))


def library_balance() -> Column:
    """Assets differ from liabilities and equity by more than a thousandth of assets, and more than 1."""
    return _sure(~F.isnan(assets()) & (F.abs(assets() - claims_on_assets()) > F.greatest(F.lit(1.0), assets() * 0.001)))


def library_cash() -> Column:
    return _sure((F.col("NET_PROFIT") > 0) & (ratio("OCF", "NET_PROFIT") < 0.6))


def assets_invalid() -> Column:
    return ~finite(assets()) | (assets() <= 0)


def receivable_divergence(wide: DataFrame) -> DataFrame:
    """Reports whose revenue fell while receivables rose by over a tenth, against the report a row before
    in the same kind of period; a former value that is missing or 0 says nothing."""
    w = Window.partitionBy("company", "period").orderBy("year")
    got = wide.withColumns({"prev_rev": F.lag("REV").over(w), "prev_ar": F.lag("AR").over(w)})
    return got.where((F.col("prev_rev") != 0) & (F.col("prev_ar") != 0) & (F.col("REV") < F.col("prev_rev")) & (F.col("AR") > F.col("prev_ar") * 1.1))


def manual_warnings() -> Column:
    """Warnings of a report that is entered by hand, as an array of code, severity and gap."""
    mismatch = _sure(gap() > F.greatest(F.abs(assets()) * 0.005, F.lit(1.0)))
    low = _sure((F.col("NET_PROFIT") > 0) & (F.col("OCF") < F.col("NET_PROFIT") * 0.5))
    made = lambda ok, code, severity, value: F.when(ok, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), value.alias("gap")))
    return F.array_compact(F.array(made(mismatch, "BALANCE_MISMATCH", "HIGH", gap()), made(low, "LOW_CASH_CONVERSION", "MEDIUM", F.lit(None).cast("double"))))


def manual_status() -> Column:
    return F.when(F.size(manual_warnings()) > 0, "PENDING_REVIEW").otherwise("VERIFIED")


def commit_blocked() -> Column:
    """The commit gate: a ten-thousandth of assets, and only if all three are there."""
    return assets().isNotNull() & claims_on_assets().isNotNull() & _sure(gap() > F.greatest(F.abs(assets()) * 0.0001, F.lit(1.0)))


def cash_flow_gap(wide: DataFrame) -> DataFrame:
    """Operating, investing and financing flows against the change in cash."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("OCF", "ICF", "CFF")), F.lit(0.0))
    return wide.withColumn("cash_gap", total - F.col("NET_CHANGE_CASH"))


def jumps(wide: DataFrame, code: str, times: float) -> DataFrame:
    """Reports where a code is more than ``times`` the year before's, or less than its ``times``-th part."""
    w = Window.partitionBy("company", "period").orderBy("year")
    prev = F.lag(code).over(w)
    return wide.withColumn("before", prev).where((F.col("before") > 0) & ((F.col(code) > F.col("before") * times) | (F.col(code) * times < F.col("before"))))


# -- integrity of tables


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is given but not in the parent table."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def repeated_keys(rows: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys that several rows have, of all rows or of those where the partial constraint holds."""
    rows = rows if where is None else rows.where(where)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def failed_checks(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """``key`` and ``check`` of every row check that is false; as in SQL, unknown passes."""
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]))
    return rows.select(key, F.explode(failed).alias("check_name"))
