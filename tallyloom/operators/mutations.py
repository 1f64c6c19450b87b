"""Changes to tables as new tables: every result is computed whole and written once by the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_a_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """The first row of each key by an order, by all other columns in turn if none is given; rows with a null in their key are left out.

    As an aggregate, not a window: a key that most rows have is one row a task.
    """
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order or [F.col(c) for c in rest] or [F.lit(0)])])
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest) if rest else F.lit(0), by).alias("first_"))
    return first.select(*[F.col(c) if c in keys else F.col("first_")[c].alias(c) for c in rows.columns])


def rejected(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that ``one_a_key`` doesn't take whole, with ``n_rows``: repeated ones, and those with a null."""
    null = F.greatest(F.lit(False), *(F.col(k).isNull() for k in keys))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | null)


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """The table and those rows whose key it lacks, one a key: a key is unique, as the first row of it is put in and others are refused."""
    return table.unionByName(one_a_key(rows, keys, order).join(table, list(keys), "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """The table with rows of the same key replaced and others added; of several rows of one key the first by the order counts."""
    rows = one_a_key(rows, keys, order)
    return table.join(rows, list(keys), "left_anti").unionByName(rows)


def replace_children(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All rows of each parent that ``rows`` names are deleted, then ``rows`` are inserted."""
    return table.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows)


def update(table: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """The table with some columns changed where a condition holds; ``changed`` says in which rows."""
    got = table.withColumn("changed", F.coalesce(where, F.lit(False)))
    return got.withColumns({k: F.when(F.col("changed"), v).otherwise(F.col(k)) for k, v in changes.items()})


def next_sort(rows: DataFrame, group: str, order: str, step: int = 10) -> DataFrame:
    """For each group the sort order that a further row gets."""
    return rows.groupBy(group).agg((F.coalesce(F.max(order), F.lit(0)) + step).alias("next_sort"))
