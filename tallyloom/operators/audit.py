"""What changed between two states of a table, as rows of an audit log, and writes that must change a given number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], entity: str, actor: Column | str = "system") -> DataFrame:
    """One row for each key that was added, removed or changed: ``action``, ``fields`` that differ, and both sides as JSON of those fields.

    Both tables have the same columns. Rows of both sides are grouped by key in one shuffle, which a null in a key passes as any other
    value, so no join is needed. Keys are unique in each table. Nulls in fields are equal to each other, and appear in the JSON.
    ``fields`` is a map from each field that differs to its two values as text.
    """
    columns = [c for c in before.columns if c not in keys]
    if set(before.columns) != set(after.columns):
        raise ValueError("both states of a table need the same columns")
    text = lambda c: F.col(c).cast("string")
    side = lambda df, name, other: df.select(*keys, F.struct(*(text(c).alias(c) for c in columns)).alias(name), F.lit(None).cast(f"struct<{','.join(f'`{c}`:string' for c in columns)}>").alias(other))
    both = side(before, "old_", "new_").unionByName(side(after, "new_", "old_")).groupBy(*keys).agg(F.first("old_", True).alias("old_"), F.first("new_", True).alias("new_"))
    differ = lambda c: F.when(~F.col("old_")[c].eqNullSafe(F.col("new_")[c]), F.struct(F.lit(c).alias("key"), F.struct(F.col("old_")[c].alias("before"), F.col("new_")[c].alias("after")).alias("value")))
    fields = F.map_from_entries(F.array_compact(F.array(*map(differ, sorted(columns)))))
    action = F.when(F.col("old_").isNull(), "INSERT").when(F.col("new_").isNull(), "DELETE").otherwise("UPDATE")
    got = both.withColumns({"action": action, "fields": fields}).where((F.col("action") != "UPDATE") | (F.size("fields") > 0))
    entries = lambda part: F.to_json(F.map_from_arrays(F.map_keys("fields"), F.transform(F.map_values("fields"), lambda x: x[part])), {"ignoreNullFields": "false"})
    return got.select(
        *keys, F.lit(entity).alias("entity"), F.concat_ws("/", *(F.coalesce(text(k), F.lit("")) for k in keys)).alias("entity_id"), "action", (F.lit(actor) if isinstance(actor, str) else actor).alias("actor"), "fields",
        F.when(F.col("action") != "INSERT", entries("before")).alias("before"), F.when(F.col("action") != "DELETE", entries("after")).alias("after"),
    )


class WrongCount(ValueError):
    """A change met another number of rows than it must."""


def write_exactly(rows: DataFrame, path: str, n: int) -> None:
    """Write rows that must be exactly ``n``, counted on the way; otherwise what was written is deleted, and it is an error.

    The count comes with the write itself, so rows are computed once. Nobody reads the folder before this returns.
    """
    seen = Observation("rows")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    if seen.get["n"] != n:
        spark = rows.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        raise WrongCount(f"{seen.get['n']} rows in place of {n}")
