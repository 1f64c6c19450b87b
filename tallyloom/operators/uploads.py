"""Upload sessions in parts: which parts are missing, what has expired, and the state that a session is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("INITIATED", "UPLOADING")


def missing_parts(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """Runs of part numbers that a session lacks: ``session_id``, ``first_missing`` and ``last_missing``.

    ``sessions``: session_id, n_expected; ``parts``: session_id, part_number. A session stands before its first part as number 0 and its end
    comes after the last, so gaps at both ends are gaps as others. Parts that come again or lie beyond the end count once or not.
    """
    every = sessions.select("session_id", "n_expected")
    known = parts.join(every, "session_id").where((F.col("part_number") > 0) & (F.col("part_number") <= F.col("n_expected"))).select("session_id", "n_expected", "part_number").distinct()
    rows = known.unionByName(every.withColumn("part_number", F.lit(0)))
    w = Window.partitionBy("session_id").orderBy("part_number")
    rows = rows.withColumn("next", F.coalesce(F.lead("part_number").over(w), F.col("n_expected") + 1))
    return rows.where(F.col("next") > F.col("part_number") + 1).select("session_id", (F.col("part_number") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"))


def states(sessions: DataFrame, parts: DataFrame, now: Column) -> DataFrame:
    """Sessions with ``n_parts``, ``received`` bytes, ``missing`` runs of parts as an array, and ``state``.

    ``sessions``: session_id, status, expected_size, part_size (null for a single upload, which is one part), expires_at. ``parts``: session_id,
    part_number, size; of a part that came again the largest size counts. An open session that has expired is swept to ABORTED; one that has
    all parts, and as many bytes as expected, is UPLOADED, with other bytes FAILED; one that has some is UPLOADING. Others stay as they are.
    """
    expected = F.when(F.col("part_size").isNull(), 1).otherwise(F.ceil(F.col("expected_size") / F.col("part_size"))).cast("int")
    rows = sessions.withColumn("n_expected", F.greatest(expected, F.lit(1)))
    once = parts.groupBy("session_id", "part_number").agg(F.max("size").alias("size"))
    sums = once.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("received"))
    gaps = missing_parts(rows, parts).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("first_missing", "last_missing"))).alias("missing"))
    got = rows.join(sums, "session_id", "left").join(gaps, "session_id", "left").withColumns({"n_parts": F.coalesce("n_parts", F.lit(0)), "received": F.coalesce("received", F.lit(0)), "missing": F.coalesce("missing", F.array().cast("array<struct<first_missing:int,last_missing:int>>"))})
    whole = F.size("missing") == 0
    state = (
        F.when(~F.col("status").isin(*OPEN), F.col("status")).when(F.col("expires_at") < now, "ABORTED").when(whole & (F.col("received") == F.col("expected_size")), "UPLOADED")
        .when(whole, "FAILED").when(F.col("n_parts") > 0, "UPLOADING").otherwise(F.col("status"))
    )
    return got.withColumn("state", state)
