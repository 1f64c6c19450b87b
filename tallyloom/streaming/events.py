"""Event streams: windows, sessions, repeated events, and job state kept up to date.

Functions on a streaming frame work on a batch frame as well. Event time must be a timestamp with time zone
for a watermark, so naive times are cast, in the session's zone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.readers import shared_dir


def read(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(folder)


def timed(rows: DataFrame, column: str = "ts") -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(rows: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind and window."""
    got = timed(rows).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return got.select(F.col("window.start").alias("window_start"), "event_type", "n_events", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of each user's sessions."""
    got = timed(rows).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return got.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n_events")


def once(rows: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Events without those whose keys came before, within the watermark."""
    return timed(rows).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain(rows: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now. It is written to files in the shared folder, never to the
    driver's memory; windows that the watermark hasn't closed aren't in it."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/stream-{uuid.uuid4().hex}"
    query = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def apply_batches(rows: DataFrame, change: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``change`` on each micro-batch; it must give the same result if a batch comes again."""
    return rows.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
