"""Readers of tables, document files and service answers. Schemas are declared, never inferred."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where the session names none and all runs on this machine, a local one is taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tallyloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them again, so that no later step runs this one again.

    They stay in ``tallyloom`` under it until whoever owns the folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the financial-fact store, read with its declared schema."""
    return spark.read.schema(schemas.schema(name)).parquet(f"{folder}/{name}")


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """Document files as rows: path, size, content and its SHA-256."""
    got = spark.read.format("binaryFile").load(pattern)
    return got.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content", F.sha2("content", 256).alias("checksum"))


def head(content: Column, size: int) -> Column:
    """The first bytes of a file."""
    return F.substring(content, 1, size)


def extraction(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Service answers as nested records in ``extraction``; ``valid`` where both lists exist."""
    got = answers.withColumn("extraction", F.from_json(column, schemas.EXTRACTION))
    return got.withColumn("valid", F.col("extraction.chunks").isNotNull() & F.col("extraction.candidates").isNotNull())
