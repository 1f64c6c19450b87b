"""Helpers that the operators share: reading tables, shared scratch tables, text batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; long texts are bounded by Spark's byte limit as well.
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by Spark's own readers so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where the session names none and all runs on this machine, a local one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tallyloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table to the shared folder and read it again.

    This cuts the lineage: a lost executor never makes the stages before it run again. Tables that a result
    is still read from stay until whoever owns the folder clears ``tallyloom`` in it; others go by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Names of the bucketed tables by their folder.
NAMES: dict[str, str] = {}


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As ``materialize``, the table being bucketed, so that joins on the column don't shuffle it again."""
    spark = df.sparkSession
    path, table = (f"{x}{name}{y}{uuid.uuid4().hex}" for x, y in ((f"{shared_dir(spark)}/tallyloom/", "-"), ("tallyloom_", "_")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(table)
    NAMES[path.rsplit("/", 1)[1]] = table
    return spark.read.table(table)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables written by ``materialize`` that nothing will read any more."""
    for df in tables:
        files = df.inputFiles() if df is not None else []
        if not files:
            continue
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.getParent().getName() == "tallyloom":
            if folder.getName() in NAMES:
                spark.sql(f"DROP TABLE IF EXISTS {NAMES.pop(folder.getName())}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries: Spark deletes them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving free memory back to the system at the end: Python workers outlive a stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory stays bounded on long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def with_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, a null text as an empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def crc_fold(column: str, folds: int):
    """crc32 of a column's text form, modulo ``folds``: the fold that a labelled row belongs to."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))
