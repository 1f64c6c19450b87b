"""A table of jobs kept up to date from a stream of events, whatever is delivered again.

Rows are spread over buckets by a hash of their key. A micro-batch rewrites only the buckets that it touches, each as a
new version under its batch's number: ``bucket=7/batch=12``. A batch is committed by a mark written after its files, and
the table is, for each bucket, the newest version whose batch is committed. So a batch that fails half-way
changes nothing, and one that comes again reads the versions before its own and writes the same files: nothing is counted
twice. Versions that a newer committed one replaces are deleted once the batch after is committed.

The driver sees names of folders, at most two a bucket, and no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = Callable[[DataFrame], DataFrame]


@dataclass
class Versions:
    """A versioned table under ``root``, keyed by ``key``, with the columns of ``schema`` (DDL) and ``buckets`` buckets."""

    spark: SparkSession
    root: str
    key: str
    schema: str
    buckets: int = 64

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        files, path = self._files(), self._path(*parts)
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def committed(self) -> list[int]:
        """Numbers of the batches whose mark is there."""
        return sorted(int(n) for n in self._names("_batches") if n.isdigit())

    def versions(self) -> dict[int, list[int]]:
        """Batches that each bucket has a version of."""
        found = {}
        for name in self._names():
            if name.startswith("bucket="):
                found[int(name[7:])] = sorted(int(v[6:]) for v in self._names(name) if v.startswith("batch="))
        return found

    def _read(self, chosen: dict[int, int]) -> DataFrame:
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/bucket={b}/batch={v}" for b, v in sorted(chosen.items())))

    def before(self, batch: int, buckets: set[int] | None = None) -> DataFrame:
        """The table as it was before a batch, of some buckets or all."""
        done = {n for n in self.committed() if n < batch}
        chosen = {b: max(x) for b, vs in self.versions().items() if (buckets is None or b in buckets) and (x := [v for v in vs if v in done])}
        return self._read(chosen)

    def current(self) -> DataFrame:
        """The table as of the last committed batch."""
        return self.before((self.committed() or [-1])[-1] + 1)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, batch: int, fold: Fold) -> None:
        """Put a batch's rows in: ``fold`` makes one row a key of old rows and new ones, which have the table's columns.

        Rows without a key are left out. A batch before the last committed one was put in whole then, and is skipped.
        """
        done = self.committed()
        if done and batch < done[-1]:
            return
        rows = rows.where(F.col(self.key).isNotNull()).select(*self._columns()).persist()  # looked at twice; a lost part is made again
        try:
            touched = {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}
            if touched:
                new = fold(self.before(batch, touched).unionByName(rows))
                # One task for each bucket writes its version, and a version that a failed try left is overwritten.
                out = new.select(*self._columns()).withColumns({"bucket": self.bucket(), "batch": F.lit(batch)}).repartition(len(touched), "bucket")
                out.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.root)
        finally:
            rows.unpersist()
        self._files().create(self._path("_batches", str(batch)), True).close()
        self._tidy(batch)

    def _tidy(self, batch: int) -> None:
        """Delete versions that the table before ``batch`` no longer needs; a replay of ``batch`` still finds all it reads."""
        done = {n for n in self.committed() if n < batch}
        for b, vs in self.versions().items():
            old = [v for v in vs if v in done]
            for v in old[:-1]:
                self._files().delete(self._path(f"bucket={b}", f"batch={v}"), True)
        for n in sorted(done):
            if not any(n in vs for vs in self.versions().values()) and n != max(done):
                self._files().delete(self._path("_batches", str(n)), False)


#: A job as its events leave it.
JOB_STATE = "job_id long, status string, updated_at timestamp, last_event_id long, n_events long, total decimal(38,2)"


def job_rows(events: DataFrame, status: Column, job: str = "user_id") -> DataFrame:
    """Each event as the state of a job that has only this one."""
    return events.select(F.col(job).cast("long").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").cast("long").alias("last_event_id"), F.lit(1).cast("long").alias("n_events"), F.col("value").cast("decimal(38,2)").alias("total"))


def last_state(rows: DataFrame) -> DataFrame:
    """One row a job: the status of its last event by time and id, and sums over all of them.

    Events are summed before they are shuffled, so a job with most of the events is one row a task.
    """
    last = F.max(F.struct("updated_at", "last_event_id", "status"))
    got = rows.groupBy("job_id").agg(last.alias("last"), F.sum("n_events").alias("n_events"), F.sum("total").cast("decimal(38,2)").alias("total"))
    return got.select("job_id", "last.status", "last.updated_at", "last.last_event_id", "n_events", "total")


def follow(events: DataFrame, status: Column, table: Versions, checkpoint: str, job: str = "user_id"):
    """Keep a table of jobs by a stream of their events; the started query is given back.

    The stream's own checkpoint numbers the batches, so it and the table belong together.
    """

    def change(rows: DataFrame, batch: int) -> None:
        table.merge(last_state(job_rows(rows, status, job)), batch, last_state)

    return events.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
