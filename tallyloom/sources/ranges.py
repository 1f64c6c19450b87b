"""Byte ranges of stored files as rows: heads, tails and parts, read without the rest of a file.

``register`` makes the source ``byte_ranges`` known to a session. Its options: ``path`` (a folder or a file of any store that Arrow's file
systems know, a plain path or a URI), ``suffix`` (of the files' names), ``start`` (a range's first byte, from the end where it is negative), ``length``, or
``part`` (files as parts of so many bytes in place of one range), and ``page`` (files of one partition of a listing).

A listing is sorted by name and cut into pages, which is what a partition holds; the driver sees names and sizes, never content.
A task opens a file, seeks and reads its range, so what it reads is bounded by ``length`` or ``part``, whatever the file's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, start long, length int, content binary"


@dataclass
class Page(InputPartition):
    """Ranges that one task reads: path, size, first byte and length of each."""

    ranges: list[tuple[str, int, int, int]]


def listing(path: str, suffix: str = "", after: str = "", most: int | None = 1000) -> list[tuple[str, int]]:
    """A page of a folder's files in order of their names, from the one after a marker, as path and size; without ``most``, all.

    The last name of a full page is the next page's marker. A path that is a file is its own only page.
    """
    import pyarrow.fs as pafs

    store, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)] if info.path > after else []
    files = store.get_file_info(pafs.FileSelector(root, recursive=True))
    found = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.path.endswith(suffix) and f.path > after)
    return found[:most]


def ranges_of(size: int, start: int, length: int, part: int) -> list[tuple[int, int]]:
    """First byte and length of the ranges asked of a file, cut to what it has."""
    if part:
        return [(at, min(part, size - at)) for at in range(0, size, part)]
    at = max(0, size + start) if start < 0 else min(start, size)
    return [(at, min(length, size - at))]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.start, self.length, self.part, self.page = (int(options.get(k, d)) for k, d in (("start", 0), ("length", 1024), ("part", 0), ("page", 100)))
        if self.length < 0 or self.part < 0 or self.page < 1:
            raise ValueError("length and part can't be negative, and a page has a file at least")

    def partitions(self) -> list[Page]:
        files, out = listing(self.path, self.suffix, most=None), []
        for k in range(0, len(files), self.page):
            wanted = [(name, size, at, n) for name, size in files[k : k + self.page] for at, n in ranges_of(size, self.start, self.length, self.part)]
            # Parts of large files are dealt to tasks of their own, heads of small ones go together.
            out += [Page([r]) for r in wanted] if self.part else [Page(wanted)]
        return out or [Page([])]

    def read(self, partition: Page) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        store = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        for path, size, at, n in partition.ranges:
            with store.open_input_file(path) as f:
                f.seek(at)
                content = f.read(n)
            yield path, size, at, len(content), content


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteRanges)


def heads(spark: SparkSession, path: str, length: int, suffix: str = "") -> DataFrame:
    """The first bytes of a folder's files."""
    register(spark)
    return spark.read.format("byte_ranges").option("path", path).option("suffix", suffix).option("length", length).load()
