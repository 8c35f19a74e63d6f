"""Archives of any size as a Spark data source: every member is a partition, streamed from the store.

``readers.archives`` holds a whole archive in a row, which stops at 2 GB and at a task's memory. Here the driver reads the list of
members at an archive's end, and a task seeks to its member and unpacks it as it reads: a few batches of lines are all that is in memory. Files
are opened by pyarrow's file systems (local, hdfs, s3, gs, abfs); a store that only Spark can open is left to ``readers``.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, member string, n long, line string, reason string"
LINES = 10_000
#: What unpacking a damaged, locked or strangely packed member raises.
FAULTS = (zipfile.BadZipFile, zlib.error, EOFError, UnicodeDecodeError, NotImplementedError, RuntimeError)


@dataclass
class Member(InputPartition):
    path: str
    name: str | None  # None: no archive


def _open(path: str):
    found, inner = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))
    return found.open_input_file(inner)


class Reader(DataSourceReader):
    def __init__(self, paths: Sequence[str], suffix: str, encoding: str) -> None:
        self.paths, self.suffix, self.encoding = paths, suffix, encoding

    def partitions(self) -> list[Member]:
        out = []
        for path in self.paths:
            try:
                with _open(path) as f:
                    out += [Member(path, name) for name in sorted(zipfile.ZipFile(f).namelist()) if name.lower().endswith(self.suffix)]
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where it is shorter than an archive's end
                out.append(Member(path, None))
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        if partition.name is None:
            yield _batch([(partition.path, None, None, None, "no archive")])
            return
        held: list[tuple] = []
        try:
            with _open(partition.path) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
                for n, line in enumerate(io.TextIOWrapper(member, self.encoding)):
                    held.append((partition.path, partition.name, n, line.rstrip("\r\n"), None))
                    if len(held) == LINES:
                        yield _batch(held)
                        held = []
        except FAULTS as e:
            held.append((partition.path, partition.name, None, None, f"unreadable: {type(e).__name__}"))
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "member", "n", "line", "reason"])


class Zips(DataSource):
    """Options: ``paths`` (one a line), ``suffix`` of the members wanted, ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "rillstone_zips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options.get("paths", "").splitlines(), self.options.get("suffix", ".csv"), self.options.get("encoding", "latin-1"))


def zip_lines(spark: SparkSession, paths: Sequence[str], suffix: str = ".csv", encoding: str = "latin-1") -> DataFrame:
    """path, member, n, line, reason of every member with the suffix, as ``readers.unzip_lines`` gives them; a batch of a ledger names the paths."""
    spark.dataSource.register(Zips)
    return spark.read.format("rillstone_zips").option("paths", "\n".join(paths)).option("suffix", suffix).option("encoding", encoding).load()
