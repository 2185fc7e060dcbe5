"""Folders as tables: a listing by tasks, and one file per row.

Both are Python data sources, registered once per session. Paths are those of any file system that
pyarrow knows (local, HDFS, object stores).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

LISTING = "keyloom_listing"
ROW_FILES = "keyloom_row_files"


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")  # as Hadoop writes it
    return fs.FileSystem.from_uri(path)


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


class _Share(InputPartition):
    def __init__(self, number: int, of: int):
        self.number, self.of = number, of


class _ListingReader(DataSourceReader):
    def __init__(self, path: str, shares: int):
        self.path, self.shares = path, shares

    def partitions(self) -> list[_Share]:
        return [_Share(i, self.shares) for i in range(self.shares)]

    def read(self, share: _Share) -> Iterator[pa.RecordBatch]:
        """Files of the top level's entries that fall to this share, hidden ones left out."""
        from pyarrow import fs

        system, root = _file_system(self.path)
        names, sizes = [], []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])

        def entries(folder: str):
            return [e for e in system.get_file_info(fs.FileSelector(folder)) if not _hidden(e.base_name)]

        waiting = [e for e in entries(root) if zlib.crc32(e.base_name.encode()) % share.of == share.number]
        while waiting:
            entry = waiting.pop()
            if entry.type == fs.FileType.Directory:
                waiting += entries(entry.path)
                continue
            names.append(entry.path[len(root.rstrip("/")) + 1 :])
            sizes.append(entry.size)
            if len(names) == 10_000:
                yield batch()
                names, sizes = [], []
        yield batch()


class FileListing(DataSource):
    """Names below a folder and byte lengths of its files, zero-byte files included.

    Options: ``path``, and ``shares``, the number of tasks. Each task reads the top level and goes
    on below the entries that fall to it by checksum, so no list of files passes through the driver.
    """

    @classmethod
    def name(cls) -> str:
        return LISTING

    def schema(self) -> str:
        return "path string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"], int(self.options.get("shares", "8")))


class _Written(WriterCommitMessage):
    pass


class _RowFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        system, root = _file_system(path)
        if overwrite:
            system.create_dir(root, recursive=True)
            system.delete_dir_contents(root)
        system.create_dir(root, recursive=True)

    def write(self, rows) -> WriterCommitMessage:
        """Each file is written below a hidden name and then moved, so a task that runs twice leaves whole files."""
        system, root = _file_system(self.path)
        for row in rows:
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as out:
                out.write((row[1] or "").encode())
            system.move(hidden, f"{root}/{row[0].replace('/', '%2F')}")
        return _Written()


class RowFiles(DataSource):
    """One file per row (name, text) in one folder; a slash in a name is written as %2F."""

    @classmethod
    def name(cls) -> str:
        return ROW_FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RowFileWriter(self.options["path"], overwrite)


def list_files(spark: SparkSession, path: str, shares: int | None = None) -> DataFrame:
    """Files below a folder: path (relative to it), length. See :class:`FileListing`."""
    spark.dataSource.register(FileListing)
    count = shares or spark.sparkContext.defaultParallelism
    return spark.read.format(LISTING).option("path", path).option("shares", str(count)).load()


def write_row_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (name, text) rows as one file each. Of rows with one name the last written stays."""
    rows.sparkSession.dataSource.register(RowFiles)
    named = rows.select(F.col(rows.columns[0]).alias("name"), F.col(rows.columns[1]).alias("text"))
    named.dropna(subset=["name"]).write.format(ROW_FILES).mode(mode).option("path", path).save()
