"""Members of ZIP archives as a Spark data source, in batch and as a stream.

``spark.read.format("zip_members").load(folder)`` gives (archive, member, value): each member is a partition of its own, read by seeking to it, so an
archive is never in one row, and its members are many tasks' work. As a stream each archive is taken once, by modification time and name. Options: ``suffix``
(which members, '' for all), ``maxArchives`` (archives of one micro-batch). Paths go through Arrow's file systems, so local and object stores
alike. Text is UTF-8, broken bytes replaced; line ends become line feeds. A broken archive is an error.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MEMBERS = "archive string, member string, value string"
FORMAT = "zip_members"


@dataclass
class Member(InputPartition):
    """One member of one archive."""

    archive: str
    member: str


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _archives(path: str) -> list[tuple[int, str]]:
    """(modification time in ns, path) of the archives of a folder and its folders, or of the one archive named."""
    store, root = _file_system(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))


def _members(path: str, archives: list[str], suffix: str) -> list[Member]:
    store, _ = _file_system(path)
    out = []
    for name in archives:
        try:
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:  # reads the directory at its end only
                out += [Member(name, m.filename) for m in z.infolist() if not m.is_dir() and m.filename.lower().endswith(suffix)]
        except zipfile.BadZipFile as e:
            raise ValueError(f"{name} is no ZIP archive") from e
    return out


def _read(path: str, part: Member) -> Iterator[tuple]:
    store, _ = _file_system(path)
    with store.open_input_file(part.archive) as f, zipfile.ZipFile(f) as z:
        text = z.read(part.member).decode("utf-8", "replace")
    value = text.replace("\r\n", "\n").replace("\r", "\n")
    yield pa.RecordBatch.from_pydict({"archive": [part.archive], "member": [part.member], "value": [value]})


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._path, self._suffix = options["path"], options.get("suffix", "").lower()

    def partitions(self) -> list[Member]:
        return _members(self._path, [p for _, p in _archives(self._path)], self._suffix) or [Member("", "")]

    def read(self, partition: Member) -> Iterator[tuple]:
        return _read(self._path, partition) if partition.archive else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are (modification time, path) of the newest archive taken."""

    def __init__(self, options: dict) -> None:
        self._path, self._suffix, self._most = options["path"], options.get("suffix", "").lower(), int(options.get("maxarchives", options.get("maxArchives", 1000)))
        self._at = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"newest": json.dumps([-1, ""])}

    def _between(self, start: dict, end: dict | None) -> list[tuple[int, str]]:
        low = tuple(json.loads(start["newest"]))
        return [a for a in _archives(self._path) if a > low and (end is None or a <= tuple(json.loads(end["newest"])))]

    def latestOffset(self) -> dict:
        new = self._between(self._at, None)[: self._most]
        if new:
            self._at = {"newest": json.dumps(new[-1])}
        return self._at

    def partitions(self, start: dict, end: dict) -> list[Member]:
        self._at = max(self._at, end, key=lambda o: json.loads(o["newest"]))
        return _members(self._path, [p for _, p in self._between(start, end)], self._suffix)

    def read(self, partition: Member) -> Iterator[tuple]:
        return _read(self._path, partition)

    def commit(self, end: dict) -> None:
        pass


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def read_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, value) of all members whose names end so."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format(FORMAT).option("suffix", suffix).load(path)


def stream_members(spark: SparkSession, path: str, suffix: str = "", most: int = 1000) -> DataFrame:
    """The same as a stream of what lands; each archive once."""
    spark.dataSource.register(ZipMembers)
    return spark.readStream.format(FORMAT).option("suffix", suffix).option("maxArchives", most).load(path)
