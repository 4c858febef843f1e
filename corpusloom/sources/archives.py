"""Zip archives as a data source: members are dealt to tasks by their sizes, as the archive's directory lists them.

    spark.dataSource.register(Archives)
    spark.read.format("archives").option("pattern", "*.txt").load("/shared/folder/or/file.zip")

An archive is opened once by the planner, which reads its directory alone, and once by each task, which reads the task's members; a
large archive is read by many tasks. Paths are those of a file system that all machines mount.
"""

from __future__ import annotations

import fnmatch
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 32 << 20  # uncompressed bytes of a task's members, about


def _local(path: str) -> str:
    found = urlparse(path)
    return unquote(found.path) if found.scheme == "file" else path


@dataclass
class Members(InputPartition):
    archive: str
    names: tuple[str, ...]


class Archives(DataSource):
    """archive, member, size and content of the members whose names fit ``pattern``; folders and broken archives have no rows."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, member string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(_local(self.options["path"]), self.options.get("pattern", "*"), int(self.options.get("partBytes", PART_BYTES)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, part: int):
        self.path, self.pattern, self.part = path, pattern, part

    def _archives(self) -> list[str]:
        if os.path.isfile(self.path):
            return [self.path]
        return sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.lower().endswith(".zip"))

    def partitions(self) -> list[Members]:
        out = []
        for archive in self._archives():
            if not zipfile.is_zipfile(archive):
                continue
            with zipfile.ZipFile(archive) as z:
                wanted = [m for m in z.infolist() if not m.is_dir() and fnmatch.fnmatch(m.filename, self.pattern)]
            names: list[str] = []
            size = 0
            for m in wanted:
                if names and size + m.file_size > self.part:
                    out.append(Members(archive, tuple(names)))
                    names, size = [], 0
                names.append(m.filename)
                size += m.file_size
            if names:
                out.append(Members(archive, tuple(names)))
        return out or [Members("", ())]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.archive:
            return
        with zipfile.ZipFile(partition.archive) as z:
            for name in partition.names:
                content = z.read(name)
                yield partition.archive, name, len(content), content
