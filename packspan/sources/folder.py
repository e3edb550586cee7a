"""Data source ``folder_files``: every file below ``path``, without reading contents; empty files too.

Folders of the first levels are listed when the read is planned, until there are ``FAN_OUT`` of them; each of the rest is
walked by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FAN_OUT = 64
SCHEMA = "path string, size long, modified timestamp"


class _Part(InputPartition):
    def __init__(self, folder: str | None, files: list[tuple]):
        self.folder, self.files = folder, files


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def _root(self) -> tuple[pafs.FileSystem, str]:
        from packspan.sources.archive import _store

        store, root = _store(self.path)
        return store, root.rstrip("/")

    @staticmethod
    def _row(root: str, f) -> tuple:
        return f.path[len(root) + 1 :], f.size, f.mtime

    def partitions(self) -> list[_Part]:
        store, root = self._root()
        folders, files, level = [root], [], 0
        while folders and len(folders) < FAN_OUT and level < 4:
            below: list[str] = []
            for folder in folders:
                for f in store.get_file_info(pafs.FileSelector(folder)):
                    if f.type == pafs.FileType.Directory:
                        below.append(f.path)
                    elif f.is_file:
                        files.append(self._row(root, f))
            folders, level = below, level + 1
        return [_Part(None, files), *(_Part(f, []) for f in sorted(folders))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from partition.files
        if partition.folder is not None:
            store, root = self._root()
            for f in store.get_file_info(pafs.FileSelector(partition.folder, recursive=True)):
                if f.is_file:
                    yield self._row(root, f)


class FolderFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)
