"""Sinks: ``archive_writer`` packs rows into archives, ``member_folder`` writes members as files.

Rows are (target, path, content). Each target's rows must be in one partition, in order: ``pack`` sees to that. Files are
written under names of their own and take their place when the whole write commits; an abort deletes them.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from packspan.functions import paths
from packspan.functions.scalars import FORMATS, compression_level
from packspan.sinks import formats

_TARS = {"tar": None, "tgz": "gz", "tbz2": "bz2", "txz": "xz", "tzst": "zst"}
_SINGLE = ("gz", "bz2", "xz", "zst", "lzma", "lz4")
_CONTAINERS = {
    "7z": lambda f, level, most, parts: formats.SevenZip(f, level),
    "rar": lambda f, level, most, parts: formats.Rar(f, most, parts),
    "iso": lambda f, level, most, parts: formats.Iso(f),
    "nsa": lambda f, level, most, parts: formats.Nsa(f, level),
    "ypf": lambda f, level, most, parts: formats.Ypf(f),
    "xp3": lambda f, level, most, parts: formats.Xp3(f),
    "pf6": lambda f, level, most, parts: formats.Pfs(f, False),
    "pf8": lambda f, level, most, parts: formats.Pfs(f, True),
}


class _Split:
    """A stream cut into files of ``most`` bytes."""

    def __init__(self, most: int, opened):
        self.most, self.opened, self.n, self.left, self.f = most, opened, 0, most, opened(0)

    def write(self, data: bytes) -> int:
        view = memoryview(data)
        while len(view):
            if not self.left:
                self.f.close()
                self.n += 1
                self.f, self.left = self.opened(self.n), self.most
            part, view = view[: self.left], view[self.left :]
            self.f.write(bytes(part))
            self.left -= len(part)
        return len(data)

    def close(self) -> None:
        self.f.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  #: (written, final)
    members: int
    skipped: int


class _Zip:
    def __init__(self, f, level: int | None):
        store = level is not None and level <= 0
        self.z = zipfile.ZipFile(f, "w", zipfile.ZIP_STORED if store else zipfile.ZIP_DEFLATED, compresslevel=None if store else level)

    def add(self, path: str, content: bytes) -> None:
        self.z.writestr(zipfile.ZipInfo(path), content, self.z.compression, self.z.compresslevel)

    def close(self) -> None:
        self.z.close()


class _Tar:
    def __init__(self, f, codec: str | None, level: int | None):
        from packspan.sources import streams

        self.inner = streams.writer(codec, f, level) if codec else None
        self.t = tarfile.open(fileobj=self.inner or f, mode="w|", format=tarfile.GNU_FORMAT)

    def add(self, path: str, content: bytes) -> None:
        info = tarfile.TarInfo(path)
        info.size, info.mode = len(content), 0o644
        self.t.addfile(info, io.BytesIO(content))

    def close(self) -> None:
        self.t.close()
        if self.inner is not None:
            self.inner.close()


class _Single:
    def __init__(self, f, codec: str, level: int | None):
        from packspan.sources import streams

        self.s, self.n = streams.writer(codec, f, level), 0

    def add(self, path: str, content: bytes) -> None:
        if self.n:
            raise ValueError("this format holds one member")
        self.n = 1
        self.s.write(content)

    def close(self) -> None:
        self.s.close()


def _packer(fmt: str, f, level: int | None, volume_bytes: int | None = None, parts=None):
    if fmt in _CONTAINERS:
        return _CONTAINERS[fmt](f, level, volume_bytes, parts)
    level = None if level is None else compression_level(fmt, level)
    if fmt == "zip":
        return _Zip(f, level)
    if fmt in _TARS:
        return _Tar(f, _TARS[fmt], level)
    if fmt in _SINGLE:
        return _Single(f, fmt, level)
    raise ValueError(f"no writer for {fmt}")


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.folder = self.options["path"].rstrip("/")

    def _fs(self):
        from packspan.sources.archive import _store

        return _store(self.folder)

    def commit(self, messages: list[Written]) -> None:
        store, _ = self._fs()
        files = [f for m in messages if m for f in m.files]
        for folder in sorted({posixpath.dirname(final) for _, final in files}):
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda f: store.move(*f), files))
        self._sweep()

    def abort(self, messages: list[Written]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        store, root = self._fs()
        staging = f"{root}/{self.options['staging']}"
        if store.get_file_info(staging).type.name == "Directory":
            store.delete_dir(staging)

    def _staged(self) -> tuple:
        store, root = self._fs()
        staging = f"{root}/{self.options['staging']}"
        store.create_dir(staging, recursive=True)
        return store, root, staging


class _Packing(_Writer):
    def write(self, rows: Iterator) -> Written:
        fmt, level, most = self.options["format"], self.options.get("level"), self.options.get("volume_bytes")
        ext, most = FORMATS[fmt][2] if fmt in FORMATS and FORMATS[fmt][2] else fmt, None if most is None else int(most)
        store, root, staging = self._staged()
        files, now, out, packer, members, skipped = [], None, None, None, 0, 0

        def opened(n: int | None):
            """The archive's file, or its volume n."""
            name = f"{staging}/{uuid.uuid4().hex}"
            tail = f".{ext}" if n is None else f".part{n + 1}.rar" if fmt == "rar" else f".{ext}.{n + 1:03d}"
            files.append((name, f"{root}/{now}{tail}"))
            return store.open_output_stream(name, compression=None)

        def close() -> None:
            if packer is not None:
                packer.close()
                (packer.f if fmt == "rar" else out).close()  # a RAR set's writer closes each volume but the last

        for r in rows:
            if r.target != now:
                close()
                now = r.target
                out = opened(None) if most is None else opened(0) if fmt == "rar" else _Split(most, opened)
                packer = _packer(fmt, out, None if level is None else int(level), most, opened)
            if r.content is None:
                skipped += 1
                continue
            packer.add(r.path, bytes(r.content))
            members += 1
        close()
        return Written(files, members, skipped)


class _Unpacking(_Writer):
    def write(self, rows: Iterator) -> Written:
        store, root, staging = self._staged()
        files = []
        for r in rows:
            name = f"{staging}/{uuid.uuid4().hex}"
            with store.open_output_stream(name, compression=None) as out:
                out.write(bytes(r.content))
            files.append((name, f"{root}/{r.path}"))
        return Written(files, len(files), 0)


class ArchiveWriter(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_writer"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Packing(self.options)


class FolderWriter(DataSource):
    @classmethod
    def name(cls) -> str:
        return "member_folder"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Unpacking(self.options)


def _save(df: DataFrame, source: str, folder: str, **options) -> None:
    from packspan.sources.archive import register

    register(df.sparkSession)
    staging = f".staging-{int(time.time())}-{uuid.uuid4().hex[:8]}"
    df.write.format(source).options(path=folder, staging=staging, **{k: str(v) for k, v in options.items() if v is not None}).mode("append").save()


def pack(members: DataFrame, folder: str, fmt: str, level: int | None = None, volume_bytes: int | None = None) -> None:
    """Write members(target, path, content) as one archive ``folder/target.ext`` for each target.

    ``fmt`` is a key of ``FORMATS`` (``pf6`` or ``pf8`` for PFS). ``volume_bytes`` parts 7z and RAR archives into volumes.
    Members are in order of their paths; those without content are skipped. A target is a task's: split large sets into
    several targets. Unsafe paths are refused as a whole before anything is written. Single-stream formats hold one member.
    """
    if volume_bytes is not None and (fmt not in ("7z", "rar") or volume_bytes <= 0):
        raise ValueError("only 7z and RAR archives have volumes")
    bad = members.select(paths.join_error("path").alias("e"), paths.join_error("target").alias("t")).where("e is not null or t is not null").limit(1).collect()
    if bad:
        raise ValueError(f"unsafe member or target: {bad[0].e or bad[0].t}")
    rows = members.select("target", paths.normalise("path").alias("path"), "content")
    _save(rows.repartition("target").sortWithinPartitions("target", "path"), "archive_writer", folder, format=fmt, level=level, volume_bytes=volume_bytes)


def unpack(members: DataFrame, folder: str) -> DataFrame:
    """Write whole members(archive, path, content, error) below ``folder``; one row for each: archive, path, error.

    Members that couldn't be decoded, or whose path is unsafe, aren't written; their rows say why.
    """
    judged = members.withColumn("error", F.coalesce("error", paths.join_error("path"))).withColumn("_to", F.substring(paths.safe_join("", "path"), 2, 1 << 20))
    _save(judged.where("error is null").select(F.col("_to").alias("path"), "content"), "member_folder", folder)
    return judged.select("archive", "path", "error")
