"""Data sources ``archive_entries`` and ``archive_members``.

    spark.read.format("archive_entries").option("path", "/data/*.zip").load()
    spark.read.format("archive_members").option("path", "/data/a.7z.001").option("volumes", "true").load()

Options: ``path`` (a file, a folder, a glob, or several by line), ``format`` (told from the file otherwise), ``charset`` of
names, ``password``, ``selection`` (paths by line, members only), ``volumes`` (parts of a set are one archive),
``chunk_bytes`` (a member's rows hold so much; 32 MB) and ``max_member_bytes``.

An archive, or a set of volumes, is a task: most formats are only read forward. The catalog source reads headers only.
What can't be read is a row with ``error`` set; damaged input never fails the job.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from packspan.functions import paths
from packspan.operators.volumes import MODERN_RAR, OLD_RAR, SEVEN_ZIP, SEVEN_ZIP_MAGIC
from packspan.runtime import ship
from packspan.schema import MEMBERS, RAW_ENTRIES

CHUNK_BYTES = 32 << 20
MAX_VALUE = (1 << 31) - (1 << 16)


class Archive(InputPartition):
    def __init__(self, uri: str, parts: list[str]):
        self.uri, self.parts = uri, parts


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), posixpath.abspath(uri))


def listed(path: str) -> list[str]:
    """Files that a ``path`` option names, in order within each of its lines."""
    out = []
    for one in filter(None, path.split("\n")):
        pattern = re.search(r"[*?\[]", one) is not None
        base = re.split(r"[*?\[]", one)[0].rpartition("/")[0] or "." if pattern else one
        store, root = _store(base)
        scheme = base.removesuffix(root) if "://" in base else ""
        if pattern:
            tail = one[len(base) :].lstrip("/")
            found = store.get_file_info(pafs.FileSelector(root, recursive="/" in tail))
            names = [f.path for f in found if f.is_file and fnmatch.fnmatch(f.path.removeprefix(root).lstrip("/"), tail)]
        elif store.get_file_info(root).type == pafs.FileType.Directory:
            names = [f.path for f in store.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file]
        else:
            names = [root]
        out += sorted(scheme + n for n in names)
    return out


_PARTS = [(re.compile(MODERN_RAR), lambda m: int(m[2])), (re.compile(OLD_RAR), lambda m: (ord(m[2].lower()) - ord("r")) * 100 + int(m[3])), (re.compile(SEVEN_ZIP), lambda m: int(m[2]))]


def volume_sets(uris: list[str]) -> list[tuple[str, list[str]]]:
    """(name of the first part, parts in order); files that are no part, or a set's only one, stand alone."""
    sets: dict[tuple, list[tuple]] = {}
    for uri in uris:
        folder, _, name = uri.rpartition("/")
        hit = next(((k, m, number(m)) for k, (pattern, number) in enumerate(_PARTS) if (m := pattern.match(name))), None)
        if hit is None and name.lower().endswith(".rar"):
            sets.setdefault((folder, 1, name[:-4]), []).append((-1, uri))
        elif hit is None:
            sets.setdefault((uri,), []).append((0, uri))
        else:
            sets.setdefault((folder, hit[0], hit[1][1]), []).append((hit[2], uri))
    return [(own[0][1], [u for _, u in own]) for own in (sorted(v) for v in sets.values())]


def _is_set(first: str) -> bool:
    """Numbered files are a 7z set only if the first one has the magic number; RAR parts say so by their names."""
    name = first.rpartition("/")[2]
    if re.match(MODERN_RAR, name) or re.match(OLD_RAR, name) or name.lower().endswith(".rar"):
        return True
    store, path = _store(first)
    with store.open_input_file(path) as f:
        return f.read(len(SEVEN_ZIP_MAGIC)) == SEVEN_ZIP_MAGIC


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Archive]:
        uris = listed(self.options["path"])
        if self.options.get("volumes", "").lower() == "true":
            return [a for first, parts in volume_sets(uris) for a in ([Archive(first, parts)] if len(parts) == 1 or _is_set(first) else [Archive(u, [u]) for u in parts])]
        return [Archive(u, [u]) for u in uris]

    def _members(self, a: Archive):
        """(format, reader's members, what to close); raises on a file that can't be read."""
        from packspan.sources import containers, sevenzip, streams  # noqa: F401  sevenzip registers its reader

        files = []
        for p in a.parts:
            store, path = _store(p)
            files.append(store.open_input_file(path))
        if len(files) > 1:
            f = io.BufferedReader(streams.Concatenated(files, [x.size() for x in files]), 1 << 16)
        else:
            f = files[0]
        name = a.uri.rpartition("/")[2]
        head = f.read(16)
        f.seek(0)
        fmt = self.options.get("format") or containers.detect(name, head)
        if fmt not in containers.READERS:
            raise ValueError("unknown format")
        o = containers.Options(self.options.get("charset", "utf-8"), self.options.get("password"), name)
        return fmt, containers.READERS[fmt](f, o)

    def _format(self) -> str | None:
        return self.options.get("format")


class EntriesReader(_Reader):
    def read(self, partition: Archive) -> Iterator[tuple]:
        fmt, n = self._format(), 0
        try:
            fmt, members = self._members(partition)
            for m in members:
                yield partition.uri, fmt, n, m.path, m.size, m.is_dir, m.is_encrypted, m.entry_type, m.error
                n += 1
        except Exception as e:  # whatever a damaged file makes a codec raise is that file's error
            yield partition.uri, fmt, n, None, None, False, False, None, str(e) or type(e).__name__


class MembersReader(_Reader):
    def read(self, partition: Archive) -> Iterator[tuple]:
        chunk, most = int(self.options.get("chunk_bytes", CHUNK_BYTES)), int(self.options.get("max_member_bytes", 1 << 62))
        chosen = self.options.get("selection")
        wanted = None if chosen is None else {p for s in chosen.split("\n") if (p := s.replace("\\", "/").strip("/"))}
        fmt, n, path = self._format(), 0, None
        try:
            fmt, members = self._members(partition)
            for m in members:
                path = m.path.replace("\\", "/").strip("/")
                if path and not m.is_dir and (wanted is None or any(p in wanted for p in _self_and_above(path))):
                    yield from self._rows(partition.uri, fmt, n, path, m, chunk, most)
                n += 1
        except Exception as e:
            yield partition.uri, fmt, n, None, None, 0, 0, None, str(e) or type(e).__name__

    @staticmethod
    def _rows(uri: str, fmt: str, n: int, path: str, m, chunk: int, most: int) -> Iterator[tuple]:
        if m.content is None:
            if m.error or m.entry_type == "file":
                yield uri, fmt, n, path, m.size, 0, 0, None, m.error or "not decoded"
            return
        held, at, no = bytearray(), 0, 0
        try:
            for b in m.content():
                held += b
                if at + len(held) > most:
                    raise ValueError("member exceeds configured limit")
                while len(held) >= chunk:
                    yield uri, fmt, n, path, m.size, no, at, bytes(held[:chunk]), None
                    del held[:chunk]
                    at, no = at + chunk, no + 1
            if held or no == 0:
                yield uri, fmt, n, path, m.size, no, at, bytes(held), None
        except Exception as e:
            yield uri, fmt, n, path, m.size, no, at, None, str(e) or type(e).__name__


def _self_and_above(path: str) -> Iterator[str]:
    while path:
        yield path
        path = path.rpartition("/")[0]


class ArchiveEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return RAW_ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return EntriesReader(self.options)


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return MembersReader(self.options)


_registered: set[tuple[str, int]] = set()


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, for ``spark.read.format`` and ``CREATE TEMPORARY VIEW ... USING``."""
    from packspan.sinks.archive import ArchiveWriter, FolderWriter
    from packspan.sources.folder import FolderFiles

    ship(spark)
    session = spark._jsparkSession.hashCode()
    if (spark.sparkContext.applicationId, session) in _registered:
        return
    _registered.add((spark.sparkContext.applicationId, session))
    for source in (ArchiveEntries, ArchiveMembers, ArchiveWriter, FolderWriter, FolderFiles):
        spark.dataSource.register(source)


def entries(spark: SparkSession, path: str, **options) -> DataFrame:
    """The native catalog of archives: normalised paths with their parts, in physical order, error rows included."""
    register(spark)
    raw = spark.read.format("archive_entries").options(**{k: str(v) for k, v in options.items()}).option("path", path).load()
    raw = raw.withColumn("path", paths.normalise("raw_path")).where("path is not null or error is not null")
    parts = raw.withColumns({"name": paths.name("path"), "parent": paths.parent("path"), "ext": paths.extension(paths.name("path")), "depth": paths.depth("path")})
    return parts.select("archive", "format", "ordinal", "path", "name", "parent", "ext", "depth", "size", "is_dir", "is_encrypted", F.lit(False).alias("implied"), "entry_type", "error")


def whole_members(spark: SparkSession, path: str, **options) -> DataFrame:
    """Decoded members, one row each without an exchange: archive, format, ordinal, path, size, content, error.

    A task holds a member; one of more than a value can hold is an error row.
    """
    options |= {"chunk_bytes": MAX_VALUE + 1, "max_member_bytes": min(int(options.get("max_member_bytes", MAX_VALUE)), MAX_VALUE)}
    return members(spark, path, **options).drop("chunk_no", "offset")


def members(spark: SparkSession, path: str, **options) -> DataFrame:
    """Decoded members, in chunks; see ``whole_members`` for one row each."""
    register(spark)
    return spark.read.format("archive_members").options(**{k: str(v) for k, v in options.items()}).option("path", path).load()


def whole(chunks: DataFrame) -> DataFrame:
    """One row for each member that fits a value: its chunks joined in order, or its error."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "content")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, F.coalesce(p["content"], F.lit(b""))))
    out = chunks.groupBy("archive", "format", "ordinal", "path").agg(F.max("size").alias("size"), F.max("error").alias("error"), joined.alias("content"))
    return out.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
