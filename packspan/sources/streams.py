"""Single-stream codecs, and several files as one."""

from __future__ import annotations

import bisect
import bz2
import gzip
import io
import lzma
import struct
from collections.abc import Iterator

import zstandard

BLOCK = 1 << 16


class Concatenated(io.RawIOBase):
    """Parts as one seekable stream; a place is found by binary search in the parts' ends."""

    def __init__(self, parts: list, sizes: list[int]):
        self.parts, self.at = parts, 0
        self.ends, total = [], 0
        for s in sizes:
            total += s
            self.ends.append(total)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        size = self.ends[-1] if self.ends else 0
        to = offset + (0, self.at, size)[whence]
        if not 0 <= to <= size:
            raise ValueError("seek outside the volumes")
        self.at = to
        return to

    def readinto(self, b) -> int:
        i = bisect.bisect_right(self.ends, self.at)
        if i == len(self.ends):
            return 0
        start = self.ends[i - 1] if i else 0
        self.parts[i].seek(self.at - start)
        got = self.parts[i].read(min(len(b), self.ends[i] - self.at))
        b[: len(got)] = got
        self.at += len(got)
        return len(got)


def opened(fmt: str, f):
    """A readable stream of the decoded bytes. All concatenated members or frames are decoded."""
    if fmt == "gz":
        return gzip.GzipFile(fileobj=f)
    if fmt == "bz2":
        return bz2.BZ2File(f)
    if fmt == "xz":
        return lzma.LZMAFile(f, format=lzma.FORMAT_XZ)
    if fmt == "lzma":
        return lzma.LZMAFile(f, format=lzma.FORMAT_ALONE)
    if fmt == "zst":
        return zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True, closefd=False)
    if fmt == "lz4":
        import pyarrow as pa

        return pa.CompressedInputStream(pa.PythonFile(f, "r"), "lz4")
    raise ValueError(f"no such codec: {fmt}")


def size_hint(fmt: str, f, length: int) -> int | None:
    """The decoded size as the file states it, None if it doesn't. A gzip file states its last member's, modulo 2^32."""
    f.seek(0)
    head = f.read(32)
    if fmt == "gz":
        if length < 18 or head[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip file")
        f.seek(length - 4)
        return struct.unpack("<I", f.read(4))[0]
    if fmt == "lzma":
        if len(head) < 13:
            raise ValueError("not an LZMA file")
        n = struct.unpack_from("<Q", head, 5)[0]
        return None if n == (1 << 64) - 1 else n
    if fmt == "lz4":
        if len(head) < 4:
            raise ValueError("not an LZ4 file")
        if head[:4] == b"\x04\x22\x4d\x18" and len(head) >= 14 and head[4] & 8:
            return struct.unpack_from("<Q", head, 6)[0]
        return None
    if fmt == "zst":
        n = zstandard.frame_content_size(head) if len(head) >= 4 else -1
        return n if n > 0 else None
    return None


def blocks(stream, size: int = BLOCK) -> Iterator[bytes]:
    while b := stream.read(size):
        yield bytes(b)


def writer(fmt: str, f, level: int | None, size: int | None = None):
    """A writable stream that encodes into ``f``; closing it ends the format and leaves ``f`` open."""
    if fmt == "gz":
        return gzip.GzipFile(fileobj=f, mode="wb", compresslevel=6 if level is None else level, mtime=0)
    if fmt == "bz2":
        return bz2.BZ2File(f, "wb", compresslevel=9 if level is None else level)
    if fmt == "xz":
        return lzma.LZMAFile(f, "wb", format=lzma.FORMAT_XZ)
    if fmt == "lzma":
        return lzma.LZMAFile(f, "wb", format=lzma.FORMAT_ALONE)
    if fmt == "zst":
        return zstandard.ZstdCompressor(level=3 if level is None else level).stream_writer(f, size=-1 if size is None else size, closefd=False)
    if fmt == "lz4":
        import pyarrow as pa

        return pa.CompressedOutputStream(pa.PythonFile(f, "w"), "lz4")
    raise ValueError(f"no such codec: {fmt}")
