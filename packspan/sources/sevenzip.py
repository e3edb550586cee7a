"""7z archives: headers, and members coded by copy, LZMA, LZMA2, delta, deflate or bzip2. AES is told, not decoded."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from packspan.sources.containers import READERS, Member, Options, _exact, _range

MAGIC = b"7z\xbc\xaf\x27\x1c"
_AES = b"\x06\xf1\x07\x01"
_LZMA_KIND = {b"\x21": lzma.FILTER_LZMA2, b"\x03\x01\x01": lzma.FILTER_LZMA1, b"\x03": lzma.FILTER_DELTA, b"\x03\x03\x01\x03": lzma.FILTER_X86}


@dataclass
class Folder:
    coders: list[tuple[bytes, bytes]] = field(default_factory=list)
    outputs: int = 0
    packed: int = 1
    bound: set[int] = field(default_factory=set)
    sizes: list[int] = field(default_factory=list)
    has_crc: bool = False

    @property
    def size(self) -> int:
        return next((s for i, s in enumerate(self.sizes) if i not in self.bound), 0)

    @property
    def encrypted(self) -> bool:
        return any(c == _AES for c, _ in self.coders)


class _Header:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise ValueError("7z header is truncated")
        self.at += n
        return out

    def number(self) -> int:
        first, mask, value = self.byte(), 0x80, 0
        for i in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * i
            value |= self.byte() << 8 * i
            mask >>= 1
        return value

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[i >> 3] & 0x80 >> (i & 7)) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


@dataclass
class Streams:
    start: int = 0
    packs: list[int] = field(default_factory=list)
    folders: list[Folder] = field(default_factory=list)
    members: list[list[int]] = field(default_factory=list)  #: sizes of each folder's members


def _folder(h: _Header) -> Folder:
    out, inputs = Folder(), 0
    for _ in range(h.number()):
        flag = h.byte()
        codec = h.take(flag & 15)
        n_in, n_out = (h.number(), h.number()) if flag & 0x10 else (1, 1)
        props = h.take(h.number()) if flag & 0x20 else b""
        out.coders.append((codec, props))
        inputs, out.outputs = inputs + n_in, out.outputs + n_out
    for _ in range(out.outputs - 1):
        h.number()
        out.bound.add(h.number())
    out.packed = inputs - (out.outputs - 1)
    if out.packed > 1:
        for _ in range(out.packed):
            h.number()
    return out


def _streams(h: _Header) -> Streams:
    s = Streams()
    while (tag := h.byte()) != 0:
        if tag == 0x06:
            s.start = h.number()
            n = h.number()
            while (t := h.byte()) != 0:
                if t == 0x09:
                    s.packs = [h.number() for _ in range(n)]
                elif t == 0x0A:
                    h.take(4 * sum(h.defined(n)))
        elif tag == 0x07:
            if h.byte() != 0x0B:
                raise ValueError("bad 7z header")
            n = h.number()
            if h.byte():
                raise ValueError("unsupported 7z header")
            s.folders = [_folder(h) for _ in range(n)]
            while (t := h.byte()) != 0:
                if t == 0x0C:
                    for f in s.folders:
                        f.sizes = [h.number() for _ in range(f.outputs)]
                elif t == 0x0A:
                    known = h.defined(n)
                    h.take(4 * sum(known))
                    for f, k in zip(s.folders, known, strict=True):
                        f.has_crc = k
            s.members = [[f.size] for f in s.folders]
        elif tag == 0x08:
            counts = [1] * len(s.folders)
            sized = False
            while (t := h.byte()) != 0:
                if t == 0x0D:
                    counts = [h.number() for _ in s.folders]
                elif t == 0x09:
                    s.members = []
                    for f, n in zip(s.folders, counts, strict=True):
                        sizes = [h.number() for _ in range(max(n - 1, 0))]
                        s.members.append([*sizes, f.size - sum(sizes)] if n else [])
                    sized = True
                elif t == 0x0A:
                    h.take(4 * sum(h.defined(sum(n for f, n in zip(s.folders, counts, strict=True) if n != 1 or not f.has_crc))))
            if not sized:
                s.members = [[f.size] * (n > 0) for f, n in zip(s.folders, counts, strict=True)]
    return s


def _unpacked(f, folder: Folder, at: int, size: int) -> Iterator[bytes]:
    """A folder's bytes; its coders form one chain of known codecs, or it isn't decoded."""
    if folder.encrypted:
        raise ValueError("encrypted")
    if folder.packed != 1 or folder.outputs != len(folder.coders):
        raise ValueError("unsupported codec")
    source: Iterator[bytes] = _range(f, at, size)
    filters = []
    for codec, props in folder.coders:
        if codec in _LZMA_KIND:
            kind = _LZMA_KIND[codec]
            filters.append(lzma._decode_filter_properties(kind, props) if kind in (lzma.FILTER_LZMA1, lzma.FILTER_LZMA2, lzma.FILTER_DELTA) else {"id": kind})
        elif codec not in (b"\0", b"\x04\x01\x08", b"\x04\x02\x02"):
            raise ValueError("unsupported codec")
    left = folder.size
    if filters:
        # coders are listed from the output to the input, as the library's filter chain is
        order = sorted(filters, key=lambda x: x["id"] in (lzma.FILTER_LZMA1, lzma.FILTER_LZMA2))
        z = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=order)
        source = (z.decompress(b) for b in source if not z.eof)
    elif folder.coders[0][0] == b"\x04\x01\x08":
        d = zlib.decompressobj(-15)
        source = (d.decompress(b) for b in source)
    elif folder.coders[0][0] == b"\x04\x02\x02":
        b2 = bz2.BZ2Decompressor()
        source = (b2.decompress(b) for b in source if not b2.eof)
    for b in source:
        b = b[:left]
        left -= len(b)
        if b:
            yield b
    if left:
        raise ValueError("7z data is truncated")


def read_7z(f, o: Options) -> Iterator[Member]:
    if _exact(f, 0, 6) != MAGIC:
        raise ValueError("not a 7z file")
    offset, size, crc = struct.unpack("<QQI", _exact(f, 12, 20))
    if size == 0:
        return
    data = _exact(f, 32 + offset, size)
    if zlib.crc32(data) != crc:
        raise ValueError("7z header is damaged")
    h = _Header(data)
    tag = h.byte()
    while tag == 0x17:
        s = _streams(h)
        h = _Header(b"".join(_unpacked(f, s.folders[0], 32 + s.start, s.packs[0])))
        tag = h.byte()
    if tag != 0x01:
        raise ValueError("bad 7z header")
    s, names, empty, empty_file, count = Streams(), [], [], [], 0
    while (tag := h.byte()) != 0:
        if tag == 0x04:
            s = _streams(h)
        elif tag == 0x05:
            count = h.number()
            empty = [False] * count
            while (t := h.byte()) != 0:
                n = h.number()
                end = h.at + n
                if t == 0x0E:
                    empty = h.bits(count)
                elif t == 0x0F:
                    empty_file = h.bits(sum(empty))
                elif t == 0x11 and not h.byte():
                    names = h.take(end - h.at).decode("utf-16-le", "replace").split("\0")[:count]
                h.at = end
        else:
            raise ValueError("unsupported 7z header")
    places = [(i, k) for i, m in enumerate(s.members) for k in range(len(m))]
    firsts = [sum(fo.packed for fo in s.folders[:i]) for i in range(len(s.folders))]
    state: dict[str, object] = {}

    def content(folder: int, nth: int) -> Iterator[bytes]:
        # members of a folder are one solid stream: it is read on from where the last member ended
        if state.get("folder") != folder or state["next"] > nth:
            p = firsts[folder]
            state.update(folder=folder, next=0, stream=_unpacked(f, s.folders[folder], 32 + s.start + sum(s.packs[:p]), s.packs[p]), rest=b"")
        for k in range(state["next"], nth + 1):
            left = s.members[folder][k]
            state["next"] = k + 1
            while left:
                if not state["rest"]:
                    state["rest"] = next(state["stream"])
                b, state["rest"] = state["rest"][:left], state["rest"][left:]
                left -= len(b)
                if k == nth:
                    yield b

    at = gone = 0
    for i in range(count):
        name = names[i] if i < len(names) else f"[{i}]"
        if empty[i]:
            is_dir = not (gone < len(empty_file) and empty_file[gone])
            gone += 1
            yield Member(name, 0, is_dir, entry_type="dir" if is_dir else "file", content=None if is_dir else lambda: iter(()))
            continue
        folder, nth = places[at]
        at += 1
        locked = s.folders[folder].encrypted
        yield Member(name, s.members[folder][nth], False, locked, error="encrypted" if locked else None, content=None if locked else lambda a=folder, b=nth: content(a, b))


READERS["7z"] = read_7z
