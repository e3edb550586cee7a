"""Writers of container formats, each with ``add(path, content)`` and ``close()`` onto an output stream.

Formats whose directory comes first keep their bodies in a spool (memory up to ``SPOOL`` bytes, then the task's own temp folder).
"""

from __future__ import annotations

import hashlib
import lzma
import shutil
import struct
import tempfile
import zlib

import numpy as np

SPOOL = 16 << 20
_SECTOR = 2048


class _Spooled:
    def __init__(self, f):
        self.f, self.body = f, tempfile.SpooledTemporaryFile(SPOOL)
        self.entries: list[tuple] = []

    def _pour(self) -> None:
        self.body.seek(0)
        shutil.copyfileobj(self.body, self.f, 1 << 20)
        self.body.close()


# 7z


def _number(n: int) -> bytes:
    """A 7z number: the first byte's leading ones count the bytes that follow."""
    for extra in range(9):
        if extra == 8 or n < 1 << 7 * (extra + 1):
            high = 0xFF if extra == 8 else (0xFF00 >> extra & 0xFF) | n >> 8 * extra
            return bytes([high]) + (n & (1 << 8 * extra) - 1).to_bytes(extra, "little")
    raise AssertionError


def _bit_field(flags: list[bool]) -> bytes:
    return np.packbits(np.array(flags, bool)).tobytes()


class SevenZip(_Spooled):
    """One solid LZMA2 folder, or stored members at level 0; no encryption."""

    DICT = 1 << 20  #: property byte 16

    def __init__(self, f, level: int | None):
        super().__init__(f)
        preset = 6 if level is None else level
        self.stored = preset <= 0
        self.z = None if self.stored else lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": min(preset, 9), "dict_size": self.DICT}])

    def add(self, path: str, content: bytes) -> None:
        self.entries.append((path, len(content), zlib.crc32(content)))
        self.body.write(content if self.stored else self.z.compress(content))

    def close(self) -> None:
        if self.z is not None:
            self.body.write(self.z.flush())
        packed, full = self.body.tell(), [e for e in self.entries if e[1]]
        header = b"\x01"
        if full:
            coder = b"\x01\x00" if self.stored else b"\x21\x21\x01\x10"
            sums = b"\x0a\x01" + b"".join(struct.pack("<I", c) for _, _, c in full)
            header += b"\x04\x06" + _number(0) + _number(1) + b"\x09" + _number(packed) + b"\x00"
            header += b"\x07\x0b" + _number(1) + b"\x00" + _number(1) + coder + b"\x0c" + _number(sum(e[1] for e in full)) + b"\x00"
            header += b"\x08\x0d" + _number(len(full)) + b"\x09" + b"".join(_number(e[1]) for e in full[:-1]) + sums + b"\x00\x00"
        names = b"\x00" + b"".join(p.encode("utf-16-le") + b"\0\0" for p, _, _ in self.entries)
        header += b"\x05" + _number(len(self.entries))
        if len(full) < len(self.entries):
            empty = _bit_field([not e[1] for e in self.entries])
            files = _bit_field([True] * (len(self.entries) - len(full)))
            header += b"\x0e" + _number(len(empty)) + empty + b"\x0f" + _number(len(files)) + files
        header += b"\x11" + _number(len(names)) + names + b"\x00\x00"
        start = struct.pack("<QQI", packed if full else 0, len(header), zlib.crc32(header))
        self.f.write(b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(start)) + start)
        if full:
            self._pour()
        self.f.write(header)


# RAR 5, stored


def _vint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


class Rar:
    """Stored members. With ``volume_bytes``, ``parts`` opens each volume and members run on from one into the next."""

    SIGNATURE = b"Rar!\x1a\x07\x01\x00"

    def __init__(self, f, volume_bytes: int | None = None, parts=None):
        self.f, self.most, self.parts, self.volume = f, volume_bytes, parts, 0
        self._open()

    def _block(self, kind: int, flags: int, body: bytes, data: bytes = b"") -> None:
        inner = _vint(kind) + _vint(flags | (2 if kind == 2 else 0)) + (_vint(len(data)) if kind == 2 else b"") + body
        head = _vint(len(inner)) + inner
        self.f.write(struct.pack("<I", zlib.crc32(head)) + head + data)
        self.used += len(data)

    def _open(self) -> None:
        self.used = 0
        self.f.write(self.SIGNATURE)
        archive = 0 if self.most is None else 1 | (2 if self.volume else 0)
        self._block(1, 0, _vint(archive) + (_vint(self.volume) if archive & 2 else b""))

    def _next(self) -> None:
        self._block(5, 0, _vint(1))
        self.f.close()
        self.volume += 1
        self.f = self.parts(self.volume)
        self._open()

    def add(self, path: str, content: bytes) -> None:
        raw, at = path.encode(), 0
        while True:
            room = len(content) - at if self.most is None else self.most - self.used
            if room <= 0 and len(content) > at:
                self._next()
                continue
            part = content[at : at + room]
            flags = (8 if at else 0) | (16 if at + len(part) < len(content) else 0)
            self._block(2, flags, _vint(0) + _vint(len(content)) + _vint(0) + _vint(0) + _vint(1) + _vint(len(raw)) + raw, part)
            at += len(part)
            if at >= len(content):
                return

    def close(self) -> None:
        self._block(5, 0, _vint(0))


# ISO 9660


class Iso(_Spooled):
    """Level-2 names as given (no case folding), directories of any depth."""

    def add(self, path: str, content: bytes) -> None:
        self.entries.append((path, self.body.tell() // _SECTOR, len(content)))
        self.body.write(content)
        self.body.write(bytes(-len(content) % _SECTOR))

    @staticmethod
    def _record(name: bytes, sector: int, size: int, folder: bool) -> bytes:
        n = 33 + len(name) + (len(name) + 1) % 2
        both = struct.pack("<I", sector) + struct.pack(">I", sector) + struct.pack("<I", size) + struct.pack(">I", size)
        out = bytes([n, 0]) + both + bytes(7) + bytes([2 if folder else 0, 0, 0]) + struct.pack("<H", 1) + struct.pack(">H", 1) + bytes([len(name)]) + name
        return out.ljust(n, b"\0")

    def close(self) -> None:
        folders: dict[str, dict[str, tuple | None]] = {"": {}}
        for path, at, size in self.entries:
            parent, _, name = path.rpartition("/")
            steps = parent.split("/") if parent else []
            for k, step in enumerate(steps):
                folders["/".join(steps[:k])].setdefault(step, None)
                folders.setdefault("/".join(steps[: k + 1]), {})
            folders[parent][name] = (at, size)

        def laid(records: list[bytes]) -> bytes:  # a record doesn't cross a sector
            out = bytearray()
            for r in records:
                if len(out) % _SECTOR + len(r) > _SECTOR:
                    out += bytes(-len(out) % _SECTOR)
                out += r
            return bytes(out) + bytes(-len(out) % _SECTOR)

        def records(folder: str, where: dict[str, tuple[int, int]], data: int) -> list[bytes]:
            own, above = where[folder], where[folder.rpartition("/")[0]]
            out = [self._record(b"\0", *own, True), self._record(b"\1", *above, True)]
            for name, file in sorted(folders[folder].items()):
                child = f"{folder}/{name}" if folder else name
                out.append(self._record(name.encode("latin-1") + b";1", data + file[0], file[1], False) if file else self._record(name.encode("latin-1"), *where[child], True))
            return out

        order = sorted(folders, key=lambda p: (p.count("/") + bool(p), p))
        sizes = {p: len(laid(records(p, dict.fromkeys(folders, (0, 0)), 0))) for p in order}
        where, at = {}, 18
        for p in order:
            where[p] = (at, sizes[p])
            at += sizes[p] // _SECTOR
        root = self._record(b"\0", *where[""], True)
        pvd = (b"\x01CD001\x01\x00" + b" " * 64 + bytes(84) + root).ljust(_SECTOR, b"\0")
        self.f.write(bytes(16 * _SECTOR) + pvd + b"\xffCD001\x01".ljust(_SECTOR, b"\0"))
        for p in order:
            self.f.write(laid(records(p, where, at)))
        self._pour()


# NSA


def lzss_packed(data: bytes) -> bytes:
    """For a 256-byte ring filled from place 239: matches are looked for where the same two bytes were written last."""
    bits: list[int] = []
    seen: dict[bytes, int] = {}  # places of pairs, by their first byte's index
    i, n = 0, len(data)
    while i < n:
        pair, length = data[i : i + 2], 0
        j = seen.get(pair, -1)
        if len(pair) == 2 and 0 < i - j <= 256 - 17 and j >= 0:
            while length < 17 and i + length < n and data[j + length] == data[i + length]:
                length += 1
        if length >= 2:
            bits.append((length - 2) | ((239 + j) & 255) << 4 | 1 << 20)  # marked by bit 20: 13 bits, the first 0
        else:
            length = 1
            bits.append(data[i] | 256)  # 9 bits, the first 1
        for k in range(i, min(i + length, n - 1)):
            seen[data[k : k + 2]] = k
        i += length
    text = "".join(f"{b & 0xFFFFF:013b}" if b >> 20 else f"{b:09b}" for b in bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def spb_packed(width: int, height: int, pixels: np.ndarray) -> bytes:
    """An image (height, width, 3) of blue, green and red bytes; each group of four differences takes the least width."""
    out = [f"{width:016b}{height:016b}"]
    rows = pixels.astype(np.int64).copy()
    rows[1::2] = rows[1::2, ::-1]
    for channel in range(3):
        plane = rows[:, :, channel].reshape(-1)
        plane = np.concatenate([plane, np.repeat(plane[-1:], -(len(plane) - 1) % 4)])
        out.append(f"{plane[0]:08b}")
        step = (np.diff(plane) + 128) % 256 - 128
        code = np.where(step > 0, 2 * step - 1, -2 * step)
        for g, now in zip(code.reshape(-1, 4).tolist(), plane[1:].reshape(-1, 4).tolist(), strict=True):
            most = max(g)
            if most == 0:
                out.append("000")
            elif most < 4:
                w = 1 if most < 2 else 2
                out.append("111" + f"{w - 1:b}" + "".join(f"{c:0{w}b}" for c in g))
            elif most < 128:
                w = most.bit_length()
                out.append(f"{w - 2:03b}" + "".join(f"{c:0{w}b}" for c in g))
            else:
                out.append("110" + "".join(f"{v:08b}" for v in now))
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


class Nsa(_Spooled):
    """Members with suffix .bmp of a 24-bit bitmap are packed as images; others by LZSS if a level above 0 asks for it."""

    def __init__(self, f, level: int | None):
        super().__init__(f)
        self.packs = bool(level)

    def add(self, path: str, content: bytes) -> None:
        method, data = 0, content
        if path.lower().endswith(".bmp") and content[:2] == b"BM":
            width, height = struct.unpack_from("<ii", content, 18)
            stride = (3 * width + 3) // 4 * 4
            rows = np.frombuffer(content, np.uint8, stride * height, 54).reshape(height, stride)
            method, data = 1, spb_packed(width, height, rows[::-1, : 3 * width].reshape(height, width, 3))
        elif self.packs and content:
            method, data = 2, lzss_packed(content)
        self.entries.append((path.encode(), method, self.body.tell(), len(data), len(content)))
        self.body.write(data)

    def close(self) -> None:
        head = b"".join(name + b"\0" + struct.pack(">BIII", *rest) for name, *rest in self.entries)
        self.f.write(struct.pack(">HI", len(self.entries), 6 + len(head)) + head)
        self._pour()


# YPF


class Ypf(_Spooled):
    def add(self, path: str, content: bytes) -> None:
        data = zlib.compress(content)
        packed = len(data) < len(content)
        self.entries.append((path.encode("shift_jis"), packed, len(content), self.body.tell(), len(data) if packed else len(content)))
        self.body.write(data if packed else content)

    def close(self) -> None:
        from packspan.sources.containers import ypf_marker

        head = 0x20 + sum(5 + len(e[0]) + 22 for e in self.entries)
        self.f.write(struct.pack("<4sIII16x", b"YPF\0", 500, len(self.entries), head))
        for raw, packed, size, at, stored in self.entries:
            name = bytes(b ^ 0xFF for b in raw)
            self.f.write(struct.pack("<IB", zlib.crc32(raw), ypf_marker(len(raw))) + name + struct.pack("<BBIIIII", 0, packed, size, stored, head + at if stored else 0x20, 0, 0)[:22])
        self._pour()


# XP3


class Xp3(_Spooled):
    def add(self, path: str, content: bytes) -> None:
        data = zlib.compress(content)
        packed = len(data) < len(content)
        self.entries.append((path, packed, len(content), self.body.tell(), len(data) if packed else len(content), zlib.adler32(content)))
        self.body.write(data if packed else content)

    def close(self) -> None:
        start, size, index = 19, self.body.tell(), []
        for path, packed, full, at, stored, check in self.entries:
            raw = path.encode("utf-16-le")
            parts = [(b"info", struct.pack("<IQQH", 0, full, stored, len(raw) // 2) + raw + b"\0\0"), (b"segm", struct.pack("<IQQQ", packed, start + at, full, stored)), (b"adlr", struct.pack("<I", check))]
            chunk = b"".join(tag + struct.pack("<Q", len(b)) + b for tag, b in parts)
            index.append(b"File" + struct.pack("<Q", len(chunk)) + chunk)
        plain = b"".join(index)
        z = zlib.compress(plain)
        self.f.write(b"XP3\r\n \n\x1a\x8bg\x01" + struct.pack("<Q", start + size))
        self._pour()
        self.f.write(b"\x01" + struct.pack("<QQ", len(z), len(plain)) + z)


# PFS


class Pfs(_Spooled):
    """PF6, or PF8 if ``locked``: members are then xored with the digest of the index."""

    def __init__(self, f, locked: bool):
        super().__init__(f)
        self.locked = locked

    def add(self, path: str, content: bytes) -> None:
        self.entries.append((path.encode(), self.body.tell(), len(content)))
        self.body.write(content)

    def close(self) -> None:
        size = 4 + sum(16 + len(e[0]) for e in self.entries)
        index = struct.pack("<I", len(self.entries)) + b"".join(struct.pack("<I", len(raw)) + raw + struct.pack("<III", 0, 7 + size + at, n) for raw, at, n in self.entries)
        self.f.write((b"pf8" if self.locked else b"pf6") + struct.pack("<I", size) + index)
        if not self.locked:
            self._pour()
            return
        key = np.frombuffer(hashlib.sha1(index).digest(), np.uint8)
        self.body.seek(0)
        for _, _, n in self.entries:
            self.f.write((np.frombuffer(self.body.read(n), np.uint8) ^ np.resize(key, n)).tobytes())
        self.body.close()
