"""Containers built byte by byte: listings, decoded members, damaged and hostile input, and what the sinks write."""

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from packspan.operators import files
from packspan.sinks import archive as sinks
from packspan.sinks import formats
from packspan.sources import archive, containers, sevenzip  # noqa: F401  registers its reader


def stuff(seed, n):
    """Bytes in which short runs come again."""
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 256, rng.integers(1, 12), dtype=np.uint8).tobytes() for _ in range(20)]
    out = b"".join(words[i] for i in rng.integers(0, 20, n))
    return out[:n]


def packed(kind, files, **options):
    out = io.BytesIO()
    w = {"nsa": formats.Nsa, "ypf": formats.Ypf, "iso": formats.Iso, "xp3": formats.Xp3, "pfs": formats.Pfs, "rar": formats.Rar, "7z": formats.SevenZip}[kind](out, **options)
    for path, content in files:
        w.add(path, content)
    w.close()
    return out.getvalue()


class _Volume(io.BytesIO):
    def close(self):
        pass


def rar_volumes(files, most):
    parts = [_Volume()]
    w = formats.Rar(parts[0], most, lambda n: parts.append(_Volume()) or parts[-1])
    for path, content in files:
        w.add(path, content)
    w.close()
    return [p.getvalue() for p in parts]


def read(kind, data, **options):
    found = containers.READERS[kind](io.BytesIO(data), containers.Options(**options))
    return {m.path: b"".join(m.content()) if m.content else m.error for m in found if not m.is_dir}


def sevenzip(files):
    """Members in one LZMA2 folder, headers as they are."""
    filters = [{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}]
    whole = b"".join(c for _, c in files)
    data = lzma.compress(whole, lzma.FORMAT_RAW, filters=filters)
    num = lambda n: bytes([0xFF]) + struct.pack("<Q", n)
    head = b"\x01\x04\x06" + num(0) + num(1) + b"\x09" + num(len(data)) + b"\0"
    head += b"\x07\x0b" + num(1) + b"\0" + num(1) + b"\x21\x21" + num(1) + b"\x10" + b"\x0c" + num(len(whole)) + b"\0"
    head += b"\x08\x0d" + num(len(files)) + b"\x09" + b"".join(num(len(c)) for _, c in files[:-1]) + b"\0\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in files)
    head += b"\x05" + num(len(files)) + b"\x11" + num(len(names)) + names + b"\0\0"
    return b"7z\xbc\xaf\x27\x1c\0\4" + bytes(4) + struct.pack("<QQI", len(data), len(head), zlib.crc32(head)) + data + head


def tar(mode, members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, content, kind in members:
            info = tarfile.TarInfo(name)
            info.type, info.size = kind, len(content)
            info.linkname = "a.txt" if kind == tarfile.SYMTYPE else ""
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("archives")
    long = stuff(1, 50_000)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("dir\\a.txt", "greetings")
        f.writestr("b/", "")
        f.writestr("../evil.txt", "outside")
        f.writestr("long.bin", long)
    volumes = rar_volumes([("one.txt", b"first"), ("long.bin", stuff(7, 2500)), ("two.txt", b"last")], 1024)
    assert len(volumes) == 3
    split = sevenzip([("a.txt", b"in two halves"), ("b.bin", stuff(3, 512))])
    three = [("a.txt", long, tarfile.REGTYPE), ("sub/b.bin", b"one level down", tarfile.REGTYPE), ("link", b"", tarfile.SYMTYPE), ("d", b"", tarfile.DIRTYPE)]
    body = stuff(2, 100_000)
    files = {
        "x.zip": z.getvalue(),
        "x.tar": tar("w", three),
        "x.tgz": tar("w:gz", three),
        "x.tar.bz2": tar("w:bz2", three),
        "x.txz": tar("w:xz", three),
        "x.tzst": zstandard.compress(tar("w", three)),
        "m.bin.gz": gzip.compress(b"part one, ") + gzip.compress(b"part two"),
        "m.bin.bz2": bz2.compress(body),
        "m.bin.xz": lzma.compress(body),
        "m.bin.lzma": lzma.compress(body, lzma.FORMAT_ALONE),
        "m.bin.zst": zstandard.compress(body),
        "x.nsa": packed("nsa", [("a/stored.bin", stuff(4, 5000)), ("empty.txt", b"")], level=0),
        "y.nsa": packed("nsa", [("b/lzss.bin", stuff(5, 600)), ("empty.txt", b"")], level=1),
        "bomb.nsa": struct.pack(">HI", 1, 29) + b"large.bin\0" + struct.pack(">BIII", 2, 0, 0xC0000000, 100) + b"1234",
        "x.ypf": packed("ypf", [("a/z_long.bin", body), ("b/raw.binary", stuff(6, 40)), ("7bytes.", b"a name whose length has no marker")]),
        "x.iso": packed("iso", [("README.TXT", b"read me"), ("sub/deep/x.bin", body), ("sub/none", b"")]),
        "x.xp3": packed("xp3", [("a/one.ks", b"one" * 50), ("two.txt", b"two")]),
        "x.pfs": packed("pfs", [("s/one.ast", b"artemis"), ("two.txt", stuff(6, 300))], locked=True),
        "x.rar": packed("rar", [("data/file.bin", stuff(7, 4096)), ("data/empty", b"")]),
        "v.part1.rar": volumes[0],
        "v.part2.rar": volumes[1],
        "v.part3.rar": volumes[2],
        "s.7z.001": split[: len(split) // 2],
        "s.7z.002": split[len(split) // 2 :],
        "cut.zip": z.getvalue()[:200],
        "cut.gz": gzip.compress(body)[:200],
        "cut.xz": lzma.compress(body)[:100],
        "bad.7z": b"plain text, whatever its name says",
        "zero.ypf": b"",
    }
    for name, data in files.items():
        (d / name).write_bytes(data)
    return d


def decoded(spark, path, **options):
    rows = archive.whole(archive.members(spark, str(path), **options)).collect()
    return {r.path: (bytes(r.content) if r.content is not None else None, r.error) for r in rows}


@given(st.binary(max_size=700), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_ring_compression_round_trip(data, times):
    data = data * (times + 1)
    assert containers.lzss(formats.lzss_packed(data), len(data)) == data


@given(st.integers(1, 19), st.integers(1, 9), st.integers(0, 2**32), st.sampled_from([0, 1, 2, 30, 256]))
@settings(max_examples=60, deadline=None)
def test_image_compression_round_trip(width, height, seed, spread):
    rng = np.random.default_rng(seed)
    step = rng.integers(-spread, spread + 1, (height, width, 3))
    pixels = (np.cumsum(step, 1) % 256).astype(np.uint8)
    data = formats.spb_packed(width, height, pixels)
    image = containers.spb(data)
    stride = (3 * width + 3) // 4 * 4
    assert struct.unpack_from("<2sIIIIii", image) == (b"BM", 54 + stride * height, 0, 54, 40, width, height)
    rows = np.frombuffer(image, np.uint8, offset=54).reshape(height, stride)
    assert (rows[::-1, : 3 * width].reshape(height, width, 3) == pixels).all() and (rows[:, 3 * width :] == 0).all()
    with pytest.raises(ValueError):
        containers.spb(data[: len(data) // 2])
    with pytest.raises(ValueError):
        containers.spb(data, limit=57)


def test_pixels_of_a_known_image():
    """Two pixels by two, worked out by hand: blue 7, 7, 8, 6 along the path; green 0, 200, 1, 9; red all 3."""
    bits = "00000111" + "001" + "000" + "001" + "100" + "000"
    bits += "00000000" + "110" + "11001000" + "00000001" + "00001001" + "00001001"
    bits += "00000011" + "000"
    bits += "0" * (-len(bits) % 8)
    image = containers.spb(struct.pack(">HH", 2, 2) + int(bits, 2).to_bytes(len(bits) // 8, "big"))
    top, bottom = image[62:68], image[54:60]
    assert list(top) == [7, 0, 3, 7, 200, 3] and list(bottom) == [6, 9, 3, 8, 1, 3]


name_st = st.lists(st.text(alphabet="abcXYZ01_", min_size=1, max_size=12), min_size=1, max_size=3).map("/".join)


@given(st.dictionaries(name_st, st.binary(max_size=300), max_size=6))
@settings(max_examples=40, deadline=None)
def test_every_container_gives_back_what_was_packed(members):
    members = {p: c for p, c in members.items() if not any(q != p and q.startswith(p + "/") for q in members) and len(p) >= 4}
    for kind, options in (("7z", {"level": 5}), ("7z", {"level": 0}), ("rar", {}), ("iso", {}), ("nsa", {"level": 0}), ("nsa", {"level": 1}), ("xp3", {}), ("pfs", {"locked": True}), ("pfs", {"locked": False}), ("ypf", {})):
        if kind != "ypf" or members:
            assert read(kind, packed(kind, members.items(), **options)) == members, kind
    for most in (1, 50, 1000):
        assert read("rar", b"".join(rar_volumes(members.items(), most))) == members


def test_volumes_that_are_missing_and_names_that_come_again():
    parts = rar_volumes([("a", b"1" * 100), ("b", b"2" * 250), ("c", b"3")], 100)
    assert read("rar", b"".join(parts[:2])) == {"a": b"1" * 100, "b": "continues in another volume"}
    assert read("rar", b"".join(parts[2:])) == {"b": "begins in another volume", "c": b"3"}
    twice = packed("rar", [("a", b"first"), ("b", b"x")]) + packed("rar", [("a", b"second"), ("c", b"y")])
    assert read("rar", twice) == {"a": b"first", "b": b"x", "c": b"y"}


def test_old_rar_volumes():
    def block(kind, flags, body, data=b""):
        return struct.pack("<HBHH", 0, kind, flags, 7 + len(body)) + body + data

    def file(name, part, size, flags):
        return block(0x74, 0x8000 | flags, struct.pack("<IIBIIBBHI", len(part), size, 0, 0, 0, 20, 0x30, len(name), 0) + name, part)

    mark = b"Rar!\x1a\x07\x00" + block(0x73, 0, bytes(6))
    one = mark + file(b"a.txt", b"alpha", 5, 0) + file(b"b.txt", b"be", 4, 2) + block(0x7B, 0x4000, b"")
    two = mark + file(b"b.txt", b"ta", 4, 1) + file(b"c.txt", b"gamma", 5, 0)
    assert read("rar", one + two) == {"a.txt": b"alpha", "b.txt": b"beta", "c.txt": b"gamma"}


def test_directories_with_damage_keep_what_is_whole():
    good = packed("ypf", [("dir/some_name.txt", b"content" * 9), ("other/name.bin", b"raw")])
    assert read("ypf", good) == {"dir/some_name.txt": b"content" * 9, "other/name.bin": b"raw"}
    far = bytearray(good)
    struct.pack_into("<I", far, 0x20 + 5 + len("dir/some_name.txt") + 10, 1 << 30)  # its offset
    assert read("ypf", bytes(far)) == {"dir/some_name.txt": "range outside the file", "other/name.bin": b"raw"}
    for bad in (b"YPF\0" + bytes(28), b"YPX\0" + good[4:], good[:0x30]):
        with pytest.raises((ValueError, struct.error)):
            read("ypf", bad)


def test_members_of_every_format(spark, folder):
    long, body = stuff(1, 50_000), stuff(2, 100_000)
    z = decoded(spark, folder / "x.zip")
    assert z["dir/a.txt"] == (b"greetings", None) and z["long.bin"][0] == long and z["../evil.txt"][0] == b"outside"
    for name in ("x.tar", "x.tgz", "x.tar.bz2", "x.txz", "x.tzst"):
        assert decoded(spark, folder / name) == {"a.txt": (long, None), "sub/b.bin": (b"one level down", None)}, name
    assert decoded(spark, folder / "m.bin.gz") == {"m.bin": (b"part one, part two", None)}
    for codec in ("bz2", "xz", "lzma", "zst"):
        assert decoded(spark, folder / f"m.bin.{codec}") == {"m.bin": (body, None)}, codec
    assert decoded(spark, folder / "x.nsa") == {"a/stored.bin": (stuff(4, 5000), None), "empty.txt": (b"", None)}
    assert decoded(spark, folder / "y.nsa") == {"b/lzss.bin": (stuff(5, 600), None), "empty.txt": (b"", None)}
    assert decoded(spark, folder / "bomb.nsa") == {"large.bin": (None, "range outside the file")}
    assert decoded(spark, folder / "x.ypf") == {"a/z_long.bin": (body, None), "b/raw.binary": (stuff(6, 40), None), "7bytes.": (b"a name whose length has no marker", None)}
    assert decoded(spark, folder / "x.iso") == {"README.TXT": (b"read me", None), "sub/deep/x.bin": (body, None), "sub/none": (b"", None)}
    assert decoded(spark, folder / "x.xp3") == {"a/one.ks": (b"one" * 50, None), "two.txt": (b"two", None)}
    assert decoded(spark, folder / "x.pfs") == {"s/one.ast": (b"artemis", None), "two.txt": (stuff(6, 300), None)}
    assert decoded(spark, folder / "x.rar") == {"data/file.bin": (stuff(7, 4096), None), "data/empty": (b"", None)}
    assert decoded(spark, folder / "v.part*.rar", volumes="true") == {"one.txt": (b"first", None), "long.bin": (stuff(7, 2500), None), "two.txt": (b"last", None)}
    assert decoded(spark, folder / "s.7z.*", volumes="true") == {"a.txt": (b"in two halves", None), "b.bin": (stuff(3, 512), None)}


def test_chunks_selection_and_limits(spark, folder):
    chunks = archive.members(spark, str(folder / "x.tar"), chunk_bytes=16_384).where("path = 'a.txt'").orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.offset, len(r.content)) for r in chunks] == [(0, 0, 16_384), (1, 16_384, 16_384), (2, 32_768, 16_384), (3, 49_152, 848)]
    assert set(decoded(spark, folder / "x.tar", selection="sub\n")) == {"sub/b.bin"}
    assert set(decoded(spark, folder / "x.tar", selection="su")) == set()
    assert decoded(spark, folder / "x.tar", max_member_bytes=100)["a.txt"][1] == "member exceeds configured limit"


def test_catalog_and_damaged_files(spark, folder):
    rows = archive.entries(spark, str(folder)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.archive.rpartition("/")[2], []).append(r)
    for name in ("cut.zip", "bad.7z", "zero.ypf"):
        assert [r.path for r in by[name]] == [None] and by[name][0].error, name
    assert {r.path: r.entry_type for r in by["x.tar"]} == {"a.txt": "file", "sub/b.bin": "file", "link": "link", "d": "dir"}
    assert [(r.path, r.size) for r in by["m.bin.gz"]] == [("m.bin", 8)] and by["m.bin.lzma"][0].size is None
    assert {(r.path, r.depth, r.ext) for r in by["x.zip"]} >= {("dir/a.txt", 1, "txt"), ("b", 0, "b")}
    for name in ("cut.gz", "cut.xz"):
        assert [r.error is not None for r in archive.members(spark, str(folder / name)).collect()].count(True) == 1
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW a USING archive_entries OPTIONS (path '{folder}/x.zip')")
    assert spark.sql("select count(*) from a where raw_path like '%.txt'").first()[0] == 2


def test_whole_members_of_many_chunks_and_damage(spark, tmp_path):
    long = stuff(1, 50_000)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("bad.bin", long)
        f.writestr("good.bin", long[::-1])
    raw = bytearray(z.getvalue())
    raw[45_000] ^= 1  # in the second chunk of the first member
    (tmp_path / "x.zip").write_bytes(raw)
    (tmp_path / "log.01").write_bytes(b"a log")
    (tmp_path / "log.02").write_bytes(b"another")
    chunks = archive.members(spark, str(tmp_path / "x.zip"), chunk_bytes=16_384)
    for rows in (archive.whole(chunks).collect(), archive.whole_members(spark, str(tmp_path / "x.zip")).collect()):
        got = {r.path: r for r in rows}
        assert got["bad.bin"].error and got["bad.bin"].content is None
        assert bytes(got["good.bin"].content) == long[::-1] and got["good.bin"].error is None
    assert {r.archive.rpartition("/")[2]: r.error for r in archive.entries(spark, str(tmp_path / "log.*"), volumes="true").collect()} == {"log.01": "unknown format", "log.02": "unknown format"}


def test_folders_are_walked_and_listed(spark, tmp_path):
    for path, n in (("b/x.txt", 3), ("b/c/y.zip", 5), ("A.txt", 7), ("a2/z", 0)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(bytes(n))
    found = files.walk(spark, tmp_path.as_uri()).cache()
    assert sorted((r.path, r.name, r.size) for r in found.collect()) == [("A.txt", "A.txt", 7), ("a2/z", "z", 0), ("b/c/y.zip", "y.zip", 5), ("b/x.txt", "x.txt", 3)]
    assert [tuple(r) for r in files.listing(found).collect()] == [("a2", True, 0), ("b", True, 8), ("A.txt", False, 7)]
    assert [tuple(r) for r in files.listing(found, "/b/").collect()] == [("c", True, 5), ("x.txt", False, 3)]
    assert files.listing(found, "none").count() == 0 and tuple(files.bytes_to_compress(found).first()) == (3, 10)
    other = found.where("path <> 'a2/z'").selectExpr("path", "size + cast(path = 'A.txt' as long) as size")
    assert {r.path: r.same for r in files.compared(found, other).collect()} == {"A.txt": False, "a2/z": False, "b/c/y.zip": True, "b/x.txt": True}


@pytest.mark.parametrize("fmt", ["zip", "tar", "tgz", "tbz2", "txz", "tzst", "7z", "rar", "iso", "nsa", "ypf", "xp3", "pf6", "pf8"])
def test_packed_archives_read_back(spark, tmp_path, fmt):
    rows = [("one", "a.txt", b"alpha"), ("one", "sub/b.bin", stuff(8, 70_000)), ("two", "c.txt", b""), ("two", "d.txt", None)]  # what has no content is skipped
    sinks.pack(spark.createDataFrame(rows, "target string, path string, content binary"), str(tmp_path), fmt, 6)
    got = archive.whole(archive.members(spark, str(tmp_path))).collect()
    assert sorted((r.archive.rpartition("/")[2].split(".")[0], r.path, bytes(r.content)) for r in got) == sorted(rows[:3])
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_single_streams_and_refusals(spark, tmp_path):
    one = spark.createDataFrame([("x.bin", "x.bin", stuff(9, 80_000))], "target string, path string, content binary")
    for fmt in ("gz", "bz2", "xz", "zst", "lzma", "lz4"):
        sinks.pack(one, str(tmp_path / fmt), fmt, 3)
        assert decoded(spark, tmp_path / fmt) == {"x.bin": (stuff(9, 80_000), None)}, fmt
    two = one.union(one)
    with pytest.raises(Exception, match="one member"):
        sinks.pack(two, str(tmp_path / "two"), "gz")
    assert list((tmp_path / "two").iterdir()) == []
    with pytest.raises(ValueError, match="unsafe"):
        sinks.pack(spark.createDataFrame([("t", "../x", b"")], "target string, path string, content binary"), str(tmp_path), "zip")


def test_unpack_keeps_inside_its_folder(spark, folder, tmp_path):
    out = tmp_path / "out"
    outcome = sinks.unpack(archive.whole(archive.members(spark, str(folder / "x.zip"))), str(out)).collect()
    assert {r.path: r.error for r in outcome} == {"dir/a.txt": None, "long.bin": None, "../evil.txt": "parent step in path"}
    assert (out / "dir" / "a.txt").read_bytes() == b"greetings" and not (tmp_path / "evil.txt").exists()
