"""Scalar functions: sizes, checksums, states, formats and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packspan.functions.paths import _c, extension

# File extensions of archives, of files that can be previewed, and of texts that content search reads.
ARCHIVE_EXTENSIONS = "xp3 pfs pf6 pf8 nsa sar iso ypf zip 7z rar lz4 gz bz2 xz zst lzma tar tgz tbz2 txz".split()
PREVIEW_EXTENSIONS = "jpg jpeg png mp3 ogg mp4 txt json ini ks lua py js html css xml cfg log".split()
TEXT_EXTENSIONS = (
    "txt json ini ks lua py js html css xml cfg log rtf md yaml yml toml conf properties sh java kt rs "
    "c cpp h hpp swift rb php pl sql tsv srt ass lrc bat cmd ps1 go dart r csv"
).split()

#: Format key: (label, group, output extension or none).
FORMATS = {
    "xp3": ("XP3", "galgame", None),
    "pfs": ("PFS/PF6/PF8", "galgame", None),
    "nsa": ("NSA/SAR", "galgame", None),
    "iso": ("ISO", "galgame", None),
    "ypf": ("YPF", "galgame", None),
    "zip": ("ZIP", "generic", "zip"),
    "7z": ("7z", "generic", "7z"),
    "rar": ("RAR", "generic", None),
    "lz4": ("LZ4", "single", "lz4"),
    "tar": ("TAR", "generic", "tar"),
    "tgz": ("TAR.GZ", "generic", "tar.gz"),
    "tbz2": ("TAR.BZ2", "generic", "tar.bz2"),
    "txz": ("TAR.XZ", "generic", "tar.xz"),
    "tzst": ("TAR.ZST", "generic", "tar.zst"),
    "gz": ("GZIP", "single", "gz"),
    "bz2": ("BZIP2", "single", "bz2"),
    "xz": ("XZ", "single", "xz"),
    "zst": ("ZSTD", "single", "zst"),
    "lzma": ("LZMA", "single", "lzma"),
}
#: What failures say.
PASSWORD_WORDS = ("wrong password", "bad password", "password required", "maybe bad password", "checksum verification failed")
LARGE_WORDS = ("buffered", "configured limit", "decode limit", "memory")


def size_label(n: str | Column) -> Column:
    """``1.25 GB``, ``3.4 MB``, ``5.6 KB`` or ``7 B``; the point is always a point."""
    n = _c(n)
    out = F.when(n >= 1 << 30, F.format_string("%.2f GB", n / float(1 << 30)))
    out = out.when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20)))
    return out.when(n >= 1 << 10, F.format_string("%.1f KB", n / float(1 << 10))).otherwise(F.format_string("%d B", n))


def md5_hex(content: str | Column) -> Column:
    return F.md5(_c(content).cast("binary"))


def sha256_hex(content: str | Column) -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def error_class(message: str | Column) -> Column:
    """What to tell a user about a failure: no message, wrong password, large member or the general case."""
    m = F.lower(_c(message))
    return F.when(m.isNull() | (m == ""), "failed").when(_any_of(m, PASSWORD_WORDS), "wrong_password").when(_any_of(m, LARGE_WORDS), "large_member").otherwise("io")


def percent(done: str | Column, total: str | Column) -> Column:
    """Whole percents, at most 100; null where the total isn't known."""
    d, t = _c(done), _c(total)
    return F.when(t > 0, F.least(F.lit(100).cast("long"), F.floor(d * F.lit(100) / t).cast("long")))


def bar_state(total: str | Column) -> Column:
    """How a file's progress is shown: percent from 1 MiB on, hidden below, indeterminate if the size isn't known."""
    t = _c(total)
    return F.when(t >= 1 << 20, "percent").when(t >= 1, "hidden").otherwise("indeterminate")


def minute_label(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm")


#: Suffixes that stand for a format of another name.
_ALIASES = {"tar.gz": "tgz", "tar.bz2": "tbz2", "tar.xz": "txz", "tar.zst": "tzst", "pf6": "pfs", "pf8": "pfs", "sar": "nsa"}


def format_key(file_name: str | Column) -> Column:
    """Format of a file by its name; compressed tar names come before their last suffix. Null if unknown."""
    f = F.lower(_c(file_name))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, key in (*_ALIASES.items(), *((k, k) for k in FORMATS)):
        out = out.when(f.endswith(f".{suffix}"), key)
    return out


def _format_map(field: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v[field])])


def format_label(key: str | Column) -> Column:
    return _format_map(0)[_c(key)]


def format_group(key: str | Column) -> Column:
    return _format_map(1)[_c(key)]


def is_archive_name(file_name: str | Column) -> Column:
    return extension(file_name).isin(*ARCHIVE_EXTENSIONS)


def is_preview_name(file_name: str | Column) -> Column:
    return extension(file_name).isin(*PREVIEW_EXTENSIONS)


def is_text_name(file_name: str | Column) -> Column:
    return extension(file_name).isin(*TEXT_EXTENSIONS)


def compression_level(fmt: str, level: int) -> int | None:
    """The level a codec is given for a requested one; None where the codec has no such setting."""
    if fmt == "zip":
        return max(0, min(level, 9))
    if fmt == "7z":
        return 0 if level <= 0 else 3 if level <= 3 else 5 if level <= 6 else 9
    if fmt in ("gz", "tgz"):
        return max(0, min(level, 9))
    if fmt in ("bz2", "tbz2"):
        return max(1, min(level, 9))
    if fmt in ("zst", "tzst"):
        return 3 if level < 1 else min(level, 22)
    return None
