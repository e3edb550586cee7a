"""Queries that pack table rows into archives in the shared folder and read them back through the sources."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspan.functions import scalars
from packspan.operators import catalog, files, results, search
from packspan.runtime import fresh_path, ship, table
from packspan.sinks.archive import pack, unpack
from packspan.sources import archive

#: Documents, and bytes, of an archive, about; a target is packed in one task, so it must be bounded.
MEMBERS_EACH = 2_000
BYTES_EACH = 64 << 20
VOLUME_BYTES = 100_000
#: Formats of many members whose writers and readers are run over every document.
CONTAINERS = ("zip", "7z", "rar", "iso", "nsa", "ypf", "xp3", "pf6", "pf8", "tar", "tgz", "tbz2", "txz", "tzst")
SINGLE = ("gz", "bz2", "xz", "zst", "lzma", "lz4")


def _packed(spark, d: str, fmt: str, name: str = "documents", level: int | None = None, volume_bytes: int | None = None) -> str:
    """Rows as text members ``source/id.txt``, a part of each language's rows to an archive; a null language is ``none``."""
    rows = table(spark, d, name)
    if name == "benchmark":
        rows = rows.select(F.col("item_id").alias("doc_id"), "text", F.lit("items").alias("source"), F.lit("en").alias("lang"))
    rows = rows.withColumn("lang", F.coalesce("lang", F.lit("none")))
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))))
    per = rows.groupBy("lang").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS_EACH), F.ceil(size / BYTES_EACH)).cast("int").alias("parts"))
    # one row for each language
    rows = rows.join(F.broadcast(per) if per.count() <= 10_000 else per, "lang")
    target = F.concat_ws("-", "lang", F.pmod(F.xxhash64("doc_id"), "parts").cast("string"))
    member = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    folder = fresh_path(spark, f"packed-{fmt}")
    pack(rows.select(target.alias("target"), member.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), folder, fmt, level, volume_bytes)
    return folder


def _read(spark, folder: str, **options) -> DataFrame:
    return archive.whole_members(spark, folder, **options).select("path", "size", scalars.md5_hex("content").alias("md5"), "error")


def _members(fmt: str, spark, d: str) -> DataFrame:
    return _read(spark, _packed(spark, d, fmt))


def sevenzip_volumes(spark, d):
    return _read(spark, _packed(spark, d, "7z", volume_bytes=VOLUME_BYTES), volumes="true")


def rar_volumes(spark, d):
    return _read(spark, _packed(spark, d, "rar", volume_bytes=VOLUME_BYTES), volumes="true")


def sevenzip_stored(spark, d):
    return _read(spark, _packed(spark, d, "7z", level=0))


def nsa_lzss(spark, d):
    return _read(spark, _packed(spark, d, "nsa", "benchmark", level=1))


def _selected(fmt: str, options: dict, spark, d: str) -> DataFrame:
    """Members below two directories and one named member, as selections are written: slashes of both kinds, at both ends."""
    return _read(spark, _packed(spark, d, fmt, **({"volume_bytes": VOLUME_BYTES} if options else {})), selection="/src1\nsrc12/\nsrc3\\3.txt\nsrc", **options)


def empty_selection(spark, d):
    return _read(spark, _packed(spark, d, "zip", "benchmark"), selection="").agg(F.count(F.lit(1)).alias("members"))


def _bitmaps(batches):
    """Benchmark items as 24-bit images, eight pixels wide: three bytes of text to a pixel."""
    import struct

    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            raw = (text or "").encode()
            rows = -(-len(raw) // 24)
            out.append(struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 24 * rows, 0, 54, 40, 8, rows, 1, 24, 0, 0, 0, 0, 0, 0) + raw.ljust(24 * rows, b"\0"))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])


def nsa_images(spark, d):
    """Bitmaps stored as compressed images; what the pixels hold is read back."""
    ship(spark)
    items = table(spark, d, "benchmark").select(F.concat(F.lit("img/"), F.col("item_id").cast("string"), F.lit(".bmp")).alias("path"), "text")
    folder = fresh_path(spark, "images")
    pack(items.mapInArrow(_bitmaps, "path string, content binary").select(F.lit("images").alias("target"), "path", "content"), folder, "nsa")
    found = archive.whole_members(spark, folder)
    return found.select("path", F.octet_length("content").cast("long").alias("bytes"), scalars.md5_hex(F.expr("substring(content, 55)")).alias("md5"), "error")


def zip_catalog(spark, d):
    found = archive.entries(spark, _packed(spark, d, "zip"))
    lang = F.regexp_extract("archive", r"/([a-z]+)-[0-9]+\.zip$", 1)
    return catalog.totals(found.withColumn("lang", lang), ["lang"])


def tar_dir_sizes(spark, d):
    return catalog.directory_sizes(archive.entries(spark, _packed(spark, d, "tar")))


def container_catalogs(spark, d):
    """The benchmark items in every container format: files, bytes and whether a password is needed, by format."""
    out = None
    for fmt in CONTAINERS:
        found = archive.entries(spark, _packed(spark, d, fmt, "benchmark")).withColumn("kind", F.lit(fmt))
        one = catalog.totals(found, ["archive", "kind"]).join(catalog.needs_password(found), "archive").select("kind", "files", "bytes", "needs_password")
        out = one if out is None else out.union(one)
    return out


def dirs_before_files(spark, d):
    """Implied directories and members of an archive in the order of a listing."""
    found = archive.entries(spark, _packed(spark, d, "xp3", "benchmark")).select("archive", "path", "size", "is_dir", "ordinal")
    dirs = catalog.implied_dirs(found, ["archive"]).select("archive", F.col("dir").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir"), F.lit(-1).cast("long").alias("ordinal"))
    return catalog.sorted_by_path(dirs.union(found)).select("path", "size", "is_dir")


def archive_content_search(spark, d):
    """Search in members of archives; the catalog isn't needed for hits in contents."""
    members = archive.whole_members(spark, _packed(spark, d, "tzst"))
    texts = members.select("path", F.decode("content", "UTF-8").alias("text"))
    return search.by_content(texts, "tion", max_bytes=None)


def archive_search(spark, d):
    """Names of all entries and texts of all members, searched at once."""
    folder = _packed(spark, d, "7z")
    found = search.in_archives(archive.entries(spark, folder), archive.whole_members(spark, folder), "12", max_bytes=1 << 31)
    return found.select("path", "match_count", "first_line", "snippet")


def extract_counts(spark, d):
    return results.counts(archive.whole_members(spark, _packed(spark, d, "zip")))


def _streams(spark, d: str, fmt: str) -> str:
    """Single-stream files, one for each benchmark item."""
    folder = fresh_path(spark, f"streams-{fmt}")
    items = table(spark, d, "benchmark")
    name = F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit(".txt"))
    pack(items.select(name.alias("target"), name.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), folder, fmt)
    return folder


def _stream_files(fmt: str, spark, d: str) -> DataFrame:
    return archive.whole_members(spark, _streams(spark, d, fmt)).select("path", F.octet_length("content").cast("long").alias("bytes"), scalars.sha256_hex("content").alias("sha256"), "error")


def stream_files(spark, d):
    return _stream_files("zst", spark, d).drop("error")


def stream_catalogs(spark, d):
    """Names of single-stream files, and the sizes that their formats state: gzip does, the others are written without."""
    out = None
    for fmt in SINGLE:
        one = archive.entries(spark, _streams(spark, d, fmt)).select(F.lit(fmt).alias("kind"), "path", F.when(F.lit(fmt == "gz"), F.col("size")).alias("size"), "error")
        out = one if out is None else out.union(one)
    return out


def _page_folder(spark, d: str) -> str:
    """Pages as files ``host/id.html`` in a folder."""
    folder = fresh_path(spark, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    rows = table(spark, d, "pages").select(F.lit("pages").alias("archive"), F.concat(F.lit("site/"), host, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))
    unpack(rows, folder)
    return folder


def folder_walk(spark, d):
    return files.walk(spark, _page_folder(spark, d)).select("path", "name", "size")


def folder_listing(spark, d):
    return files.listing(files.walk(spark, _page_folder(spark, d)), "site")


def folder_bytes(spark, d):
    return files.bytes_to_compress(files.walk(spark, _page_folder(spark, d)))


def folder_compare(spark, d):
    """Sizes of the extracted files against the sizes that an archive of the same pages states."""
    folder = _page_folder(spark, d)
    walked = files.walk(spark, folder)
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    stated = table(spark, d, "pages").select(F.concat(F.lit("site/"), host, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.length("html").cast("long").alias("size"))
    return files.compared(walked, stated)


NAMES = {"7z": "sevenzip"}
QUERIES = {f"{NAMES.get(fmt, fmt)}_members": partial(_members, fmt) for fmt in CONTAINERS}
QUERIES |= {f"{fmt}_files": partial(_stream_files, fmt) for fmt in SINGLE}
QUERIES |= {
    "zip_selected": partial(_selected, "zip", {}),
    "tar_selected": partial(_selected, "tar", {}),
    "sevenzip_selected": partial(_selected, "7z", {}),
    "iso_selected": partial(_selected, "iso", {}),
    "xp3_selected": partial(_selected, "xp3", {}),
    "pf8_selected": partial(_selected, "pf8", {}),
    "rar_selected": partial(_selected, "rar", {}),
    "rar_volumes_selected": partial(_selected, "rar", {"volumes": "true"}),
    "sevenzip_volumes_selected": partial(_selected, "7z", {"volumes": "true"}),
}
QUERIES |= {
    f.__name__: f
    for f in (
        sevenzip_volumes, rar_volumes, sevenzip_stored, nsa_lzss, nsa_images, empty_selection, zip_catalog, tar_dir_sizes, container_catalogs, dirs_before_files,
        archive_content_search, archive_search, extract_counts, stream_files, stream_catalogs, folder_walk, folder_listing, folder_bytes, folder_compare,
    )
}

_PATH = "coalesce(source, 'none') || '/' || coalesce(doc_id::VARCHAR, 'none') || '.txt'"
_TEXT = "coalesce(text, '')"
_LINES = f"string_split(regexp_replace({_TEXT}, '\\r\\n|\\r', chr(10), 'g'), chr(10))"
_ALL = f"SELECT {_PATH} AS path, octet_length(encode({_TEXT}))::BIGINT AS size, md5({_TEXT}) AS md5, NULL::VARCHAR AS error FROM documents"
_ITEMS = "SELECT 'items/' || item_id || '.txt' AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS md5, NULL::VARCHAR AS error FROM benchmark"
_CHOSEN = f"{_ALL} WHERE source IN ('src1', 'src12', 'src') OR {_PATH} = 'src3/3.txt'"
_HITS = f"""l AS (SELECT path, i AS no, lines[i] AS line FROM (SELECT {_PATH} AS path, {_LINES} AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)),
        h AS (SELECT path, count(*)::BIGINT AS match_count, min(no)::INTEGER AS first_line, arg_min(line, no) AS line FROM l WHERE contains(lower(line), 'WORD') GROUP BY path),
        f AS (SELECT path, match_count, first_line, substring(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 120) AS snippet FROM h)"""
_SIZE = "octet_length(encode(coalesce(text, '')))::BIGINT"
_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_PAGE = f"'site/' || {_HOST} || '/' || page_id || '.html'"
_PAGES = f"p AS (SELECT {_PAGE} AS path, {_HOST} AS host, page_id, octet_length(encode(html))::BIGINT AS size, length(html)::BIGINT AS chars FROM pages)"
ORACLES = {f"{NAMES.get(fmt, fmt)}_members": _ALL for fmt in CONTAINERS}
ORACLES |= dict.fromkeys(("sevenzip_volumes", "rar_volumes", "sevenzip_stored"), _ALL)
ORACLES |= dict.fromkeys([k for k in QUERIES if k.endswith("_selected")], _CHOSEN)
ORACLES |= {f"{fmt}_files": f"SELECT 'item-' || item_id || '.txt' AS path, {_SIZE} AS bytes, sha256(coalesce(text, '')) AS sha256, NULL::VARCHAR AS error FROM benchmark" for fmt in SINGLE}
ORACLES |= {
    "nsa_lzss": _ITEMS,
    "nsa_images": f"""SELECT 'img/' || item_id || '.bmp' AS path, 54 + n AS bytes, md5(encode(coalesce(text, '')) || unhex(repeat('00', (n - size)::INTEGER))) AS md5, NULL::VARCHAR AS error
        FROM (SELECT item_id, text, {_SIZE} AS size, ((({_SIZE}) + 23) // 24) * 24 AS n FROM benchmark)""",
    "empty_selection": "SELECT 0::BIGINT AS members",
    "zip_catalog": f"SELECT coalesce(lang, 'none') AS lang, count(*)::BIGINT AS files, sum({_SIZE})::BIGINT AS bytes FROM documents GROUP BY 1",
    "tar_dir_sizes": f"SELECT coalesce(source, 'none') AS dir, count(*)::BIGINT AS files, sum({_SIZE})::BIGINT AS bytes FROM documents GROUP BY 1",
    "container_catalogs": " UNION ALL ".join(f"SELECT '{fmt}' AS kind, count(*)::BIGINT AS files, sum({_SIZE})::BIGINT AS bytes, {str(fmt == 'pf8').lower()} AS needs_password FROM benchmark" for fmt in CONTAINERS),
    "dirs_before_files": f"SELECT 'items' AS path, 0::BIGINT AS size, true AS is_dir UNION ALL SELECT 'items/' || item_id || '.txt', {_SIZE}, false FROM benchmark",
    "archive_content_search": f"WITH {_HITS.replace('WORD', 'tion')} SELECT * FROM f",
    "archive_search": f"""WITH {_HITS.replace('WORD', '12')}, n AS (SELECT {_PATH} AS path FROM documents WHERE contains(lower(coalesce(doc_id::VARCHAR, 'none') || '.txt'), '12'))
        SELECT * FROM f UNION ALL SELECT path, 0::BIGINT, 0, '' FROM n WHERE path NOT IN (SELECT path FROM f)""",
    "extract_counts": "SELECT count(*)::BIGINT AS total, count(*)::BIGINT AS success, 0::BIGINT AS error FROM documents",
    "stream_files": f"SELECT 'item-' || item_id || '.txt' AS path, {_SIZE} AS bytes, sha256(coalesce(text, '')) AS sha256 FROM benchmark",
    "stream_catalogs": " UNION ALL ".join(f"SELECT '{fmt}' AS kind, 'item-' || item_id || '.txt' AS path, {_SIZE if fmt == 'gz' else 'NULL::BIGINT'} AS size, NULL::VARCHAR AS error FROM benchmark" for fmt in SINGLE),
    "folder_walk": f"WITH {_PAGES} SELECT path, page_id || '.html' AS name, size FROM p",
    "folder_listing": f"WITH {_PAGES} SELECT host AS name, true AS is_dir, sum(size)::BIGINT AS size FROM p GROUP BY host",
    "folder_bytes": f"WITH {_PAGES} SELECT count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM p",
    "folder_compare": f"WITH {_PAGES} SELECT path, size AS one, chars AS two, size = chars AS same FROM p",
}
