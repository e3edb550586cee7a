"""Queries over the driver's tables, each an operator in use, with the SQL that DuckDB runs for the same rows.

The tables hold no archives; each operator is used on the table of its shape: pages.url without scheme, query and
fragment is a path, its host the archive and length(html) the size; documents are text members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspan.functions import paths, scalars
from packspan.operators import catalog, progress, results, search, selection, volumes
from packspan.runtime import table

WORD = "tion"


def page_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of pages: archive (host), path, size, is_dir, ordinal."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return (
        table(spark, d, "pages")
        .select(paths.normalise(bare).alias("path"), F.length("html").cast("long").alias("size"), F.lit(False).alias("is_dir"), F.col("page_id").alias("ordinal"))
        .withColumn("archive", F.substring_index("path", "/", 1))
        .select("archive", "path", "size", "is_dir", "ordinal")
    )


PAGES = """pages_e AS (
  SELECT *, split_part(path, '/', 1) AS archive FROM (
    SELECT page_id AS ordinal, trim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS path, length(html)::BIGINT AS size FROM pages
  ) WHERE path <> ''
)"""
#: Every proper prefix of every path.
ANCESTORS = """above AS (
  SELECT archive, path, size, ordinal, array_to_string(p[1:i], '/') AS dir
  FROM (SELECT *, string_split(path, '/') AS p FROM pages_e), unnest(range(1, len(p))) AS t(i)
)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")


def content_search(spark, d):
    return search.by_content(texts(spark, d), WORD, max_bytes=None)


CONTENT = f"""
lines AS (
  SELECT doc_id AS path, i AS no, lines[i] AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)
), hits AS (
  SELECT path, count(*)::BIGINT AS match_count, min(no)::INTEGER AS first_line, arg_min(line, no) AS line FROM lines WHERE contains(lower(line), '{WORD}') GROUP BY path
), found AS (
  SELECT path, match_count, first_line, substring(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 120) AS snippet FROM hits
)"""


def search_page(spark, d):
    return search.page(search.by_content(texts(spark, d), WORD, max_bytes=None), after=10)


def filename_search(spark, d):
    return search.by_name(page_entries(spark, d), "12").select("archive", "path", "size")


def match_positions(spark, d):
    found = texts(spark, d).select("path", F.posexplode(search.positions("text", "enen", within=None)).alias("n", "position"))
    return found.select("path", (F.col("n") + 1).alias("n"), "position")


def nearest_match(spark, d):
    return texts(spark, d).select("path", search.nearest("text", WORD, 5).alias("line")).where("line is not null")


def derive_dirs(spark, d):
    return catalog.implied_dirs(page_entries(spark, d))


def dir_sizes(spark, d):
    return catalog.directory_sizes(page_entries(spark, d))


def entries_dedup(spark, d):
    return catalog.keep_first(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"])


def entries_merged(spark, d):
    return catalog.merged_catalog(page_entries(spark, d)).select("archive", "path", "size", "is_dir")


def entries_sorted(spark, d):
    return catalog.ranked(page_entries(spark, d).select("path", "ordinal"), ["path", "ordinal"])


def path_parts(spark, d):
    parts = catalog.with_path_parts(page_entries(spark, d))
    return parts.select("ordinal", "path", "name", "parent", "ext", "depth", paths.stem("name").alias("stem"))


# Paths that an archive may hold, and whether they may be written below a root.
JOIN_CASES = [
    "dir/subdir/file.txt", "dir\\subdir\\file.txt", "", ".", "./", "../escape.txt", "dir/../escape.txt", "dir\\..\\escape.txt",
    "/tmp/escape.txt", "//tmp/escape.txt", "\\tmp\\escape.txt", "\\\\server\\share\\escape.txt", "C:\\Windows\\system.ini", "C:/Windows/system.ini", "dir/name:stream", "a//b/./c",
]


def _values(rows: list[str]) -> str:
    return ", ".join("('" + r.replace("'", "''") + "')" for r in rows)


def safe_join(spark, d):
    # the case table is a literal of the plan
    cases = spark.createDataFrame([(c,) for c in JOIN_CASES], "raw string")
    return cases.select("raw", paths.safe_join("/tmp/output", "raw").alias("dest"), paths.join_error("raw").alias("reason"))


def unique_names(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit(".dat")).alias("name"))
    return catalog.unique_names(named, "name", ["p_partkey"])


def _selected(spark, d):
    return page_entries(spark, d).where(paths.name("path").rlike("^[0-9]*7$")).select("archive", paths.parent("path").alias("sel"))


SELECTED = "selected AS (SELECT DISTINCT archive, regexp_replace(path, '/?[^/]*$', '') AS sel FROM pages_e WHERE regexp_matches(string_split(path, '/')[-1], '^[0-9]*7$'))"


def select_prefix(spark, d):
    return selection.select_entries(page_entries(spark, d), _selected(spark, d), ["archive"]).select("archive", "path", "size", "ordinal")


def selection_stats(spark, d):
    return selection.selection_stats(page_entries(spark, d), _selected(spark, d), ["archive"])


def grouped_selection(spark, d):
    chosen = selection.select_entries(page_entries(spark, d), _selected(spark, d), ["archive"])
    return catalog.grouped_selection(chosen).select("archive", F.array_join("paths", "\n").alias("paths"))


def tree_visible(spark, d):
    entries = page_entries(spark, d)
    opened = entries.select(F.explode(paths.ancestors("path")).alias("dir")).where("dir not like '%net%'").distinct()
    return selection.visible(entries, opened).select("path", "ordinal")


def tree_query(spark, d):
    return selection.matching(page_entries(spark, d), "The").select("path", "ordinal")


def archive_totals(spark, d):
    return catalog.totals(page_entries(spark, d), ["archive"])


def _members(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("archive"), F.concat(F.lit("text/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.length("text").cast("long").alias("size"), F.lit(False).alias("is_dir"), F.col("doc_id").alias("ordinal"))
    return page_entries(spark, d).unionByName(docs)


MEMBERS = PAGES + ", members AS (SELECT archive, path, size, ordinal FROM pages_e UNION ALL SELECT source, 'text/' || doc_id || '.txt', length(text)::BIGINT, doc_id FROM documents)"


def merge_batch(spark, d):
    return catalog.batch_view(_members(spark, d)).select("path", "size", "is_dir", "depth")


def batch_totals(spark, d):
    return catalog.batch_totals(_members(spark, d))


def _parts(spark, d):
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, d, "part").select("p_partkey", F.concat(base, F.lit(".part"), F.col("p_size").cast("string"), F.lit(".rar")).alias("name"), F.col("p_size").cast("long").alias("length"))


PARTS = "parts AS (SELECT p_partkey, replace(p_name, ' ', '_') || '.part' || p_size || '.rar' AS name, p_size::BIGINT AS length FROM part)"


def volume_parts(spark, d):
    return _parts(spark, d).select("p_partkey", "name", volumes.volume_format("name").alias("format"), volumes.volume_base("name").alias("base"), volumes.volume_number("name").alias("number"))


VOLUME_CASES = ["game.part1.rar", "game.part10.rar", "game.part2.rar", "old.rar", "old.r00", "old.r01", "old.s00", "set.7z.001", "set.7z.002", "alone.part1.rar", "notes.txt"]


def volume_sets(spark, d):
    files = spark.createDataFrame([("dir", c) for c in VOLUME_CASES], "dir string, name string")
    return volumes.joined(volumes.volume_sets(files))


def volume_offsets(spark, d):
    parts = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("length"))
    return volumes.offsets(parts, ["p_brand"], ["p_partkey"])


def size_label(spark, d):
    return page_entries(spark, d).select("ordinal", scalars.size_label(F.col("size") * 997).alias("label"))


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.md5_hex("text").alias("md5"), scalars.sha256_hex("text").alias("sha256"))


ERROR_CASES = ["Wrong password given", "maybe BAD PASSWORD", "checksum verification failed", "member exceeds configured limit", "out of memory", "no such file", ""]


def error_class(spark, d):
    cases = spark.createDataFrame([(c,) for c in ERROR_CASES], "message string")
    return cases.select("message", scalars.error_class("message").alias("class"))


def progress_running(spark, d):
    log = table(spark, d, "events").select("event_id", "ts", "user_id", F.length("props").cast("long").alias("bytes"))
    hour = F.date_trunc("hour", "ts")
    out = catalog.running_total(log, "bytes", ["ts", "event_id"], hour, name="overall")
    return catalog.running_total(out, "bytes", ["ts", "event_id"], hour, ["user_id"], name="of_member").select("event_id", "overall", "of_member")


def progress_pct(spark, d):
    done = table(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("done"), (F.length("props") * 20 - 200).cast("long").alias("total"))
    return done.select("event_id", scalars.percent("done", "total").alias("pct"), scalars.bar_state(F.col("total") * 20000).alias("bar"))


def result_counts(spark, d):
    outcome = table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "failed").alias("error"))
    return results.counts(outcome)


def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


LISTING_CASES = ['[{"n":"a/b.txt","s":5,"d":false,"e":true},{"n":"c"}]', '[{"n":"d/","d":true},{"s":7}]']


def json_entries(spark, d):
    cases = spark.createDataFrame([(c,) for c in LISTING_CASES], "listing string")
    return catalog.parse_listing(cases).select("path", "size", "is_dir", "is_encrypted", "ordinal")


def listing_json(spark, d):
    # the JSON text itself is compared field by field after a round trip
    back = catalog.parse_listing(catalog.listing_json(page_entries(spark, d).withColumn("is_encrypted", F.lit(False))))
    return back.groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


def format_lookup(spark, d):
    names = [f"x.{k}" for k in ("zip", "tar.gz", "tgz", "TAR.ZST", "pf8", "sar", "iso", "txt", "lz4")] + ["zip"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").withColumn("key", scalars.format_key("name"))
    return rows.select("name", "key", scalars.format_label("key").alias("label"), scalars.format_group("key").alias("grp"))


def compressible(spark, d):
    named = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("txt", "zip", "7Z", "md", "rar")]), F.col("p_size") % 5 + 1)).alias("path"), F.lit(False).alias("is_dir"))
    return selection.compressible(named).select("path")


def timestamps(spark, d):
    return table(spark, d, "events").select("event_id", scalars.minute_label("ts").alias("label"))


RESULT_CASES = ['{"total":5,"success":4,"error":1}', '{"total":2}', "{}", "not json", "", "[1]"]


def result_json(spark, d):
    cases = spark.createDataFrame([(c,) for c in RESULT_CASES], "result string")
    return cases.select("result", catalog.parse_result("result").alias("r")).select("result", "r.total", "r.success", "r.error")


#: One name after another of the parts gets one of these endings.
ENDINGS = ["txt", "ZIP", "png", "part1.rar", "7z.002", "r03", "tar.gz", "mp4", "md", "none.", "lz4", "Py"]


def _named(spark, d):
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("files/"), F.col("p_partkey").cast("string"), F.lit("."), ending).alias("path"), F.col("p_size").cast("long").alias("size"), F.lit(False).alias("is_dir"))


NAMED = f"named AS (SELECT p_partkey, 'files/' || p_partkey || '.' || [{', '.join(repr(e) for e in ENDINGS)}][p_partkey % {len(ENDINGS)} + 1] AS path, p_size::BIGINT AS size FROM part), told AS (SELECT *, lower(string_split(path, '.')[-1]) AS ext FROM named)"


def file_kinds(spark, d):
    name = paths.name("path")
    return _named(spark, d).select("path", scalars.is_archive_name(name).alias("archive"), scalars.is_preview_name(name).alias("preview"), scalars.is_text_name(name).alias("text"))


def batch_archives(spark, d):
    return selection.batch_archives(_named(spark, d)).select("path")


def toggled_on(spark, d):
    entries = page_entries(spark, d)
    before = entries.where("ordinal % 10 = 0").select(F.col("path").alias("sel"))
    return selection.toggled(before, entries, entries.selectExpr("min(archive)").first()[0], True)


def toggled_off(spark, d):
    entries = page_entries(spark, d)
    before = entries.where("ordinal % 2 = 0").select(F.col("path").alias("sel")).distinct()
    return selection.toggled(before, entries, entries.selectExpr("min(archive)").first()[0], False)


def scan_counter(spark, d):
    rows, seen = progress.counted(table(spark, d, "documents"), "n_chars")
    rows.where("lang = 'de'").write.format("noop").mode("overwrite").save()  # every file visited counts, skipped ones too
    return spark.createDataFrame([(seen.get["rows"], seen.get["bytes"])], "rows long, bytes long")


LEVEL_FORMATS = ["zip", "7z", "gz", "tgz", "bz2", "zst", "xz", "lzma", "lz4"]


def levels(spark, d):
    rows = [(f, n, scalars.compression_level(f, n)) for f in LEVEL_FORMATS for n in range(-2, 31)]
    return spark.createDataFrame(rows, "fmt string, asked int, level int")


def size_limited_search(spark, d):
    return search.by_content(texts(spark, d), WORD, max_bytes=2_000)


QUERIES = {
    f.__name__: f
    for f in (
        content_search, search_page, filename_search, match_positions, nearest_match, derive_dirs, dir_sizes, entries_dedup, entries_merged, entries_sorted, path_parts, safe_join, unique_names,
        select_prefix, selection_stats, grouped_selection, tree_visible, tree_query, archive_totals, merge_batch, batch_totals, volume_parts, volume_sets, volume_offsets, size_label, content_hash, error_class,
        progress_running, progress_pct, result_counts, json_props, json_entries, listing_json, format_lookup, compressible, timestamps,
        result_json, file_kinds, batch_archives, toggled_on, toggled_off, scan_counter, levels, size_limited_search,
    )
}

_ERRORS = f"SELECT message, CASE WHEN message = '' THEN 'failed' WHEN regexp_matches(lower(message), '{'|'.join(scalars.PASSWORD_WORDS)}') THEN 'wrong_password' WHEN regexp_matches(lower(message), '{'|'.join(scalars.LARGE_WORDS)}') THEN 'large_member' ELSE 'io' END AS class FROM (VALUES {_values(ERROR_CASES)}) AS t(message)"
_ANY = lambda words: ", ".join(repr(w) for w in words)
_FIRST = "(SELECT min(archive) FROM pages_e)"
_SEGMENTS = "list_filter(string_split(replace(raw, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.')"

ORACLES = {
    "content_search": f"WITH {CONTENT} SELECT * FROM found",
    "search_page": f"WITH {CONTENT} SELECT * FROM found WHERE path > 10 ORDER BY path LIMIT 200",
    "filename_search": f"WITH {PAGES} SELECT archive, path, size FROM pages_e WHERE contains(lower(string_split(path, '/')[-1]), '12')",
    "match_positions": """
        WITH t AS (SELECT doc_id AS path, lower(text) AS s FROM documents WHERE contains(lower(text), 'enen')),
        c AS (SELECT path, string_split(s, 'e') AS pieces, s FROM t),
        places AS (SELECT path, s, unnest(list_transform(range(1, len(pieces)), lambda i: list_sum(list_transform(pieces[1:i], lambda p: length(p) + 1))))::INTEGER AS position FROM c),
        hit AS (SELECT path, position FROM places WHERE substring(s, position, 4) = 'enen')
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY position)::INTEGER AS n, position FROM hit""",
    "nearest_match": f"""WITH {CONTENT} SELECT l.path, arg_min(no, abs(no - 5) * 1000000 + no)::INTEGER AS line
        FROM (SELECT doc_id AS path, i AS no, lines[i] AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)) l
        WHERE contains(lower(l.line), '{WORD}') GROUP BY l.path""",
    "derive_dirs": f"WITH {PAGES}, {ANCESTORS} SELECT dir, count(*)::BIGINT AS entries FROM above WHERE dir <> '' GROUP BY dir",
    "dir_sizes": f"WITH {PAGES}, {ANCESTORS} SELECT dir, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM above WHERE dir <> '' GROUP BY dir",
    "entries_dedup": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE rn = 1",
    "entries_merged": f"""WITH {PAGES}, {ANCESTORS}, every AS (SELECT archive, path, size, false AS is_dir, ordinal FROM pages_e UNION ALL SELECT DISTINCT archive, dir, 0::BIGINT, true, 4611686018427387904 FROM above WHERE dir <> '')
        SELECT archive, path, size, is_dir FROM (SELECT *, row_number() OVER (PARTITION BY archive, path ORDER BY ordinal) AS rn FROM every) WHERE rn = 1""",
    "entries_sorted": f"WITH {PAGES} SELECT path, ordinal, row_number() OVER (ORDER BY path, ordinal)::BIGINT AS rank FROM pages_e",
    "path_parts": f"""WITH {PAGES}, n AS (SELECT *, string_split(path, '/')[-1] AS name FROM pages_e)
        SELECT ordinal, path, name, regexp_replace(path, '/?[^/]*$', '') AS parent, lower(string_split(name, '.')[-1]) AS ext, (length(path) - length(replace(path, '/', '')))::INTEGER AS depth,
        CASE WHEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) = '' THEN name ELSE regexp_extract(name, '^(.+)\\.[^.]*$', 1) END AS stem FROM n""",
    "safe_join": f"""WITH c AS (SELECT raw, replace(raw, chr(92), '/') AS p, {_SEGMENTS} AS kept FROM (VALUES {_values(JOIN_CASES)}) AS t(raw)),
        r AS (SELECT raw, kept, CASE WHEN starts_with(p, '/') THEN 'absolute path' WHEN contains(p, ':') THEN 'colon in path' WHEN list_contains(string_split(p, '/'), '..') THEN 'parent step in path' WHEN len(kept) = 0 THEN 'empty archive path' END AS reason FROM c)
        SELECT raw, CASE WHEN reason IS NULL THEN '/tmp/output/' || array_to_string(kept, '/') END AS dest, reason FROM r""",
    "unique_names": """SELECT p_partkey, name, CASE WHEN n = 0 THEN name ELSE p_brand || ' (' || n || ').dat' END AS unique_name
        FROM (SELECT p_partkey, p_brand, p_brand || '.dat' AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)""",
    "select_prefix": f"WITH {PAGES}, {SELECTED} SELECT archive, path, size, ordinal FROM pages_e e WHERE EXISTS (SELECT 1 FROM selected s WHERE s.archive = e.archive AND s.sel <> '' AND (e.path = s.sel OR starts_with(e.path, s.sel || '/')))",
    "selection_stats": f"WITH {PAGES}, {SELECTED} SELECT count(*)::BIGINT AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM pages_e e WHERE EXISTS (SELECT 1 FROM selected s WHERE s.archive = e.archive AND s.sel <> '' AND (e.path = s.sel OR starts_with(e.path, s.sel || '/')))",
    "grouped_selection": f"""WITH {PAGES}, {SELECTED} SELECT archive, string_agg(path, chr(10) ORDER BY path) AS paths FROM pages_e e
        WHERE EXISTS (SELECT 1 FROM selected s WHERE s.archive = e.archive AND s.sel <> '' AND (e.path = s.sel OR starts_with(e.path, s.sel || '/'))) GROUP BY archive""",
    "tree_visible": f"WITH {PAGES}, {ANCESTORS} SELECT path, ordinal FROM pages_e e WHERE NOT EXISTS (SELECT 1 FROM above a WHERE a.path = e.path AND a.dir <> '' AND a.dir LIKE '%net%')",
    "tree_query": f"WITH {PAGES} SELECT path, ordinal FROM pages_e WHERE contains(lower(path), 'the')",
    "archive_totals": f"WITH {PAGES} SELECT archive, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM pages_e GROUP BY archive",
    "merge_batch": f"""WITH {MEMBERS} SELECT archive || '/' || path AS path, size, false AS is_dir, (length(path) - length(replace(path, '/', '')) + 1)::INTEGER AS depth FROM members
        UNION ALL SELECT DISTINCT archive, 0::BIGINT, true, 0::INTEGER FROM members""",
    "batch_totals": f"WITH {MEMBERS} SELECT count(DISTINCT archive)::BIGINT AS archives, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM members",
    "volume_parts": f"WITH {PARTS} SELECT p_partkey, name, 'rar' AS format, regexp_extract(name, '^(.+)\\.part(\\d+)\\.rar$', 1) AS base, regexp_extract(name, '^(.+)\\.part(\\d+)\\.rar$', 2)::INTEGER AS number FROM parts",
    "volume_sets": f"""WITH c AS (SELECT name, CASE WHEN regexp_matches(name, '\\.(part\\d+\\.rar|rar|[r-z]\\d{{2}})$') THEN 'rar' WHEN regexp_matches(name, '\\.\\d{{2,3}}$') THEN '7z' END AS format,
        regexp_replace(name, '(\\.part\\d+\\.rar|\\.rar|\\.[r-z]\\d{{2}}|\\.\\d{{2,3}})$', '') AS base,
        CASE WHEN regexp_matches(name, '\\.part\\d+\\.rar$') THEN regexp_extract(name, '\\.part(\\d+)\\.rar$', 1)::INTEGER WHEN regexp_matches(name, '\\.[r-z]\\d{{2}}$') THEN (ascii(regexp_extract(name, '\\.([r-z])\\d{{2}}$', 1)) - 114) * 100 + regexp_extract(name, '(\\d{{2}})$', 1)::INTEGER WHEN regexp_matches(name, '\\.\\d{{2,3}}$') THEN regexp_extract(name, '\\.(\\d{{2,3}})$', 1)::INTEGER ELSE -1 END AS n
        FROM (VALUES {_values(VOLUME_CASES)}) AS t(name))
        SELECT 'dir/' || base AS set_key, format, string_agg(name, chr(10) ORDER BY n, name) AS volumes FROM c WHERE format IS NOT NULL GROUP BY base, format HAVING count(*) > 1""",
    "volume_offsets": """SELECT p_brand, p_partkey, p_size::BIGINT AS length, (sum(p_size) OVER w)::BIGINT AS "end", (sum(p_size) OVER w - p_size)::BIGINT AS start FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)""",
    "size_label": f"""WITH {PAGES}, s AS (SELECT ordinal, size * 997 AS n FROM pages_e)
        SELECT ordinal, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%d B', n) END AS label FROM s""",
    "content_hash": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "error_class": _ERRORS,
    "progress_running": """SELECT event_id, (sum(length(props)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS overall,
        (sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS of_member FROM events""",
    "progress_pct": """WITH e AS (SELECT event_id, user_id::BIGINT AS done, (length(props) * 20 - 200)::BIGINT AS total FROM events)
        SELECT event_id, CASE WHEN total > 0 THEN least(100, floor(done * 100.0::DOUBLE / total))::BIGINT END AS pct, CASE WHEN total * 20000 >= 1048576 THEN 'percent' WHEN total * 20000 >= 1 THEN 'hidden' ELSE 'indeterminate' END AS bar FROM e""",
    "result_counts": "SELECT count(*)::BIGINT AS total, count(*) FILTER (toxic IS DISTINCT FROM 1)::BIGINT AS success, count(*) FILTER (toxic = 1)::BIGINT AS error FROM labels",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events",
    "json_entries": """SELECT path, size::BIGINT AS size, is_dir, is_encrypted, ordinal::BIGINT AS ordinal FROM (VALUES ('a/b.txt', 5, false, true, 0), ('c', 0, false, false, 1), ('d/', 0, true, false, 0)) AS t(path, size, is_dir, is_encrypted, ordinal)""",
    "listing_json": f"WITH {PAGES} SELECT archive, count(*)::BIGINT AS entries, sum(size)::BIGINT AS bytes FROM pages_e GROUP BY archive",
    "format_lookup": "SELECT * FROM (VALUES ('x.zip', 'zip', 'ZIP', 'generic'), ('x.tar.gz', 'tgz', 'TAR.GZ', 'generic'), ('x.tgz', 'tgz', 'TAR.GZ', 'generic'), ('x.TAR.ZST', 'tzst', 'TAR.ZST', 'generic'), ('x.pf8', 'pfs', 'PFS/PF6/PF8', 'galgame'), ('x.sar', 'nsa', 'NSA/SAR', 'galgame'), ('x.iso', 'iso', 'ISO', 'galgame'), ('x.txt', NULL, NULL, NULL), ('x.lz4', 'lz4', 'LZ4', 'single'), ('zip', NULL, NULL, NULL)) AS t(name, key, label, grp)",
    "compressible": "SELECT path FROM (SELECT p_partkey || '.' || ['txt', 'zip', '7Z', 'md', 'rar'][p_size % 5 + 1] AS path FROM part) WHERE NOT regexp_matches(lower(path), '\\.(zip|7z|rar)$')",
    "timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS label FROM events",
    "result_json": """SELECT * FROM (VALUES ('{"total":5,"success":4,"error":1}', 5, 4, 1), ('{"total":2}', 2, 0, 0), ('{}', 0, 0, 1), ('not json', 0, 0, 1), ('', 0, 0, 1), ('[1]', 0, 0, 1)) AS t(result, total, success, error)""",
    "file_kinds": f"WITH {NAMED} SELECT path, ext IN ({_ANY(scalars.ARCHIVE_EXTENSIONS)}) AS archive, ext IN ({_ANY(scalars.PREVIEW_EXTENSIONS)}) AS preview, ext IN ({_ANY(scalars.TEXT_EXTENSIONS)}) AS text FROM told",
    "batch_archives": f"WITH {NAMED} SELECT path FROM told WHERE ext IN ({_ANY(scalars.ARCHIVE_EXTENSIONS)}) OR regexp_matches(path, '\\.(part[0-9]+\\.rar|[r-z][0-9][0-9]|7z\\.[0-9]+)$')",
    "toggled_on": f"WITH {PAGES} SELECT path AS sel FROM pages_e WHERE ordinal % 10 = 0 UNION SELECT path FROM pages_e WHERE path = {_FIRST} OR starts_with(path, {_FIRST} || '/')",
    "toggled_off": f"WITH {PAGES} SELECT DISTINCT path AS sel FROM pages_e WHERE ordinal % 2 = 0 AND path <> {_FIRST} AND NOT starts_with(path, {_FIRST} || '/')",
    "scan_counter": "SELECT count(*)::BIGINT AS rows, sum(n_chars)::BIGINT AS bytes FROM documents",
    "levels": f"""WITH l AS (SELECT fmt, asked::INTEGER AS asked FROM (SELECT unnest([{_ANY(LEVEL_FORMATS)}]) AS fmt), unnest(range(-2, 31)) AS t(asked))
        SELECT fmt, asked, (CASE WHEN fmt IN ('zip', 'gz', 'tgz') THEN greatest(0, least(asked, 9)) WHEN fmt = '7z' THEN CASE WHEN asked <= 0 THEN 0 WHEN asked <= 3 THEN 3 WHEN asked <= 6 THEN 5 ELSE 9 END
        WHEN fmt = 'bz2' THEN greatest(1, least(asked, 9)) WHEN fmt = 'zst' THEN CASE WHEN asked < 1 THEN 3 ELSE least(asked, 22) END END)::INTEGER AS level FROM l""",
    "size_limited_search": f"WITH {CONTENT} SELECT found.* FROM found JOIN documents ON path = doc_id WHERE octet_length(encode(text)) < 2000",
}
