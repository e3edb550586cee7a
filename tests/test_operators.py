"""Relational operators against plain Python, on odd values and by their plans."""

import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packspan import registry
from packspan.functions import paths, scalars
from packspan.operators import catalog, progress, results, search, selection, volumes
from packspan.runtime import table
from packspan.streaming import progress as streamed

raw_paths = st.lists(st.text(alphabet="ab/\\.", max_size=9), min_size=1, max_size=12)
slow = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def norm(p):
    return p.replace("\\", "/").strip("/") or None


def above(p):
    parts = p.split("/")
    return [x for x in ("/".join(parts[:i]) for i in range(1, len(parts))) if x]


@given(raw_paths)
@slow
def test_paths_against_a_model(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("p", paths.normalise("raw"))
    rows = df.select("i", "p", paths.ancestors("p").alias("a"), paths.name("p").alias("n"), paths.parent("p").alias("up"), paths.depth("p").alias("d"), paths.extension(paths.name("p")).alias("e"), paths.join_error("raw").alias("bad"), paths.safe_join("/o", "raw").alias("to")).collect()
    for r in rows:
        p = norm(raws[r.i])
        assert r.p == p
        if p:
            assert r.a == above(p) and r.n == p.rpartition("/")[2] and r.up == p.rpartition("/")[0] and r.d == p.count("/")
            assert r.e == r.n.rpartition(".")[2].lower()
        parts = raws[r.i].replace("\\", "/").split("/")
        kept = [s for s in parts if s not in ("", ".")]
        refused = parts[0] == "" and len(parts) > 1 or ".." in parts or not kept
        assert (r.bad is not None) == refused and r.to == (None if refused else "/o/" + "/".join(kept))


@given(raw_paths, raw_paths)
@slow
def test_selection_against_a_model(spark, raws, sels):
    known = sorted({p for r in raws if (p := norm(r)) and "//" not in p})
    chosen = {p for s in sels if (p := norm(s))}
    entries = spark.createDataFrame([(p, 1, False) for p in known], "path string, size long, is_dir boolean")
    got = selection.select_entries(entries, spark.createDataFrame([(s,) for s in sels], "sel string")).collect()
    assert sorted(r.path for r in got) == [p for p in known if any(p == s or p.startswith(s + "/") for s in chosen)]


def test_selection_plans_no_nested_loop(spark, sf):
    for name in ("select_prefix", "tree_visible", "selection_stats"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_safe_join_refuses(spark):
    bad = ["", ".", "./", "../x", "a/../x", "/a", "//a", "\\a", "\\\\s\\a", "C:\\a", "C:/a", "a/b:c", "a\0b", None]
    rows = spark.createDataFrame([(b,) for b in bad], "p string").select(paths.safe_join("/o", "p").alias("t"), paths.join_error("p").alias("e")).collect()
    assert all(r.t is None and r.e for r in rows)


def test_names_and_stems(spark):
    df = spark.createDataFrame([("x.tar.gz",), (".hidden",), ("plain",), ("a.b",)], "n string")
    assert [r[0] for r in df.select(paths.stem("n")).collect()] == ["x.tar", ".hidden", "plain", "a"]
    assert [r[0] for r in df.select(paths.numbered("n", F.lit(2))).collect()] == ["x.tar (2).gz", ".hidden (2)", "plain (2)", "a (2).b"]
    rows = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "b")], "i int, n string")
    taken = spark.createDataFrame([("a.txt",), ("a (3).txt",)], "n string")
    assert {r.i: r.unique_name for r in catalog.unique_names(rows, "n", ["i"]).collect()} == {1: "a.txt", 2: "a (1).txt", 3: "b"}
    assert {r.i: r.unique_name for r in catalog.unique_names(rows, "n", ["i"], taken).collect()} == {1: "a (4).txt", 2: "a (5).txt", 3: "b"}


def test_merged_catalog_keeps_the_first(spark):
    rows = [("z", "a/b.txt", 5, False, 0), ("z", "a/b.txt", 9, False, 1), ("z", "a", 0, True, 2), ("z", "c/d/e", 1, False, 3), ("y", "a/b.txt", 7, False, 0)]
    got = catalog.merged_catalog(spark.createDataFrame(rows, "archive string, path string, size long, is_dir boolean, ordinal long")).collect()
    assert sorted((r.archive, r.path, r.size, r.is_dir) for r in got) == [("y", "a", 0, True), ("y", "a/b.txt", 7, False), ("z", "a", 0, True), ("z", "a/b.txt", 5, False), ("z", "c", 0, True), ("z", "c/d", 0, True), ("z", "c/d/e", 1, False)]
    assert [r.path for r in catalog.sorted_by_path(spark.createDataFrame(rows, "archive string, path string, size long, is_dir boolean, ordinal long").where("archive = 'z'")).collect()] == ["a", "a/b.txt", "a/b.txt", "c/d/e"]


def test_ranks_and_running_totals(spark):
    rows = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    assert all(r.rank == r.k + 1 for r in catalog.ranked(rows, ["k"]).collect())
    got = {r.i: r.running for r in catalog.running_total(rows, "i", ["i"], F.floor(F.col("i") / 50), ["g"]).collect()}
    assert got == {i: sum(range(i % 3, i + 1, 3)) for i in range(1000)}


def test_listings_and_results_in_json(spark):
    bad = spark.createDataFrame([("nope",), (None,), ('{"total":3,"success":2,"error":1}',), ('{"total":3}',)], "j string")
    assert [tuple(r[0]) for r in bad.select(catalog.parse_result("j")).collect()] == [(0, 0, 1), (0, 0, 1), (3, 2, 1), (3, 0, 0)]
    odd = spark.createDataFrame([("z", 'q"\\\n\r\t\x01é', None, False, True)], "archive string, path string, size long, is_dir boolean, is_encrypted boolean")
    (r,) = catalog.parse_listing(catalog.listing_json(odd)).collect()
    assert (r.path, r.size, r.is_dir, r.is_encrypted) == ('q"\\\n\r\t\x01é', 0, False, True)
    assert catalog.parse_listing(spark.createDataFrame([("[oops",)], "listing string")).count() == 0


def test_content_search_against_python(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    got = {r.path: tuple(r)[1:] for r in search.by_content(docs, "TION", 5_000).collect()}
    want = {}
    for r in docs.collect():
        if len(r.text) < 5_000:
            hits = [(i, line) for i, line in enumerate(re.split("\r\n|\r|\n", r.text), 1) if "tion" in line.lower()]
            if hits:
                want[r.path] = (len(hits), hits[0][0], hits[0][1].strip()[:120])
    assert got == want
    odd = spark.createDataFrame([(1, "a\r\nB x \r\tb"), (2, None), (3, "")], "path int, text string")
    assert [tuple(r) for r in search.by_content(odd, "b").collect()] == [(1, 2, 2, "B x")]
    assert search.by_content(odd, "").count() == 0


def test_positions_overlap(spark):
    cases = [("aAaa", "aa", [1, 2, 3]), ("xaa", "a", [2, 3]), ("", "a", []), ("a.b.", ".", [2, 4]), ("abab", "ab", [1, 3]), ("é日é", "É", [1, 3])]
    for text, q, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(search.positions("t", q)).first()[0] == want, (text, q)
    lines = spark.createDataFrame([("x\nq\n\nq\nq",)], "t string")
    assert [lines.select(search.nearest("t", "Q", n)).first()[0] for n in (1, 3, 5, 9)] == [2, 2, 5, 5]
    assert lines.select(search.nearest("t", "none", 1)).first()[0] is None


def test_paging_is_a_top_k(spark, sf):
    found = search.by_content(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"), "tion")
    first = [r.path for r in search.page(found, 5).collect()]
    second = [r.path for r in search.page(found, 5, after=first[-1]).collect()]
    assert first + second == sorted(r.path for r in found.collect())[:10]
    assert "TakeOrderedAndProject" in search.page(found, 5)._jdf.queryExecution().executedPlan().toString()


def test_search_in_archives(spark):
    entries = spark.createDataFrame([("z", "a/Note.txt", False), ("z", "pic.png", False), ("z", "b.txt", False)], "archive string, path string, is_dir boolean")
    members = spark.createDataFrame([("z", "a/Note.txt", b"x\nnote y"), ("z", "pic.png", b"note"), ("z", "b.txt", b"nothing")], "archive string, path string, content binary")
    got = {r.path: (r.match_count, r.first_line, r.snippet) for r in search.in_archives(entries, members, "note").collect()}
    assert got == {"a/Note.txt": (1, 2, "note y")}
    assert {r.path for r in search.in_archives(entries, members, "pic").collect()} == {"pic.png"}


def test_selection_cascade_and_kinds(spark):
    entries = spark.createDataFrame([("d", True), ("d/a", False), ("d/b.zip", False), ("dx", False), ("v.part2.rar", False)], "path string, is_dir boolean")
    none = spark.createDataFrame([], "sel string")
    on = selection.toggled(none, entries, "d", True)
    assert {r.sel for r in on.collect()} == {"d", "d/a", "d/b.zip"}
    assert {r.sel for r in selection.toggled(on, entries, "d/a", False).collect()} == {"d", "d/b.zip"}
    assert {r.path for r in selection.compressible(entries).collect()} == {"d", "d/a", "dx"}
    assert {r.path for r in selection.batch_archives(entries).collect()} == {"d/b.zip", "v.part2.rar"}


def test_volume_sets(spark):
    files = [("a.part2.rar", None), ("A.PART1.RAR", None), ("a.part1.rar", None), ("o.rar", None), ("o.r00", None), ("o.s01", None), ("o.r10", None), ("s.7z.002", b""), ("s.7z.001", volumes.SEVEN_ZIP_MAGIC + b"x"), ("n.12", b"plain"), ("n.11", b"plain"), ("x.txt", None)]
    got = volumes.volume_sets(spark.createDataFrame([("d", *f) for f in files], "dir string, name string, head binary"))
    sets = {r.set_key: r.volumes.split("\n") for r in volumes.joined(got).collect()}
    assert sets == {"d/a": ["a.part1.rar", "a.part2.rar"], "d/o": ["o.rar", "o.r00", "o.r10", "o.s01"], "d/s.7z": ["s.7z.001", "s.7z.002"]}


def test_scalars(spark):
    sizes = [0, 1023, 1024, 1536, 1 << 20, 1 << 30, 5 << 30]
    df = spark.createDataFrame([(s,) for s in sizes], "n long")
    assert [r[0] for r in df.select(scalars.size_label("n")).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.00 GB", "5.00 GB"]
    p = spark.createDataFrame([(5, 10), (20, 10), (1, 0), (1, None)], "d long, t long").select(scalars.percent("d", "t"), scalars.bar_state("t")).collect()
    assert [tuple(r) for r in p] == [(50, "hidden"), (100, "hidden"), (None, "indeterminate"), (None, "indeterminate")]
    assert [scalars.compression_level(f, n) for f, n in (("zip", 0), ("7z", 5), ("7z", 7), ("gz", 12), ("bz2", 0), ("zst", 0), ("zst", 40), ("xz", 5))] == [0, 5, 9, 9, 1, 3, 22, None]


def test_results_and_progress(spark):
    rows = spark.createDataFrame([("a", None), ("a", "Bad password"), ("b", "")], "archive string, error string")
    got = {r.archive: (r.total, r.success, r.error, r.ok) for r in results.succeeded(results.counts(rows, ["archive"])).collect()}
    assert got == {"a": (2, 1, 1, False), "b": (1, 1, 0, True)}
    assert {r["class"]: r.members for r in results.by_class(rows).collect()} == {"failed": 2, "wrong_password": 1}
    seen_rows, seen = progress.counted(spark.range(10).withColumn("n", F.col("id")), "n")
    assert seen_rows.count() == 10 and seen.get == {"rows": 10, "bytes": 45}
    with progress.cancellable(spark, "job-1") as tag:
        assert tag in spark.sparkContext.getJobTags()
    progress.cancel(spark, "job-1")  # nothing runs under it


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\nTwo tions")
    (tmp_path / "in" / "b.txt").write_text("nothing")
    q = streamed.watched_texts(spark, str(tmp_path / "in"), "tion").writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert [(r.match_count, r.first_line) for r in spark.table("hits").collect()] == [(1, 2)]
    log = [(dt.datetime(2024, 1, 1, 0, m, s), f"m{s % 2}", 10) for m in range(3) for s in (1, 2, 3)]
    spark.createDataFrame(log, "ts timestamp, member string, bytes long").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("ts timestamp, member string, bytes long").parquet(str(tmp_path / "log"))
    q = streamed.member_progress(stream).writeStream.format("memory").outputMode("complete").queryName("steps").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert sorted((r.member, r.bytes) for r in spark.table("steps").collect()) == [("m0", 10)] * 3 + [("m1", 20)] * 3


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "pages", "conversations", "events", "part", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    df = registry.queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == rows


def test_a_running_job_is_cancelled(spark):
    """Work under a tag ends when the tag is cancelled from another thread, in the middle of a reader's task."""
    import threading
    import time

    from pyspark import inheritable_thread_target

    def slow_rows(batches):
        for b in batches:
            time.sleep(60)
            yield b

    failed = []

    def work():
        with progress.cancellable(spark, "long-scan"):
            try:
                spark.range(0, 4, 1, 4).mapInArrow(slow_rows, "id long").write.format("noop").mode("overwrite").save()
            except Exception as e:
                failed.append(str(e))

    t = threading.Thread(target=inheritable_thread_target(spark)(work))
    begun = time.time()
    t.start()
    while t.is_alive() and time.time() - begun < 30:
        time.sleep(0.5)
        progress.cancel(spark, "long-scan")
    assert not t.is_alive() and failed and "cancel" in failed[0].lower()
    assert spark.range(3).count() == 3


def test_archives_of_one_name_are_told_apart(spark):
    rows = [("x/a.zip", "p", 1, False), ("y/a.zip", "p", 2, False), ("y/b.zip", "q", 3, False)]
    got = catalog.batch_view(spark.createDataFrame(rows, "archive string, path string, size long, is_dir boolean")).collect()
    assert sorted((r.path, r.size, r.depth) for r in got) == [("a (1).zip", 0, 0), ("a (1).zip/p", 2, 1), ("a.zip", 0, 0), ("a.zip/p", 1, 1), ("b.zip", 0, 0), ("b.zip/q", 3, 1)]
