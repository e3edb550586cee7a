"""Queries do the whole job where a bound, a prefix or a shut-off would go unnoticed."""

import re

from packspan import registry


def test_positions_are_those_of_the_whole_text(spark, tmp_path):
    texts = ["x" * 49_998 + "ENEnen " + "y" * 60_000 + "enen", "xenen " * 20_000, "", None, "enen"]
    want = [(d, m.start() + 1) for d, t in enumerate(texts) for m in re.finditer("(?=enen)", (t or "").lower())]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["match_positions"](spark, str(tmp_path)).orderBy("path", "n").collect()
    assert [(r.path, r.position) for r in got] == want
    assert [r.n for r in got if r.path == 1] == list(range(1, 20_001))


def test_content_searches_read_texts_of_any_length(spark, tmp_path):
    rows = [(11, "a\n" + "x" * 1_000_000 + "\nsome nation\n", "en", "s"), (12, "action", "en", "s"), (13, "none", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, paths in (("content_search", [11, 12]), ("search_page", [11, 12]), ("archive_content_search", ["s/11.txt", "s/12.txt"])):
        got = registry.queries()[name](spark, str(tmp_path)).orderBy("path").collect()
        assert [tuple(r) for r in got] == [(paths[0], 1, 3, "some nation"), (paths[1], 1, 1, "action")], name
