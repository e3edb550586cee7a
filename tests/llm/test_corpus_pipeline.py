"""The pipeline against its parts, and on odd tables."""

import corpus_pipeline
from packspan.llm import decontam, neardup
from packspan.runtime import table


def test_stages_keep_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    found = neardup.near_duplicates(docs)
    assert found.where("not kept").count() == 0
    assert decontam.contaminations(docs, table(spark, d, "benchmark")).count() == 0
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()} and all(r.round_trip for r in out)


def test_stages_on_odd_and_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, tox_score string"
    text = "the quick brown fox jumps over the lazy dog and runs away from all of it"
    rows = [(1, None, "en", "a", 0, "x"), (2, "", "en", None, 0, "x"), (3, text, "en", "a", 1, "x"), (3, text, "en", "a", 1, "x"), (4, text, "en", "a", 1, "x"), (None, "another text altogether that nobody has named yet", "en", "a", 1, "x")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, d).collect()
            docs = spark.createDataFrame(kept, schema)
        ids = sorted(str(r.doc_id) for r in docs.collect())
        assert ids == (["3", "None"] if n else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == len(ids)
