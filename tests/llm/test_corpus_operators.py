"""Each operator on small tables: against brute force, and on nulls, empties, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from packspan.llm import decontam, language, learning, lookup, neardup, quality, registry, sentencepiece_fst, sharding, sstable, toxicity, vectors, warc, wordkernel
from packspan.llm.components import components
from packspan.llm.learning import remainder
from packspan.runtime import table

DOCS = "doc_id long, text string, lang string, source string"
ODD = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "123 !!", None, "a"), (None, "some words here", "en", "a"), (5, "x " * 60_000, "en", "a"), (6, "tie", "en", "b"), (6, "tie", "en", "b")]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# op1


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())


def test_sentencepiece_equals_the_library(spark, sf, library):
    docs = table(spark, sf, "documents")
    rows = sentencepiece_fst.encode(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode(r.text)
        assert r.sp_ids == want and r.sp_tokens == len(want) and r.sp_same
        assert r.sp_crc32 == crc32(np.array(want, "<u4").tobytes())


def test_sentencepiece_odd_texts(spark, library):
    texts = ["", " ", "  a", "a" * 300, "日本語 ﬁ\n\n\tx ", "a▁b", " " * 40, "😀é́"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(99, None, "clash")], "doc_id long, text string, sp_ids string")
    rows = {r.doc_id: r for r in sentencepiece_fst.decode(sentencepiece_fst.encode(docs)).collect()}
    for i, t in enumerate(texts):
        assert rows[i].sp_ids == library.encode(t), t
        assert rows[i].sp_text == t.replace("▁", " ") and rows[i].sp_same == ("▁" not in t)
    assert rows[99].sp_ids == [] and rows[99].sp_same
    assert sentencepiece_fst.encode(none(spark)).count() == 0


def test_sentencepiece_long_and_repeated_texts(spark, library):
    rng = np.random.default_rng(7)
    run = "".join(rng.choice(list("abcdefghijkl日é"), 150_000))  # one chunk of several windows
    texts = [run, "x" * 1_500, "word " * 300_000, run[:2_000], "tie", "tie"]
    rows = sentencepiece_fst.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert r.sp_ids == library.encode(texts[r.doc_id]) and r.sp_same
    query = {r.doc_id: r for r in sentencepiece_fst.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect():
        ids = library.encode(r.text)
        assert tuple(query[r.doc_id]) == (r.doc_id, len(ids), crc32(np.array(ids, "<u4").tobytes()), True)


@pytest.mark.parametrize(("trim", "mapped", "fallback"), [(t, m, b) for t in (False, True) for m in (False, True) for b in (False, True)])
def test_unigram_models_with_weights_and_character_maps(tmp_path, trim, mapped, fallback):
    """Shortest paths by real weights, and the library's own character map, against the library."""
    import random

    import pyarrow as pa
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from packspan.llm import wordkernel as K

    r, proto = random.Random(5), pb.ModelProto()
    pieces = set("abcdeé日▁")
    while len(pieces) < 300:
        pieces.add(r.choice(["", "", "▁"]) + "".join(r.choice("abcdeé日") for _ in range(r.randint(1, 6))))
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256 if fallback else 0)), *((p, -r.uniform(1, 12), 1) for p in sorted(pieces))]
    for piece, score, kind in listed:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, fallback
    proto.normalizer_spec.remove_extra_whitespaces = trim
    if mapped:
        rules = pb.ModelProto()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    raw = proto.SerializeToString()
    (tmp_path / "m.model").write_bytes(raw)
    lib, machine = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepiece_fst.Machine(str(tmp_path / "m.model"))
    letters = list("abcdeé日  \t\nX▁ﬁ①ｱﾞ\u0301\u200b") + ["  ", "Ａ"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(600)] + ["", " ", "  ▁ ", "▁", "ab" * 200]
    cost = {i: -p.score for i, p in enumerate(proto.pieces)}
    for run in K.runs(pa.array(texts, pa.string())):
        ids, first = machine.encode_run(run)
        for k in range(run.hi - run.lo):
            got, want = ids[first[k] : first[k + 1]].tolist(), lib.encode(texts[run.lo + k])
            # paths of equal weight: the library's running sums are of single precision
            assert got == want or abs(sum(map(cost.get, got)) - sum(map(cost.get, want))) < 1e-9, texts[run.lo + k]
            assert lib.decode(got) == lib.decode(want)


def test_character_map_and_automaton():
    machine = sentencepiece_fst.Automaton([b"ab", b"abc", b"b", b"\xc3\xa9"])
    data = np.frombuffer("abcbé".encode(), np.uint8)
    at = np.array([0, 1, 2, 3, 4])
    got = sorted(zip(*(x.tolist() for x in machine.matches(data, at, np.full(5, len(data)))), strict=True))
    assert got == [(0, 2, 0), (0, 3, 1), (1, 2, 2), (3, 4, 2), (4, 6, 3)]
    assert sentencepiece_fst.character_map(b"") == {}
    keys = np.random.default_rng(0).permutation(5000).astype(np.int64) * 977
    t = wordkernel.Table(keys, np.arange(5000, dtype=np.int32))
    assert (t.get(keys) == np.arange(5000)).all() and (t.get(keys + 1) == -1).all()


# op2, op3, op9


def accuracy(scored, labels, column, label):
    rows = scored.join(labels, "doc_id").where("held").select(column, label).collect()
    return np.mean([r[0] == r[1] for r in rows]), len(rows)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    model = quality.train(docs, labels, "quality", remainder("doc_id", 5) != 0)
    out = quality.score(docs, model).selectExpr("doc_id", "cast(quality_score >= 0.3 as int) p").withColumn("held", remainder("doc_id", 5) == 0)
    got, n = accuracy(out, labels, "p", "quality")
    assert n > 50 and got >= 0.95


def test_toxicity_on_held_out_rows_and_spans(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    model = toxicity.train(docs, labels, "toxic", remainder("doc_id", 4) != 2)
    out = toxicity.score(docs, model).withColumn("held", remainder("doc_id", 4) == 2).withColumn("p", remainder("doc_id", 1)).drop("p")
    got, n = accuracy(out.selectExpr("doc_id", "held", "cast(tox_flag as int) p"), labels, "p", "toxic")
    assert n > 50 and got >= 0.9
    spans = Counter(r.text.encode()[s.start : s.end].decode().lower() for r in out.where("size(tox_spans) > 0").collect() for s in r.tox_spans)
    assert spans and all(re.fullmatch(r"[a-z]+( [a-z]+)*", w) for w, _ in spans.most_common(5))


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language.identify(docs, language.train(docs, remainder("doc_id", 5) != 0)).where(remainder("doc_id", 5) == 0).collect()
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.97


def test_classifiers_on_odd_and_empty_tables(spark, sf):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    everything = remainder("doc_id", 5) >= 0
    for docs in (odd(spark), none(spark)):
        n = docs.count()
        q = quality.score(docs, quality.train(docs, labels, "quality", everything)).collect()
        t = toxicity.score(docs, toxicity.train(docs, labels, "toxic", everything)).collect()
        assert len(q) == len(t) == n
        assert all(0 <= r.quality_score <= 1 for r in q) and all(0 <= r.tox_score <= 1 and r.tox_spans == [] for r in t)
        lang = language.identify(docs, language.train(docs, everything)).collect()
        assert len(lang) == n and all(0 <= r.lang_score <= 1 for r in lang)
        assert {r.lang_pred for r in lang if r.doc_id in (1, 2, 3, 4)} <= {"und"}
    both = table(spark, sf, "labels").withColumn("toxic", remainder("doc_id", 1))
    trained = toxicity.train(table(spark, sf, "documents"), both, "toxic", everything)
    assert toxicity.score(odd(spark), trained).where("tox_flag").count() == 0  # one class only: the share of label 1


@pytest.mark.parametrize(("query", "modulus", "left", "labelled"), [("op2_quality", 5, 0, "quality"), ("op9_toxicity", 4, 2, "toxic"), ("op3_language", 5, 0, None)])
def test_queries_of_classifiers_keep_their_contract(spark, sf, query, modulus, left, labelled):
    got = registry.queries()[query](spark, sf)
    types = dict(got.dtypes)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, sf, "documents").select("doc_id").collect())
    assert types["doc_id"] == "bigint" and types["held_out"] == "boolean" and types["score"] == "double"
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % modulus == left) and 0 <= r.score <= 1
        assert r.lang_pred if labelled is None else r.predicted == int(r.score >= 0.3)
    if labelled:
        assert types["predicted"] == "int"


def test_labels_of_held_out_rows_teach_nothing(spark, sf, tmp_path):
    """Other labels on held-out rows change no score."""
    for name in ("documents", "labels"):
        t = table(spark, sf, name)
        if name == "labels":
            t = t.withColumn("quality", F.when(remainder("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(remainder("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        else:
            t = t.withColumn("lang", F.when(remainder("doc_id", 5) == 0, F.lit("xx")).otherwise(F.col("lang")))
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("op2_quality", "op3_language", "op9_toxicity"):
        one, two = (sorted((r.doc_id, r.score) for r in registry.queries()[query](spark, d).collect()) for d in (sf, str(tmp_path)))
        assert one == two, query


def test_one_row_teaches_for_each_id(spark):
    rows = [(i % 5, f"text {i}", i) for i in range(3_000)] + [(9, "same", 0)] * 50
    got = learning.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(7)).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4, 9]
    again = learning.one_of_each(spark.createDataFrame(rows[::-1], "doc_id long, text string, y int").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    docs = spark.createDataFrame([(7, f"hot {i}", "en", "s") for i in range(2_000)] + [(i, "some text", "en", "s") for i in range(20)], DOCS)
    labels = spark.createDataFrame([(7, 1)] * 30 + [(i, 0) for i in range(20) if i != 7], "doc_id long, toxic int")
    assert learning.labelled_sample(docs, labels, "toxic", F.lit(True), 10).count() == 10


def test_classifiers_replace_clashing_columns_and_score_equal_rows_alike(spark, sf):
    base = table(spark, sf, "documents")
    docs = base.union(base).selectExpr("doc_id", "text", "lang", "'a' as quality_score", "1 as lang_pred", "'b' as tox_score", "2 as tox_spans", "3 as y", "4 as sketch", "5 as _hash")
    labels = table(spark, sf, "labels")
    everything = remainder("doc_id", 5) >= 0
    out = quality.score(docs, quality.train(docs, labels, "quality", everything))
    out = language.identify(out, language.train(docs, everything))
    out = toxicity.score(out, toxicity.train(docs, labels, "toxic", everything))
    assert sorted(out.columns) == sorted([*docs.columns, "lang_score", "tox_flag"])
    pairs = {}
    for r in out.collect():
        pairs.setdefault(r.doc_id, set()).add((r.quality_score, r.lang_pred, r.lang_score, r.tox_score))
    assert all(len(v) == 1 for v in pairs.values()) and len(pairs) == base.count()


# op4


def test_sharding_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").collect()
    by_source = {}
    for r in docs:
        by_source.setdefault(r.source, []).append((int(hashlib.md5(f"42|{r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id))
    seq = sorted(((i + 0.5) / len(v), "=" + s, h, d) for s, v in by_source.items() for i, (h, d) in enumerate(sorted(v)))
    want = {d: (p * 8 // len(seq), p - -(-(p * 8 // len(seq)) * len(seq) // 8)) for p, (_, _, _, d) in enumerate(seq)}
    text = {r.doc_id: r.text.encode() for r in docs}
    got = sharding.op4_sharding(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.shard, r.slot) == want[r.doc_id] and r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == crc32(text[r.doc_id])


def test_sharding_laws_on_odd_rows_and_a_hot_source(spark):
    rows = [*ODD, *((i, f"t{i}", "en", "hot") for i in range(100, 400)), *((1000, "same", "en", None) for _ in range(50))]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), shards=7).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    hot = Counter(r.shard for r in got if r.source == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2
    few = sharding.shard(spark.createDataFrame(ODD[:3], DOCS), shards=8).collect()
    assert len(few) == 3 and {r.slot for r in few} == {0}
    assert sharding.shard(none(spark)).count() == 0


def test_sharding_spreads_hot_ids_and_lone_sources(spark):
    """Rows of one id, of none, and sources of one row each, against the order worked out in Python."""
    rows = [(7, f"text {i % 40}", "en", "hot") for i in range(300)] + [(None, "none", "en", "hot") for _ in range(50)] + [(i, f"t{i}", "en", f"own{i}") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as size", "'x' as shard", "2 as slot", "3 as h", "4 as part", "5 as at", "6 as f", "7 as nth", "8 as before", "9 as stratum")
    got = sharding.shard(docs, shards=5).collect()
    by = {}
    for r in rows:
        text = r[1].encode()
        by.setdefault("=" + r[3], []).append((int(hashlib.md5(f"42|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), r[0] if r[0] is not None else -1, crc32(text), len(text) + 1))
    seq = sorted(((i + 0.5) / len(v), k, *x) for k, v in by.items() for i, x in enumerate(sorted(v)))
    want = Counter((x[3], x[4], x[5], p * 5 // len(seq), p - -(-(p * 5 // len(seq)) * len(seq) // 5)) for p, x in enumerate(seq))
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r["size"], r.shard, r.slot) for r in got) == want


def test_sharding_is_native(spark, sf):
    plan = sharding.op4_sharding(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# op5


def brute_hits(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            n = len(words(x))
            if i is None or not n:
                continue
            k = min(n, 5)
            want, have = shingle_set(x, k), shingle_set(t, k) if len(words(t)) >= k else set()
            if 100 * len(want & have) >= 80 * len(want):
                out.add((d, i, len(want & have), len(want)))
    return out


def test_decontamination_against_brute_force(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and {tuple(r) for r in decontam.contaminations(docs, items).collect()} == want
    assert {tuple(r) for r in decontam.contaminations(docs, items, entries=200).collect()} == want  # in several blocks


def test_decontamination_in_many_blocks_keeps_rows_and_columns(spark):
    words_ = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words_), "a"), (1, " ".join(words_), "a"), (None, " ".join(words_[:12]), "b"), (3, None, "c")], "doc_id long, text string, times string")
    items = spark.createDataFrame([(i, " ".join(words_[i : i + 9])) for i in range(30)] + [(7, " ".join(words_[7:16]))] * 2, "item_id long, text string")
    one, many = (decontam.mark(docs, items, entries=e) for e in (10**6, 20))
    assert one.columns == many.columns == ["doc_id", "text", "times", "bench_hits"] and one.schema["bench_hits"].dataType == many.schema["bench_hits"].dataType
    key = lambda r: (r.doc_id is None, r.doc_id, [tuple(h) for h in r.bench_hits])
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
    rows = {r.doc_id: [h.item_id for h in r.bench_hits] for r in one.collect()}
    assert rows[1] == sorted([*range(30), 7, 7]) and rows[3] == [] and rows[None][:3] == [0, 1, 2]


def test_decontamination_odd_rows(spark):
    filler = " ".join(f"w{i}" for i in range(30_000))
    item = "one Two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, None), (2, ""), (3, filler + " " + item.upper() + " " + filler), (4, item.replace("nine", "9")), (5, item.replace("one ", "").replace(" fourteen", "")), (6, "four five"), (6, "four five"), (None, item)]
    items = [(1, item), (1, item), (2, None), (None, item), (3, "Four FIVE"), (4, "  "), (5, "lonely")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, bench_hits string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontam.contaminations(d.select("doc_id", "text"), i).collect())
    assert set(got) == brute_hits(docs, items)
    assert got[(3, 1, 10, 10)] == 2 and got[(6, 3, 1, 1)] == 2
    assert decontam.mark(d, i).columns == ["doc_id", "text", "bench_hits"]
    assert decontam.contaminations(none(spark), i).count() == 0 and decontam.contaminations(d, i.limit(0)).count() == 0


# op6


def brute_vectors(rows, threshold=0.93):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(float)
        return a / np.linalg.norm(a)

    units = [unit(r[1]) for r in rows]
    links, count = [], Counter()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and a[2] is not None and a[2] == b[2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links.append((a[0], b[0]))
                count[a[0]] += 1
    return count, groups([r[0] for r in rows], links)


def test_vectors_against_brute_force_with_hot_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(400)]
    centre = rng.normal(size=16)
    rows += [(1000 + i, (centre + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(120)]  # more links than a list holds
    rows += [(2000 + i, centre.tolist(), 2) for i in range(60)]  # copies
    rows += [(3000 + i, (np.array(rows[i][1]) + 0.01).tolist(), rows[i][2]) for i in range(0, 300, 7)]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 16, 1), (4003, [None] * 16, 1), (4004, [float("nan")] * 16, 1), (4005, centre.tolist(), None), (4006, [1.0, 2.0], 1), (4007, (centre * 1e-30).tolist(), 2)]
    count, comp = brute_vectors(rows)
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), k=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id), r


def test_vectors_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, n_links string"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = vectors.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, "x"), (7, [1.0, 0.0], 1, "x"), (7, [1.0, 0.0], 1, "x")], schema)).collect()
    assert sorted((r.vec_id is None, r.n_links, r.component_id, r.kept) for r in got) == [(False, 1, 7, True), (False, 1, 7, True), (True, 0, None, True)]


# op7


def test_shards_equal_the_library_and_look_up(spark, sf):
    from pyarrow import fs as pafs
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(sstable.default_tokenizer())
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    rows += [(-5, "It's <|endoftext|> ΑΣ. x"), (2**62, None), (-(2**63), ""), (None, "no id"), (77_777, "twice"), (77_777, "twice again")]
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), file_rows=40)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = Counter((i, *tok.encode(t or "", add_special_tokens=False).ids, 1) for i, t in rows)
    assert Counter((r.id, *r.ids) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    files = manifest.collect()
    assert len(files) > 3
    found = {}
    for f in files:
        store, path = pafs.FileSystem.from_uri(f.path)
        with store.open_input_file(path) as source:
            reader = sstable.Reader(source)
            for i in (-5, 77_777, 2**62, None, 123_456_789):
                found.setdefault(i, []).extend(x.tolist() for x in reader.lookup(i))
    for i in (-5, 77_777, 2**62, None, 123_456_789):
        assert Counter(map(tuple, found[i])) == Counter(tuple(r.ids) for r in got if r.id == i)
    assert sstable.read_shards(sstable.write_shards(none(spark))).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    """A cased byte-level tokenizer, for which no cut is known to be safe."""
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(file)
    assert sstable.Encoder(sstable.default_tokenizer()).segmented and not sstable.Encoder(file).segmented
    texts = ["Hello  World, It's ABC\n\n x", "", None, "ΑΣ <|endoftext|> é", "  lead"]
    got = sstable.read_shards(sstable.write_shards(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bucket string"), tokenizer_file=file)).collect()
    assert {r.id: r.ids for r in got} == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_shards_of_long_texts_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(sstable.default_tokenizer())
    rows = [(5, f"text number {i}") for i in range(60)] + [(4, "word, " * 200_000), (6, "z" * 3_000)]
    reads = [sorted(((r.start, r.id, tuple(r.ids)) for r in sstable.read_shards(sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(p))).collect())) for p in (1, 5)]
    assert [x[1] for x in reads[0]] == sorted(r[0] for r in rows)
    want = Counter((i, *tok.encode(t, add_special_tokens=False).ids, 1) for i, t in rows)
    for got in reads:
        assert Counter((i, *ids) for _, i, ids in got) == want


def test_writer_refuses_keys_out_of_order():
    import io

    w = sstable.Writer(io.BytesIO(), block_bytes=8)
    w.add(sstable.key_of(5), np.array([1]))
    with pytest.raises(ValueError):
        w.add(sstable.key_of(4), np.array([1]))


# op8


def brute_copies(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = groups(list(sets), links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_copies_against_brute_force(spark, sf, k, percent):
    rng = np.random.default_rng(k)
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    base = [f"v{rng.integers(900)}" for _ in range(120)]
    for i in range(150):  # a chain of groups around the threshold, with near misses
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 7)):
            w[j] = f"u{rng.integers(9)}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000 + i, rows[3][1]) for i in range(40)]
    rows += [(30_000, None), (30_001, ""), (30_002, " \n"), (30_003, "one"), (30_004, "ONE"), (30_005, "one two"), (30_006, "two one")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_copies(rows, k, percent)


@pytest.mark.parametrize(("block", "shingles"), [(8, 1 << 18), (2048, 900), (8, 900)])
def test_crossing_blocks_link_what_pivots_miss(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    rng = np.random.default_rng(9)
    step = [f"s{i}" for i in range(200)]
    rows = []
    for i in range(60):  # neighbours in a chain are alike, ends are not
        w = list(step)
        for j in range(0, i):
            w[(j * 7) % 200] = f"c{j}"
        rows.append((int(rng.permutation(60)[0]) * 1000 + i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_copies(rows, 3, 85)


def test_a_bucket_of_many_dissimilar_texts(spark):
    """A common passage puts thousands of texts in the same buckets without making them alike; one pair among them is."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 25))) for i in range(3_000)]
    rows.append((5_000, rows[2_500][1] + " more"))
    rows += [(6_000 + i, "short text " + "zz " * i) for i in range(5)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    assert neardup.audit(spark.createDataFrame(rows, "doc_id long, text string"), found, sample=50)[0] >= 1
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got[5_000] == 2_500 and sum(got[i] == i for i in range(3_000)) == 3_000


def test_audit_counts_links_and_what_was_found(spark, sf):
    docs = table(spark, sf, "documents")
    found = neardup.near_duplicates(docs)
    links, seen = neardup.audit(docs, found, sample=500)
    assert links == seen > 0
    alone = found.selectExpr("doc_id", "n_shingles", "doc_id as component_id", "true as kept")
    links, seen = neardup.audit(docs, alone, sample=500)
    assert links > 0 and seen == 0
    assert neardup.audit(none(spark), neardup.near_duplicates(none(spark))) == (0, 0)


def test_shuffles_in_place_of_broadcasts(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    want = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want


def test_near_copies_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "'x' as n", "'y' as rep", "0 as component_id")
    got = neardup.near_duplicates(docs, k=3, percent=85).collect()
    assert len(got) == len(ODD)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.doc_id is not None)
    assert neardup.near_duplicates(none(spark)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def test_lookups_with_and_without_a_sieve(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, f"t{i}", "x") for i in range(3_000)], "doc_id long, text string, _note string")
    ids = spark.createDataFrame([(i,) for i in range(0, 9_000, 3)] + [(-5,), (2**62,)], "doc_id long")
    for few in (None, 0):
        assert {r.doc_id for r in lookup.semi(rows, ids, "doc_id", few).collect()} == {i for i in range(0, 3_000, 3) if i % 7}
        kept = lookup.anti(rows, ids, "doc_id", few)
        assert kept.columns == rows.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(i if i % 7 else None for i in range(3_000) if i % 3 or i % 7 == 0)
        assert lookup.semi(rows, ids.limit(0), "doc_id", few).count() == 0 and lookup.anti(rows, ids.limit(0), "doc_id", few).count() == 3_000


# op10


def test_warc_round_trip_with_revisits(spark):
    long = "y" * 200_000
    rows = [(5, "http://b.example.com/x", "<p>same</p>"), (3, "http://a.example.com/?q=1", "<p>same</p>"), (9, "http://a.example.com/?q=1", "<p>same</p>"), (1, None, None), (2, "not a url\r\nX: y", ""), (4, "http://b.example.com/y", long), (6, "http://b.example.com/y", "é日"), (None, "http://c.example.com", "<p>same</p>"), (7, "http://d.example.com", "one"), (7, "http://d.example.com", "one")]
    rows += [(100 + i, "http://hot.example.com/", f"<p>{i % 5}</p>") for i in range(60)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    got = warc.read_captures(warc.merged_index(warc.write_archives(pages)), keep_payload=True).collect()
    assert len(got) == len(rows)
    smallest = {}
    for i, _, h in rows:
        if i is not None:
            smallest[h or ""] = min(i, smallest.get(h or "", i))
    seen = Counter()
    for r in got:
        html = next((h or "") for i, _, h in rows if i == r.page_id)
        raw = html.encode()
        seen[r.page_id] += r.record_type == "response"
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if r.record_type == "response":
            assert r.refers_to is None and r.payload == raw and (r.page_id is None or r.page_id == smallest[html])
        else:
            assert r.refers_to == smallest[html]
    assert seen[7] == 1 and seen[3] == 1 and seen[5] == 0 and seen[None] == 1
    order = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.range, r.pos))]
    assert order == sorted(order)
    assert warc.read_captures(warc.merged_index(warc.write_archives(pages.limit(0)))).count() == 0


@pytest.mark.parametrize("fan_in", [2, 3, 100])
def test_warc_merges_in_passes(spark, monkeypatch, fan_in):
    monkeypatch.setattr(warc, "CHUNK", 4)
    monkeypatch.setattr(warc, "BATCH", 5)
    rows = [(i, f"http://h{i % 11}.example.com/{i % 3}", f"<p>{i % 40}</p>") for i in range(200)]
    chunks = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(10))
    assert chunks.select("run").distinct().count() == 10
    assert warc.fewer_runs(chunks, fan_in).select("run").distinct().count() <= fan_in
    got = sorted(warc.read_captures(warc.merged_index(chunks, range_rows=60, fan_in=fan_in)).collect(), key=lambda r: (r.range, r.pos))
    assert [(r.url_key, r.ts, r.page_id) for r in got] == sorted((warc.url_key(u), 1_704_067_200 + i, i) for i, u, _ in rows)
    assert {r.page_id for r in got if r.record_type == "response"} == set(range(40))


def test_warc_over_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    got = warc.op10_warc(spark, sf).collect()
    assert len(got) == len(pages) == len({r.page_id for r in got})
    for r in got:
        assert r.payload_bytes == len(pages[r.page_id]) and r.payload_digest == base64.b32encode(hashlib.sha1(pages[r.page_id]).digest()).decode()
