"""Corpus operators do the whole job where a bound, a prefix or a shut-off would go unnoticed."""

import numpy as np
import pytest

from packspan.llm import toxicity, vectors
from packspan.llm.learning import remainder
from packspan.runtime import Cut, table


def test_toxicity_learns_from_few_labels(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    out = toxicity.score(docs, toxicity.train(docs, labels, "toxic", remainder("doc_id", 4) != 2)).join(labels, "doc_id").collect()
    hits = [r for r in out if r.tox_flag and r.toxic == 1]
    assert len(hits) >= 0.5 * sum(r.toxic == 1 for r in out)
    assert sum(r.tox_flag and r.toxic == 0 for r in out) <= 1
    assert any(r.tox_spans for r in hits)
    assert toxicity.op9_toxicity(spark, sf).where("predicted = 1").count() >= len(hits)


@pytest.mark.parametrize("audit", [200, 1])
def test_vectors_below_the_audited_recall_are_searched_exactly(spark, monkeypatch, audit):
    nothing = spark.createDataFrame([], "u long, v long, sim float, fresh int")
    monkeypatch.setattr(vectors, "neighbour_graph", lambda *a, **b: Cut(nothing, "graph"))
    x = np.random.default_rng(4).normal(size=(120, 16))
    x[1] = x[0] + 0.05  # the only links are 0-1 and 2-3
    x[3] = x[2] + 0.05
    rows = [(i, "a", [float(c) for c in v]) for i, v in enumerate(x)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"), audit=audit).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    assert want.sum() == 4 and {r.vec_id: r.n_links for r in got} == dict(enumerate(want))
    assert {r.vec_id for r in got if not r.kept} == {1, 3}


def test_vector_cells_grow_with_the_label():
    assert vectors._rounds(vectors._bits(1_000), 0.93) == vectors.ROUNDS
    for n in (100_000, 1_000_000, 10_000_000, 10**9):
        bits = vectors._bits(n)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** vectors._rounds(bits, 0.93) <= vectors.CELL_MISS
