"""Vectorised kernels against plain Python."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from packspan.llm import language, neardup, quality, toxicity, warc
from packspan.llm import wordkernel as K

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b,日", max_size=30)), max_size=8)


def plain_words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


@given(texts, st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_words_and_shingles(rows, run_bytes):
    got = []
    for run in K.runs(pa.array(rows, pa.string()), run_bytes):
        w = K.words(run)
        h, first = K.distinct_by_row(*K.shingles(w, 3))
        for r in range(run.hi - run.lo):
            mine = slice(w.first[r], w.first[r + 1])
            got.append(([bytes(w.low[a:b]) for a, b in zip(w.starts[mine], w.ends[mine], strict=True)], w.hashes[mine].tolist(), set(h[first[r] : first[r + 1]].tolist())))
    assert [g[0] for g in got] == [plain_words(t) for t in rows]
    by_word = {}
    for ws, hs, _ in got:
        for w, h in zip(ws, hs, strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set() for w in (g[0] for g in got)]
    for (_, _, a), x in zip(got, sets, strict=True):
        assert len(a) == len(x)
    for i, j in itertools.combinations(range(len(sets)), 2):
        assert len(got[i][2] & got[j][2]) == len(sets[i] & sets[j])


def test_long_text_is_one_run():
    t = "word " * 500_000
    (run,) = K.runs(pa.array([t]))
    w = K.words(run)
    assert len(w.starts) == 500_000 and len(np.unique(w.hashes)) == 1


@given(st.lists(st.tuples(st.booleans(), st.floats(-4, 4)), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_forward_backward_is_exact(steps):
    head = np.array([s[0] for s in steps])
    head[0] = True
    e = np.array([s[1] for s in steps])
    trans, start = np.array([[0.3, -1.0], [0.2, 0.7]]), np.array([0.1, -0.5])
    got, joint = toxicity.forward_backward(e, head, trans, start, pairs=True)
    total, hot, both = 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=len(e)):
        s = sum(start[y[i]] if head[i] else trans[y[i - 1], y[i]] for i in range(len(e))) + sum(e[i] * y[i] for i in range(len(e)))
        p = np.exp(s)
        total += p
        hot += p * np.array(y)
        for i in range(1, len(e)):
            if not head[i]:
                both[y[i - 1], y[i]] += p
    assert np.allclose(got, hot / total) and np.allclose(joint.sum(2), both / total)


def test_forward_backward_over_many_blocks():
    rng = np.random.default_rng(0)
    e, head = rng.normal(size=3000), rng.random(3000) < 0.01
    head[0] = True
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    got, _ = toxicity.forward_backward(e, head, trans, start)
    edges = [*np.flatnonzero(head), 3000]
    parts = [toxicity.forward_backward(e[a:b], head[a:b], trans, start)[0] for a, b in itertools.pairwise(edges)]
    assert np.allclose(got, np.concatenate(parts))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [pool[:1], pool[:3], pool[:600], pool[150:750], pool[:0]]
    s = neardup.fast_sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    assert (s[:4] != 0xFFFFFFFFFFFFFFFF).all() and (s[4] == 0xFFFFFFFFFFFFFFFF).all()
    assert abs((s[2] == s[3]).mean() - 450 / 750) < 0.15
    assert (s[2] == neardup.fast_sketches(rng.permutation(sets[2]), np.array([0, 600]))[0]).all()


def test_band_rows_bound_the_misses():
    for percent in (50, 80, 85, 95):
        r = neardup.band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (neardup.COORDINATES // r) <= neardup.MISS or r == 1


def test_the_cut_of_sketches_and_bands_bound_the_misses_together():
    for percent in (50, 80, 85, 95):
        t, theta, r, c = neardup.COORDINATES, percent / 100, neardup.band_rows(percent), neardup.least_agreement(percent)
        below = sum(math.comb(t, k) * theta**k * (1 - theta) ** (t - k) for k in range(c))
        assert 0 < below + (1 - theta**r) ** (t // r) <= neardup.MISS * (1 + 1e-9)
    assert neardup.least_agreement(100) == neardup.COORDINATES
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (2, 50, 240)).astype(np.uint8)
    assert (neardup._agreement(a.view(np.uint64), b.view(np.uint64)) == (a == b).sum(1)).all()


@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=9))
@settings(max_examples=150, deadline=None)
def test_loser_tree_merges(runs):
    streams = [[(x, i) for x in sorted(r)] for i, r in enumerate(runs)]
    assert list(warc.LoserTree([iter(s) for s in streams])) == sorted(itertools.chain(*streams), key=lambda t: (t[0], t[1]))


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a/?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key(None) == ")" and warc.url_key("http://[bad") == ")http://[bad"
    assert warc.url_key("https://example.com") == warc.url_key("http://example.com/")


def test_long_texts_in_slices_give_the_same_words_and_indicators(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ab C1.,! \n")) for _ in range(9_000)) + "x" * 700 + " end"
    (run,) = K.runs(pa.array([text]))
    whole, ids = K.words(run), next(quality.indicators(run))
    model = language.Model(["a", "b"], 64, 3, rng.normal(size=(256, 4)).astype(np.float32), rng.normal(size=(12, 5)).astype(np.float32), np.zeros(5, np.float32), rng.normal(size=(5, 2)).astype(np.float32), np.zeros(2, np.float32))
    best, prob = language.identify_run(model, run)
    monkeypatch.setattr(K, "RUN_BYTES", 500)
    monkeypatch.setattr(language, "RUN_BYTES", 256)
    parts = K.words(run)
    for a, b in ((whole.starts, parts.starts), (whole.ends, parts.ends), (whole.hashes, parts.hashes), (whole.first, parts.first)):
        assert (a == b).all()
    assert (next(quality.indicators(run)) == ids).all()
    best2, prob2 = language.identify_run(model, run)
    assert best2[0] == best[0] and np.allclose(prob, prob2)
    two = pa.array([text, None, text[:50]])
    (run,) = K.runs(two, 1 << 20)
    w = K.words(run)
    assert w.first.tolist() == [0, len(whole.starts), len(whole.starts), len(w.starts)]


def test_convolution_gradients_against_finite_differences():
    rng = np.random.default_rng(1)
    span, dims, filters, length, n = 3, 2, 4, 9, 5
    mask = np.ones((span * dims, filters))
    mask[2 * dims :, :2] = 0  # two filters of width two
    arrays = {"embed": rng.normal(size=(256, dims)), "kernel": rng.normal(size=(span * dims, filters)) * mask, "kernel_bias": rng.normal(size=filters), "dense": rng.normal(size=(filters, 3)), "dense_bias": rng.normal(size=3)}
    x, y = rng.integers(97, 102, (n, length)).astype(np.uint8), rng.integers(0, 3, n)

    def loss(values):
        m = language.Model(["a", "b", "c"], length, span, **values)
        out = 0.0
        for window, want in zip(x, y, strict=True):
            e = np.concatenate([values["embed"][window], np.zeros((span - 1, dims))])
            pooled = [max(0.0, max(sum(e[i + j] @ values["kernel"][j * dims : (j + 1) * dims, f] for j in range(span)) for i in range(length)) + values["kernel_bias"][f]) for f in range(filters)]
            o = np.array(pooled) @ values["dense"] + values["dense_bias"]
            out -= o[want] - np.log(np.exp(o).sum())
        return out / n, m

    value, model = loss(arrays)
    got, grad = language.gradients(model, x, y, mask)
    assert abs(got - value) < 1e-5
    for name, a in arrays.items():
        places = [tuple(rng.integers(0, s) for s in a.shape) for _ in range(6)] if name != "embed" else [(c, k) for c in range(97, 102) for k in range(dims)]
        for at in places:
            if name == "kernel" and not mask[at]:
                assert grad[name][at] == 0
                continue
            step = {k: v.copy() for k, v in arrays.items()}
            step[name][at] += 1e-5
            up = loss(step)[0]
            step[name][at] -= 2e-5
            assert abs((up - loss(step)[0]) / 2e-5 - grad[name][at]) < 1e-3, (name, at)


def test_coordinate_descent_reaches_the_optimum_of_the_dual():
    """Against projected gradient steps on the dual, run until they stand still."""
    rng = np.random.default_rng(2)
    n, size, cost = 24, 10, 1.0
    ids = [np.sort(rng.choice(size, rng.integers(1, 6), replace=False)) for _ in range(n)]
    values = [rng.normal(size=len(i)) for i in ids]
    sign = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    w, bias, alpha = quality.descend(ids, values, sign, size, cost, 400)
    x = np.zeros((n, size + 1))
    for r, (i, v) in enumerate(zip(ids, values, strict=True)):
        x[r, i], x[r, size] = v, 1.0
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    best, rate = np.zeros(n), 1.0 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        best = np.clip(best - rate * (q @ best - 1), 0, cost)
    dual = lambda a: a.sum() - a @ q @ a / 2
    assert abs(dual(alpha) - dual(best)) < 1e-6 and (alpha >= 0).all() and (alpha <= cost).all()
    assert np.allclose(np.append(w, bias), (alpha * sign) @ x)
    primal = (w @ w + bias * bias) / 2 + cost * np.maximum(0, 1 - sign * (x @ np.append(w, bias))).sum()
    assert abs(primal - dual(alpha)) < 1e-4  # no gap


def test_rare_words_are_tagged_by_their_context():
    """A word in too few documents for any test stands where listed words stand; the same word elsewhere is clean."""
    rng = np.random.default_rng(6)
    plain = [f"w{i}" for i in range(60)]
    bad = [f"bad{i}" for i in range(4)]

    def text(toxic, word=None):
        t = [plain[i] for i in rng.integers(0, 60, 30)]
        if toxic:
            t[14:17] = ["you", word or bad[rng.integers(4)], "creature"]
        return " ".join(t)

    rows = [(1, text(True)) for _ in range(60)] + [(1, text(True, f"rare{i % 3}")) for i in range(6)] + [(0, text(False)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["y", "text"])
    sample = [tuple(r.values()) for b in toxicity._features(iter([batch])) for r in b.to_pylist()]
    tags = {}
    for passes in (1, 2):
        model = toxicity.fit(sample, toxicity.Config(passes=passes, min_share=0.9))
        probe = ["w1 w2 you rare0 creature w3", "w1 w2 w4 w5 w6 w3", "w1 you bad1 creature w2"]
        (run,) = K.runs(pa.array(probe))
        scores, spans = toxicity.tag_run(model, run)
        tags[passes] = [[probe[r][x["start"] : x["end"]] for x in spans[r]] for r in range(3)]
        assert not spans[1] and any("bad1" in x for x in tags[passes][2])
        assert scores[2] > 0.5 > scores[1]
    assert any("rare0" in x for x in tags[2][0])
