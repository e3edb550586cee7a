"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, digits and non-ASCII bytes. Labels mark whole documents, so training tokens are labelled from
them in two passes. First a token of a toxic document is TOXIC if its word is in so many toxic documents, and in so few
others, that few of the words taken are so by accident (exact tests with a bounded false share), copies of a document
counted once; the other tokens of toxic documents are open, and those of clean documents CLEAN. A two-state CRF over the word
and its two neighbours is fitted to the labelled tokens by gradient steps on the exact likelihood. Then the fitted marginals
label the open tokens, so that a word too rare for a test is taken by its context, and the CRF is fitted again.

Every token of the sample teaches: a step sees all tokens near toxic ones and one of ``Config.portions`` portions of the
rest, in turn. Forward-backward marginals give each token's probability; a document's score is the calibrated chance that one
of its tokens at least is toxic, and runs of tokens at 0.5 or more are its spans (byte offsets into the UTF-8 text).

Memory: a task holds one run of texts (``wordkernel.RUN_BYTES``) or one longer text, one task the sample (``Config.bound``
rows), and the driver the model (a few MB). None grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspan.llm import wordkernel as K
from packspan.llm.learning import fit_in_task, keep_one_of_copies, labelled_sample, platt, sigmoid
from packspan.runtime import ship

#: ASCII letters and digits and all bytes of non-ASCII characters belong to tokens; the rest parts them.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

SPANS = "array<struct<start:int,end:int,p:float>>"


@dataclass(frozen=True)
class Config:
    bound: int = 8_000  #: labelled documents that the model may learn from
    min_documents: int = 3  #: documents that a word must occur in to be tested
    min_share: float = 0.5  #: share of toxic documents among those with a toxic word, at least
    error: float = 0.01  #: share of the words taken as toxic that are expected to be so by accident
    few_error: float = 0.1  #: the same where few labels let no bar reach ``error``: the bar with the least share holds up to this
    context: int = 12  #: tokens on each side of a toxic training token that every step sees
    portions: int = 16  #: of the tokens further away; each step sees one
    passes: int = 2  #: fits; the first one leaves tokens of toxic documents open that no test has told
    steps: int = 120  #: of each pass
    least: float = 0.01  #: weights of words that don't reach it count 0
    threshold: float = 0.3


@dataclass
class Model:
    words: K.Table  #: hashes of the words with a weight, to columns of ``weights``
    weights: np.ndarray  #: (3, words + 1) log-potentials of TOXIC for the word, the one before and the one after; the last are 0
    bias: float
    trans: np.ndarray  #: (2, 2) log-potentials
    start: np.ndarray  #: (2,) log-potentials of a document's first token
    slope: float
    offset: float

    def emissions(self, hashes: np.ndarray, head: np.ndarray) -> np.ndarray:
        return potentials(self.weights, self.bias, self.words.get(_word_key(hashes)), head)


def _word_key(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(1)).astype(np.int64)


def potentials(weights: np.ndarray, bias: float, idx: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Log-potentials of TOXIC for tokens of the words ``idx`` (-1: the last column)."""
    e = weights[0][idx] + np.float32(bias)
    if len(idx) > 1:
        inside = ~head[1:]
        e[1:] += weights[1][idx[:-1]] * inside
        e[:-1] += weights[2][idx[1:]] * inside
    return e


def forward_backward(e: np.ndarray, head: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Exact TOXIC marginals of a flat run of chains, and of neighbouring tokens' pairs (from, to, first token) if asked for.

    ``head`` marks each chain's first token; a pair across chains has 0.

    A chain's first token has a potential that ignores what precedes it, so all chains of a run are one chain. Blocks of
    about sqrt(T) tokens are multiplied in parallel, the block products are chained, and the blocks are filled in.
    """
    total = len(e)
    if total == 0:
        return np.zeros(0), np.zeros((2, 2, 0))
    size = max(8, int(np.sqrt(total)))
    blocks = -(-total // size)
    x = np.exp(np.clip(e.astype(np.float64), -30, 30))
    t, s = np.exp(trans), np.exp(start)
    m = np.empty((2, 2, blocks * size))
    for a in (0, 1):
        m[a, 0, :total] = np.where(head, s[0], t[a, 0])
        m[a, 1, :total] = np.where(head, s[1], t[a, 1]) * x
        m[a, :, total:] = np.eye(2)[a][:, None]
    m = np.ascontiguousarray(m.reshape(2, 2, blocks, size).transpose(3, 0, 1, 2))  # step, from, to, block
    prod = np.zeros((2, 2, blocks))
    prod[0, 0] = prod[1, 1] = 1
    for j in range(size):
        mj = m[j]
        prod = prod[:, :1] * mj[0] + prod[:, 1:] * mj[1]
        prod /= prod.sum((0, 1))
    inward, back = np.empty((2, blocks)), np.empty((2, blocks))
    a0, a1 = 1.0, 0.0
    p = prod.transpose(2, 0, 1).tolist()
    for b in range(blocks):
        inward[0, b], inward[1, b] = a0, a1
        (p00, p01), (p10, p11) = p[b]
        a0, a1 = a0 * p00 + a1 * p10, a0 * p01 + a1 * p11
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
    r0 = r1 = 1.0
    for b in range(blocks - 1, -1, -1):
        back[0, b], back[1, b] = r0, r1
        (p00, p01), (p10, p11) = p[b]
        r0, r1 = p00 * r0 + p01 * r1, p10 * r0 + p11 * r1
        z = r0 + r1
        r0, r1 = r0 / z, r1 / z
    alpha, beta = np.empty((size, 2, blocks)), np.empty((size, 2, blocks))
    cur = inward
    for j in range(size):
        cur = cur[:1] * m[j, 0] + cur[1:] * m[j, 1]
        cur = cur / cur.sum(0)
        alpha[j] = cur
    cur = back
    for j in range(size - 1, -1, -1):
        beta[j] = cur
        cur = m[j, :, 0] * cur[0] + m[j, :, 1] * cur[1]
        cur = cur / cur.sum(0)
    g = alpha * beta
    marginal = (g[:, 1] / g.sum(1)).T.reshape(-1)[:total]
    if not pairs:
        return marginal, None
    al, be, mm = (v.transpose(*order).reshape(*v.shape[1:-1], -1) for v, order in ((alpha, (1, 2, 0)), (beta, (1, 2, 0)), (m, (1, 2, 3, 0))))
    al, be, mm = al[:, :total], be[:, :total], mm[:, :, :total]
    joint = al[:, None, :-1] * mm[:, :, 1:] * be[None, :, 1:]
    joint = joint / joint.sum((0, 1)) * ~head[1:]
    return marginal, joint


def _tails(n: int, docs: int, toxic: int, lf: np.ndarray) -> np.ndarray:
    """Chances that k or more of n documents, drawn from all, are toxic; for k from 0 to n, by log-factorials ``lf``."""
    lo, hi = max(0, n + toxic - docs), min(n, toxic)
    k = np.arange(lo, hi + 1)
    ways = lf[toxic] - lf[k] - lf[toxic - k] + lf[docs - toxic] - lf[n - k] - lf[docs - toxic - n + k]
    out = np.zeros(n + 1)
    out[lo : hi + 1] = np.cumsum(np.exp(ways - (lf[docs] - lf[n] - lf[docs - n]))[::-1])[::-1]
    out[: lo + 1] = 1.0
    return np.minimum(out, 1.0)


def _toxic_words(seen: np.ndarray, toxic: np.ndarray, y: np.ndarray, cfg: Config) -> np.ndarray:
    """Which words are toxic, from the numbers of documents and of toxic documents with each.

    Fisher's exact test; the bar is the highest chance at which at most ``cfg.error`` of the words found are expected to be
    accidents. The expectation sums, for each word tested, the greatest chance below the bar that its number of documents
    can have at all, so words in few documents don't raise the bar for others. Few labels may leave every share above
    ``cfg.error``: then the bar with the least share holds, up to ``cfg.few_error``.
    """
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(y) + 1)))])
    often = seen >= cfg.min_documents
    chance = np.ones(len(seen))
    tails = {}
    for n, words in zip(*np.unique(seen[often], return_counts=True), strict=True):
        tails[int(n)] = _tails(int(n), len(y), int(y.sum()), lf), int(words)
        at = often & (seen == n)
        chance[at] = tails[int(n)][0][toxic[at]]
    able = often & (toxic >= cfg.min_share * seen)
    bars, found = np.unique(chance[able], return_counts=True)
    if not len(bars):
        return able
    accidents = np.zeros(len(bars))
    for t, words in tails.values():
        rising = np.concatenate([[0.0], t[::-1]])
        accidents += words * rising[np.searchsorted(rising, bars, "right") - 1]
    share = accidents / np.cumsum(found)
    good = np.flatnonzero(share <= max(cfg.error, min(share.min(), cfg.few_error)))
    return able & (chance <= bars[good[-1]]) if len(good) else np.zeros(len(seen), bool)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token hashes of each training document, and a sketch by which copies are told."""
    for batch in batches:
        tokens, sketches = [], []
        for run in K.runs(batch.column("text")):
            w = K.words(run, space_table=APART)
            h, first = K.shingles(w, 2)
            seeds = K.mix(np.arange(1, 17, dtype=np.uint64))
            for k in range(run.hi - run.lo):
                tokens.append(w.hashes[w.first[k] : w.first[k + 1]].tobytes())
                s = h[first[k] : first[k + 1]]
                sketches.append((np.array([K.mix(s ^ x).min() for x in seeds]) if len(s) else seeds).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(tokens, pa.binary()), pa.array(sketches, pa.binary())], ["y", "tokens", "sketch"])


def token_labels(docs: list[np.ndarray], y: np.ndarray, cfg: Config) -> list[np.ndarray]:
    """Which tokens of each document are TOXIC, from the documents' labels."""
    rows = [np.unique(d) for d in docs]
    words = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
    seen, toxic = np.zeros(len(words), int), np.zeros(len(words), int)
    for r, label in zip(rows, y, strict=True):
        at = np.searchsorted(words, r)
        seen[at] += 1
        toxic[at] += int(label)
    chosen = words[_toxic_words(seen, toxic, y, cfg)]
    return [np.isin(d, chosen) & bool(t) for d, t in zip(docs, y, strict=True)]


def _none() -> K.Table:
    return K.Table(np.zeros(0, np.int64), np.zeros(0, np.int32))


def fit(sample: list[tuple[int, bytes, bytes]], cfg: Config) -> Model:
    """Fit tags, transitions and calibration; without both classes every score is the share of toxic labels."""
    sample = sorted(sample, key=lambda r: (r[2], r[1], r[0]))
    y = np.array([r[0] for r in sample], float)
    model = Model(_none(), np.zeros((3, 1), np.float32), -6.0, np.zeros((2, 2)), np.zeros(2), 0.0, -6.0)
    if len(y) == 0:
        return model
    base = (y.sum() + 1) / (len(y) + 20)
    model.offset = float(np.log(base / (1 - base)))
    if y.min() == y.max():
        return model
    kept = keep_one_of_copies(np.stack([np.frombuffer(r[2], np.uint64) for r in sample]))
    docs, y = [np.frombuffer(sample[i][1], np.uint64) for i in kept], y[kept]
    tags = token_labels(docs, y, cfg)
    told = [t | (label == 0) for t, label in zip(tags, y, strict=True)]
    if not any(t.any() for t in tags):
        return model
    for round_ in range(cfg.passes):
        _train(model, docs, tags, told, cfg)
        if round_ + 1 < cfg.passes:
            # the open tokens of toxic documents are labelled by what the words around them say
            for i in np.flatnonzero(y == 1):
                head = np.arange(len(docs[i])) == 0
                p, _ = forward_backward(model.emissions(docs[i], head), head, model.trans, model.start)
                tags[i] = tags[i] | ((p >= 0.5) & ~told[i])
                told[i] = np.ones(len(docs[i]), bool)
    z = _document_logits(model, docs)
    model.slope, model.offset = platt(z, y)
    return model


def _near(tag: np.ndarray, context: int) -> np.ndarray:
    hit, cover = np.flatnonzero(tag), np.zeros(len(tag) + 1, int)
    np.add.at(cover, np.maximum(hit - context, 0), 1)
    np.add.at(cover, np.minimum(hit + context + 1, len(tag)), -1)
    return np.cumsum(cover)[:-1] > 0


def _train(model: Model, docs: list[np.ndarray], tags: list[np.ndarray], told: list[np.ndarray], cfg: Config) -> None:
    """Fit to the tokens that ``told`` marks. Chains are the stretches near toxic tokens, and those between them."""
    used = np.unique(np.concatenate([np.unique(d) for d in docs]))  # only words that occur are fitted
    flat = np.concatenate([np.searchsorted(used, d).astype(np.int32) for d in docs])
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    tag, known = np.concatenate(tags), np.concatenate(told)
    near = np.concatenate([_near(t, cfg.context) for t in tags])
    head = np.zeros(len(flat), bool)
    head[first[:-1][first[:-1] < len(flat)]] = True
    head[1:] |= near[1:] != near[:-1]
    portion = np.where(near, -1, (np.cumsum(head, dtype=np.int32) - 1) % cfg.portions).astype(np.int8)
    size = len(used) + 1
    theta = [np.zeros((3, size)), np.array(-4.0), np.zeros((2, 2)), np.zeros(2)]
    low, high = [np.zeros_like(v) for v in theta], [np.zeros_like(v) for v in theta]
    for step in range(1, cfg.steps + 1):
        at = np.flatnonzero((portion < 0) | (portion == step % cfg.portions))
        idx, state, sure, begin = flat[at], tag[at].astype(float), known[at], head[at]
        inside = ~begin[1:]
        trans, start = theta[2], theta[3]
        p, joint = forward_backward(potentials(theta[0], float(theta[1]), idx, begin), begin, trans, start, pairs=True)
        target = np.where(sure, state, p)  # open tokens pull nowhere
        d = target - p
        grad = [np.zeros((3, size)), d.sum(), np.zeros((2, 2)), np.zeros(2)]
        both = inside & sure[1:] & sure[:-1]
        np.add.at(grad[2], (state[:-1][both].astype(int), state[1:][both].astype(int)), 1)
        grad[2] -= (joint * both).sum(2)  # of the pairs whose labels are known
        first_sure = begin & sure
        grad[3] += np.bincount(state[first_sure].astype(int), minlength=2) - np.array([(1 - p)[first_sure].sum(), p[first_sure].sum()])
        grad[0][0] = np.bincount(idx, weights=d, minlength=size)
        grad[0][1] = np.bincount(idx[:-1], weights=d[1:] * inside, minlength=size)
        grad[0][2] = np.bincount(idx[1:], weights=d[:-1] * inside, minlength=size)
        for k in range(4):
            g = grad[k] - (0.05 if k == 0 else 1e-3) * theta[k]
            low[k] = 0.9 * low[k] + 0.1 * g
            high[k] = 0.99 * high[k] + 0.01 * g * g
            theta[k] = theta[k] + 0.3 * (low[k] / (1 - 0.9**step)) / (np.sqrt(high[k] / (1 - 0.99**step)) + 1e-3)
    heavy = np.flatnonzero(np.abs(theta[0][:, :-1]).max(0) >= cfg.least)
    model.words = K.Table(_word_key(used[heavy]), np.arange(len(heavy), dtype=np.int32))
    model.weights = np.concatenate([theta[0][:, heavy], np.zeros((3, 1))], 1).astype(np.float32)
    model.bias, model.trans, model.start = float(theta[1]), theta[2], theta[3]


def _logit_any(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds that one token of each document at least is toxic, within 12 of 0; documents without tokens have -12."""
    none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
    q = none[first[1:]] - none[first[:-1]]
    return np.clip(np.log(np.maximum(-np.expm1(q), 1e-300)) - q, -12, 12)


def _document_logits(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    out = [np.zeros(0)]
    for lo in range(0, len(docs), 256):
        part = docs[lo : lo + 256]
        first = np.concatenate([[0], np.cumsum([len(d) for d in part])])
        head = np.zeros(int(first[-1]), bool)
        head[first[:-1][first[:-1] < first[-1]]] = True
        p, _ = forward_backward(model.emissions(np.concatenate(part), head), head, model.trans, model.start)
        out.append(_logit_any(p, first))
    return np.concatenate(out)


def tag_run(model: Model, run: K.Run) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and spans of a run's rows."""
    w = K.words(run, space_table=APART)
    head = np.zeros(len(w.starts), bool)
    head[w.first[:-1][w.first[:-1] < len(head)]] = True
    p, _ = forward_backward(model.emissions(w.hashes, head), head, model.trans, model.start)
    score = sigmoid(model.slope * _logit_any(p, w.first) + model.offset)
    spans: list[list[dict]] = [[] for _ in range(run.hi - run.lo)]
    hot = np.flatnonzero(p >= 0.5)
    if len(hot):
        fresh = np.ones(len(hot), bool)
        fresh[1:] = (np.diff(hot) > 1) | head[hot[1:]]
        edge = np.append(np.flatnonzero(fresh), len(hot))
        rows = np.searchsorted(w.first, hot[edge[:-1]], "right") - 1
        for a, b, r in zip(edge[:-1], edge[1:], rows, strict=True):
            i, j = hot[a], hot[b - 1]
            at = run.offsets[r]
            spans[r].append({"start": int(w.starts[i] - at), "end": int(w.ends[j] - at), "p": float(p[i : j + 1].max())})
    return score, spans


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, cfg: Config = Config()) -> Model:
    """Fit on at most ``cfg.bound`` labelled rows that ``learn`` admits."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, learn, cfg.bound).mapInArrow(K.tidy(_features), "y int, tokens binary, sketch binary")
    return fit_in_task(sample, lambda rows: fit(rows, cfg))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = Config.threshold) -> DataFrame:
    """All columns of ``docs`` and ``tox_score`` double, ``tox_flag`` boolean and ``tox_spans``.

    Null and empty texts and texts without a token have no spans and the score of a document without toxic tokens.
    Rows are scored one by one, so ties, repeated rows, other columns and empty tables need no care; columns of those
    three names are replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("tox_score", "tox_flag", "tox_spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float32())]))
        for batch in batches:
            scores, spans = [np.zeros(0)], []
            for run in K.runs(batch.column(text)):
                s, x = tag_run(m, run)
                scores.append(s)
                spans += x
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(s), pa.array(s >= threshold), pa.array(spans, kind)],
                [*kept, "tox_score", "tox_flag", "tox_spans"],
            )

    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_flag", T.BooleanType()), T.StructField("tox_spans", T._parse_datatype_string(SPANS))])
    return docs.select(*kept).mapInArrow(K.tidy(apply), schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    from packspan.llm.learning import remainder
    from packspan.runtime import table

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 4) == 2
    model = train(docs, labels, "toxic", ~held)
    # the query needs the numbers only; the text stays in the scan
    return score(docs, model).select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_flag").cast("int").alias("predicted"), F.size("tox_spans").alias("n_spans"), F.transform("tox_spans", lambda x: F.struct(x["start"], x["end"])).alias("spans"))
