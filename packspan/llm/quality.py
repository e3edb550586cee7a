"""Quality classifier: naive Bayes features in a support vector machine.

A document is the set of its n-grams: words and word pairs (lower case), runs of one to three bytes, and runs of one to
three word shapes (case, digits, closing mark, marks inside, same word as before). Each is hashed into one table of
indicators. An indicator counts with the log of the ratio of its smoothed shares in the two classes; document vectors
are brought to length 1, and a linear hinge-loss model is fitted to them by dual coordinate descent. Margins of a fifth
of the sample, which the fit doesn't see, calibrate the score.

Memory: a task holds one run of texts, or a longer text in slices, and the 2^18 weights; one task holds ``Config.bound`` rows of at most 2^18
ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspan.llm import wordkernel as K
from packspan.llm.learning import fit_in_task, labelled_sample, platt, remainder, sigmoid
from packspan.runtime import ship, table

BITS = 18
_MASK = np.uint64((1 << BITS) - 1)
_U = np.uint64
#: What a byte says about the shape of its word: 1 upper case, 2 lower case or not ASCII, 4 digit, 8 other.
_KIND = np.array([1 if 65 <= b < 91 else 2 if 97 <= b < 123 or b >= 128 else 4 if 48 <= b < 58 else 8 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Config:
    bound: int = 6_000  #: labelled documents that the model may learn from
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    threshold: float = 0.3


@dataclass
class Model:
    ratio: np.ndarray  #: log-count ratio of each indicator
    weight: np.ndarray  #: its weight in the fitted model, times the ratio
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.ratio[ids], dtype=np.float64).sum()))
        return self.bias + (float(self.weight[ids].sum(dtype=np.float64)) / length if length else 0.0)


def _shapes(run: K.Run, w: K.Words) -> np.ndarray:
    kinds = _KIND[run.data]
    starts, ends = w.starts, w.ends
    inside = np.bitwise_or.reduceat(kinds, np.stack([starts, ends], 1).ravel()[: 2 * len(starts) - (ends[-1] == len(kinds))])[::2] if len(starts) else np.zeros(0, np.uint8)
    last = run.data[ends - 1]
    closing = np.select([last == 33, last == 46, last == 44, last == 63, _KIND[last] == 8], [1, 2, 3, 4, 5], 0)
    same = np.zeros(len(starts), np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    return (inside.astype(np.int64) + 16 * (kinds[starts] == 1) + 32 * closing + 256 * same + 512 * (ends - starts > 24) + 1).astype(np.uint64)


def _byte_runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    d, n = data.astype(np.uint64), len(data)
    yield K.mix(d + _U(1 << 40)) & _MASK, offsets, 1
    key = d
    for k in (2, 3):
        key = key[: n - k + 1] * _U(257) + d[k - 1 :] if n >= k else np.zeros(0, np.uint64)
        yield K.mix(key + _U(k << 40)) & _MASK, offsets, k


def indicators(run: K.Run) -> Iterator[np.ndarray]:
    """The distinct indicator ids of each row, ascending. Rows without a byte have none."""
    w = K.words(run)
    n, m = len(run.data), len(w.starts)
    seen = np.zeros(1 << BITS, bool)
    streams: list[tuple[np.ndarray, np.ndarray, int]] = []
    if run.hi - run.lo == 1 and n > K.RUN_BYTES:  # a long text's byte runs, in slices that overlap by two bytes
        for lo in range(0, n, K.RUN_BYTES):
            for ids, _, _ in _byte_runs(run.data[lo : lo + K.RUN_BYTES + 2], run.offsets):
                seen[ids.astype(np.int64)] = True
    elif n:
        streams += _byte_runs(run.data, run.offsets)
    if m:
        h = w.hashes
        streams.append((K.mix(h + _U(11)) & _MASK, w.first, 1))
        streams.append((K.mix(h[:-1] * _U(3) + h[1:] + _U(12)) & _MASK, w.first, 2))
        s = _shapes(run, w)
        key = s
        streams.append((K.mix(key + _U(21 << 40)) & _MASK, w.first, 1))
        for k in (2, 3):
            key = key[: m - k + 1] * _U(1021) + s[k - 1 :] if m >= k else np.zeros(0, np.uint64)
            streams.append((K.mix(key + _U((20 + k) << 40)) & _MASK, w.first, k))
    streams = [(x.astype(np.int64), first, k) for x, first, k in streams]
    for r in range(run.hi - run.lo):
        for ids, first, k in streams:
            a, b = first[r], first[r + 1] - k + 1
            if b > a:
                seen[ids[a:b]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [x.astype(np.int32).tobytes() for run in K.runs(batch.column("text")) for x in indicators(run)]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(ids, pa.binary())], ["y", "ids"])


def descend(ids: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, size: int, cost: float, epochs: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge-loss model: one dual variable at a time is set to its optimum.

    Minimises (w.w + b.b) / 2 + cost * sum(max(0, 1 - sign * (w.x + b))); the bias is an input that is always 1.
    """
    rng, w, bias, alpha = np.random.default_rng(11), np.zeros(size), 0.0, np.zeros(len(ids))
    norm = np.array([float(np.square(v, dtype=np.float64).sum()) + 1.0 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(ids)):
            at, v = ids[i], values[i]
            gradient = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias, alpha


def fit(sample: list[tuple[int, bytes]], cfg: Config = Config()) -> Model:
    """Without both classes every score is the smoothed share of label 1."""
    sample = sorted(sample)
    size = 1 << BITS
    y = np.array([r[0] for r in sample], int)
    base = (y.sum() + 1) / (len(y) + 2)
    model = Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, float(np.log(base / (1 - base))))
    if len(y) == 0 or y.min() == y.max():
        return model
    rows = [np.frombuffer(r[1], np.int32) for r in sample]
    order = np.random.default_rng(7).permutation(len(rows))
    part = max(1, len(rows) // 5)
    apart, own = order[:part], order[part:]
    if y[own].min() == y[own].max():
        own = order
    count = np.full((2, size), cfg.smoothing)
    for i in own:
        count[y[i], rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[(count.sum(0) - 2 * cfg.smoothing) < 2] = 0  # seen once: says nothing
    vectors = []
    for i in own:
        v = ratio[rows[i]]
        vectors.append((v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32))
    w, bias, _ = descend([rows[i] for i in own], vectors, np.where(y[own] == 1, 1.0, -1.0), size, cfg.cost, cfg.epochs)
    model.ratio, model.weight, model.bias = ratio.astype(np.float32), (w * ratio).astype(np.float32), float(bias)
    judged = apart if len(set(y[apart])) == 2 else order
    model.slope, model.offset = platt(np.array([model.margin(rows[i]) for i in judged]), y[judged])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, cfg: Config = Config()) -> Model:
    """Fit on at most ``cfg.bound`` labelled rows that ``learn`` admits."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, learn, cfg.bound).mapInArrow(K.tidy(_features), "y int, ids binary")
    return fit_in_task(sample, lambda rows: fit(rows, cfg))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` double, the calibrated chance of label 1.

    Null and empty texts have no indicator and the score of the bias alone. Rows are scored one by one; a column of that
    name is replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != "quality_score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z = np.array([m.margin(ids) for run in K.runs(batch.column(text)) for ids in indicators(run)], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sigmoid(m.slope * z + m.offset))], [*kept, "quality_score"])

    return docs.select(*kept).mapInArrow(K.tidy(apply), T.StructType([docs.schema[c] for c in kept] + [T.StructField("quality_score", T.DoubleType())]))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 5) == 0
    s = F.col("quality_score")
    return score(docs, train(docs, labels, "quality", ~held)).select("doc_id", held.alias("held_out"), s.alias("score"), (s >= Config.threshold).cast("int").alias("predicted"))
