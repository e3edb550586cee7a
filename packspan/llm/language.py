"""Language identification by a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of fixed length, the last filled up with zero bytes. Bytes are embedded,
convolved with filters of several widths, max-pooled over the window and put through a softmax. Windows of a text vote
by their mean log-probability, weighted by the bytes they hold, so every byte of a long text counts. Training is by
Adam on all windows of a bounded sample of labelled texts.

Memory: a task holds the activations of ``RUN_BYTES`` of text, also of a longer text, which is gone through in slices; one
task holds the sample's windows.
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
from packspan.llm.learning import fit_in_task, one_of_each, remainder
from packspan.runtime import ship, table

RUN_BYTES = 1 << 17
UNDETERMINED = "und"
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


@dataclass(frozen=True)
class Config:
    bound: int = 4_000  #: labelled texts that the model may learn from
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8  #: of each width
    dims: int = 8
    epochs: int = 3
    batch: int = 64
    rate: float = 0.01


@dataclass
class Model:
    langs: list[str]
    window: int
    span: int  #: the largest width
    embed: np.ndarray  #: (256, dims)
    kernel: np.ndarray  #: (span * dims, filters); narrower filters have zero rows
    kernel_bias: np.ndarray
    dense: np.ndarray  #: (filters, langs)
    dense_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The bytes' embeddings, ``span`` side by side: (windows * length, span * dims)."""
        n, length = windows.shape
        dims = self.embed.shape[1]
        e = np.zeros((n, length + self.span - 1, dims), np.float32)
        e[:, :length] = self.embed[windows]
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, length, self.span * dims), (s[0], s[1], s[2])).reshape(n * length, self.span * dims)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        z = self.columns(windows) @ self.kernel
        return np.maximum(z.reshape(*windows.shape, -1).max(1) + self.kernel_bias, 0)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.dense + self.dense_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def cut_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a run: bytes (n, length), the row of each and the bytes it holds."""
    sizes = np.diff(offsets)
    per = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[row] + nth * length
    held = np.minimum(length, offsets[row + 1] - start)
    at = start[:, None] + np.arange(length)
    inside = np.arange(length) < held[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(row) else np.zeros((0, length), np.uint8), row, held


def gradients(model: Model, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of windows ``x`` with languages ``y``, and its gradient by each array of the model."""
    n, dims = len(y), model.embed.shape[1]
    cols = model.columns(x)
    z = (cols @ model.kernel).reshape(*x.shape, -1)
    top = z.argmax(1)  # (batch, filters)
    h = np.take_along_axis(z, top[:, None], 1)[:, 0] + model.kernel_bias
    a = np.maximum(h, 0)
    o = a @ model.dense + model.dense_bias
    o = np.exp(o - o.max(1, keepdims=True))
    o /= o.sum(1, keepdims=True)
    loss = float(-np.log(o[np.arange(n), y]).mean())
    o[np.arange(n), y] -= 1
    o /= n
    dh = (o @ model.dense.T) * (h > 0)  # only the largest position of a filter passes its gradient on
    src = cols.reshape(*x.shape, -1)[np.arange(n)[:, None], top]  # (batch, filters, model.span * dims)
    grad = {"dense": a.T @ o, "dense_bias": o.sum(0), "kernel_bias": dh.sum(0), "kernel": np.einsum("bfk,bf->kf", src, dh) * mask}
    de = (dh[:, :, None] * model.kernel.T[None]).reshape(n, -1, model.span, dims)
    at = top[:, :, None] + np.arange(model.span)
    inside = at < model.window
    letters = np.take_along_axis(x, np.minimum(at, model.window - 1).reshape(n, -1), 1).reshape(at.shape)
    g = np.zeros_like(model.embed)
    np.add.at(g, letters[inside], de[inside])
    grad["embed"] = g
    return loss, grad


def fit(windows: np.ndarray, y: np.ndarray, langs: list[str], cfg: Config = Config()) -> Model:
    rng = np.random.default_rng(3)
    span, total = max(cfg.widths), cfg.filters * len(cfg.widths)
    mask = np.zeros((span, cfg.dims, total), np.float32)
    for i, width in enumerate(cfg.widths):
        mask[:width, :, i * cfg.filters : (i + 1) * cfg.filters] = 1
    mask = mask.reshape(span * cfg.dims, total)
    p = {
        "embed": rng.normal(0, 0.5, (256, cfg.dims)),
        "kernel": rng.normal(0, 0.3, (span * cfg.dims, total)) * mask,
        "kernel_bias": np.zeros(total),
        "dense": rng.normal(0, 0.1, (total, len(langs))),
        "dense_bias": np.zeros(len(langs)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(cfg.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), cfg.batch):
            pick = order[lo : lo + cfg.batch]
            x, t = windows[pick], t + 1
            model = Model(langs, cfg.window, span, **p)
            grad = gradients(model, x, y[pick], mask)[1]
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                p[k] = (p[k] - cfg.rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(langs, cfg.window, span, **p)


def _sampled(cfg: Config):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            out_l, out_w = [], []
            for run in K.runs(batch.column("text"), RUN_BYTES):
                x, row, held = cut_windows(run.data, run.offsets, cfg.window)
                for r in range(run.hi - run.lo):
                    mine = np.flatnonzero(row == r)
                    mine = mine[held[mine] >= min(32, held[mine].max(initial=0))]
                    out_l += [langs[run.lo + r]] * len(mine)
                    out_w += [x[i].tobytes() for i in mine]
            yield pa.RecordBatch.from_arrays([pa.array(out_l, pa.string()), pa.array(out_w, pa.binary())], ["lang", "window"])

    return windows


def train(docs: DataFrame, learn: Column, cfg: Config = Config()) -> Model | None:
    """Fit on windows of at most ``cfg.bound`` texts with a language that ``learn`` admits; None if there are none."""
    ship(docs.sparkSession)
    known = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn
    drawn = docs.select("doc_id", "lang").where(known).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.bound)
    sample = docs.select("doc_id", "lang", "text").where(known & F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    sample = one_of_each(sample)
    return fit_in_task(sample.select("lang", "text").mapInArrow(K.tidy(_sampled(cfg)), "lang string, window binary"), lambda rows: fit_rows(rows, cfg))


def fit_rows(rows: list[tuple[str, bytes]], cfg: Config = Config()) -> Model | None:
    if not rows:
        return None
    rows = sorted(rows)
    langs = sorted({r[0] for r in rows})
    y = np.array([langs.index(r[0]) for r in rows])
    return fit(np.stack([np.frombuffer(r[1], np.uint8) for r in rows]), y, langs, cfg)


def _letters(run: K.Run) -> np.ndarray:
    """Which rows have a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_LETTER[run.data])])
    out = seen[run.offsets[1:]] > seen[run.offsets[:-1]]
    for r in np.flatnonzero(~out):
        text = run.data[run.offsets[r] : run.offsets[r + 1]]
        out[r] = bool((text >= 128).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))
    return out


def identify_run(model: Model, run: K.Run) -> tuple[np.ndarray, np.ndarray]:
    """The best language's index and probability of each row, -1 and 0 for rows without a letter."""
    n = run.hi - run.lo
    votes = np.zeros((n, len(model.langs)))
    step = RUN_BYTES // model.window * model.window
    if n == 1 and len(run.data) > step:  # windows begin at multiples of their length
        slices = [(run.data[lo : lo + step], np.array([0, min(step, len(run.data) - lo)])) for lo in range(0, len(run.data), step)]
    else:
        slices = [(run.data, run.offsets)]
    for data, offsets in slices:
        x, row, held = cut_windows(data, offsets, model.window)
        if len(row):
            np.add.at(votes, row, model.log_probs(x) * held[:, None])
    mean = votes / np.maximum(np.diff(run.offsets), 1)[:, None]
    prob = np.exp(mean - mean.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    best = prob.argmax(1)
    has = _letters(run)
    return np.where(has, best, -1), np.where(has, prob[np.arange(n), best], 0.0)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred`` string and ``lang_score`` double (0 to 1).

    Null texts, texts without a letter, and all texts if nothing could be learned, are ``und`` with score 0. Rows are
    judged one by one; columns of those names are replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, probs = [], [np.zeros(0)]
            for run in K.runs(batch.column(text), RUN_BYTES):
                best, prob = identify_run(m, run) if m is not None else (np.full(run.hi - run.lo, -1), np.zeros(run.hi - run.lo))
                names += [UNDETERMINED if b < 0 else m.langs[b] for b in best]
                probs.append(prob)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(np.concatenate(probs))], [*kept, "lang_pred", "lang_score"])

    return docs.select(*kept).mapInArrow(K.tidy(apply), T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 5) == 0
    return identify(docs.select("doc_id", "text"), train(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
