"""What the classifiers share: the held-out rule, the bounded labelled sample and score calibration."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspan.llm.wordkernel import tidy


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """At most ``bound`` learnable rows (doc_id, text, y), the same ones whatever the partitioning.

    Labels are drawn by a hash of the id; a document with conflicting labels counts with the larger. Only the drawn
    labels (``bound`` rows of 12 bytes) are broadcast, so the size of both tables doesn't matter. Null ids, labels and
    texts teach nothing. Of rows that share an id the text with the smallest hash counts.
    """
    drawn = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & learn)
    return one_of_each(texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y"))


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of the rows of each ``doc_id`` (few ids, any number of rows) the one whose ``text`` has the smallest hash.

    Rows are reduced within their partition first, so an id with a third of all rows moves one row from each.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        names: list[str] = []
        for batch in batches:
            names = batch.schema.names
            ids, hashes, texts = (batch.column(c) for c in ("doc_id", "_hash", "text"))
            for i, (key, h) in enumerate(zip(ids.to_pylist(), hashes.to_pylist(), strict=True)):
                held = best.get(key)
                if held is None or h < held[0] or h == held[0] and texts[i].as_py() < held[1]:
                    best[key] = (h, texts[i].as_py(), batch.slice(i, 1))
        kept = [held[2] for held in best.values()]
        for lo in range(0, len(kept), 64):
            yield from pa.Table.from_batches(kept[lo : lo + 64]).select(names).combine_chunks().to_batches()

    hashed = rows.withColumn("_hash", F.xxhash64("text"))
    schema = hashed.schema
    return hashed.mapInArrow(tidy(apply), schema).repartition("doc_id").mapInArrow(tidy(apply), schema).select(*rows.columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset so that sigmoid(slope * z + offset) estimates P(y = 1); Newton steps with smoothed targets."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - t) + 1e-3 * w * [1, 0]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def keep_one_of_copies(sketches: np.ndarray) -> np.ndarray:
    """Row numbers of a sample with one row kept of those that share two neighbouring sketch coordinates.

    A label that is wrong for one text is wrong for its copies too; counted once, it can't look like evidence.
    """
    n = len(sketches)
    leader = np.arange(n)
    for c in range(0, sketches.shape[1] - 1, 2):
        key = sketches[:, c] * np.uint64(0x9E3779B97F4A7C15) ^ sketches[:, c + 1]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        leader = np.minimum(leader, first[inverse])
    for _ in range(8):
        leader = leader[leader]
    return np.flatnonzero(leader == np.arange(n))


def fit_in_task(sample: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """``fit`` of the sample's rows, run in one task, so that the driver holds the model only.

    The sample must be bounded, as ``labelled_sample`` is; a lost executor costs another try of that task.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(fit(rows)), 1)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(tidy(apply), "model binary").collect()
    return pickle.loads(zlib.decompress(found[0][0])) if found else fit([])
