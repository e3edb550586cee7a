"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingle sets.

Test items are short, documents may be long, so the measure is containment: the share of an item's k-word shingles that
a document has. Items are partitioned by the size of their sets. A partition with sizes up to u keeps of each item a
bottom-m MinHash sketch, its m smallest shingle hashes, with m = u - ceil(threshold * u) + 1: an item of u shingles of
which a document has the threshold's share lacks at most m - 1 of them, so at least one sketch value is in the document,
however long that is (smaller items of the partition are covered the better). A document is thus a candidate of every
item that it contains, not just with high probability; candidates are verified by counting the item's whole set in the
document's whole set.

Each partition has an index of its own, searched with the hashes of a run of documents that pass a bitmap of all sketches.
Documents pass once for each block of items, without a shuffle. A block holds at most about ``ENTRIES`` shingles, and one
block's index is alive at a time, which bounds memory whatever the size of the benchmark: with several blocks the documents
are numbered and written once, each pass hands on its hits only, and the hits of all passes are joined to the documents at
the end. Items with the same id and text are kept once, with their number.

Very long texts: a task holds a run of texts or one longer text, about 12 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspan.llm import wordkernel as K
from packspan.runtime import Cut, ship, table

ENTRIES = 4_000_000
HITS = "array<struct<item_id:bigint,shared:int,size:int>>"
_FILTER_BITS = 20


@dataclass
class Partition:
    """Items of similar size. sets: flat sorted sets; first: their bounds; key, owner: sketch values and their items."""

    item_ids: np.ndarray
    times: np.ndarray
    sets: np.ndarray
    first: np.ndarray
    key: np.ndarray
    owner: np.ndarray


@dataclass
class Index:
    """Items with k-word shingles for one k, by partitions of their sizes; bitmap: leading bits of all sketch values."""

    k: int
    bitmap: np.ndarray
    partitions: list[Partition]


def size_partition(n: np.ndarray) -> np.ndarray:
    """The upper size of each item's partition: bounds grow by a quarter, and sizes up to 8 stand alone."""
    bounds = [*range(1, 9)]
    while bounds[-1] < max(n, default=1):
        bounds.append(bounds[-1] * 5 // 4)
    bounds = np.array(bounds)
    return bounds[np.searchsorted(bounds, n)]


def sketch_depth(upper: np.ndarray, percent: int) -> np.ndarray:
    return upper - -(-percent * upper // 100) + 1


def build(items: list[tuple[int, int, bytes, int]], percent: int) -> list[Index]:
    """One index for each shingle length; items are (item_id, k, sorted set as bytes, number)."""
    out = []
    for k in sorted({i[1] for i in items}):
        own = sorted((i for i in items if i[1] == k), key=lambda i: (i[0], i[2]))
        sizes = np.array([len(i[2]) // 8 for i in own])
        upper, index = size_partition(sizes), Index(k, np.zeros(1 << _FILTER_BITS, bool), [])
        for u in np.unique(upper):
            part = [own[i] for i in np.flatnonzero(upper == u)]
            sets = [np.frombuffer(i[2], np.uint64) for i in part]
            n = np.array([len(x) for x in sets])
            depth = np.minimum(sketch_depth(np.full(len(n), u), percent), n)
            # hashes are mixed, so that the smallest ones are a MinHash sketch
            key = np.concatenate([x[:m] for x, m in zip(sets, depth, strict=True)])
            order = np.argsort(key, kind="stable")
            index.bitmap[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            owner = np.repeat(np.arange(len(sets)), depth)
            index.partitions.append(Partition(np.array([i[0] for i in part]), np.array([i[3] for i in part]), np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]), key[order], owner[order]))
        out.append(index)
    return out


def _item_sets(k: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets = [], []
            for run in K.runs(batch.column("text")):
                w = K.words(run)
                h, first = K.distinct_by_row(*K.shingles(w, k))
                count = np.diff(w.first)
                for r in range(run.hi - run.lo):
                    sizes.append(int(min(count[r], k)))
                    sets.append(h[first[r] : first[r + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())], ["item_id", "k", "set"])

    return apply


def _hits(indexes: list[Index], run: K.Run, percent: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(run.hi - run.lo)]
    w = K.words(run)
    for x in indexes:
        h, first = K.shingles(w, x.k)
        short = np.repeat(np.diff(w.first) < x.k, np.diff(first))  # a shorter text's whole sequence is no k-word shingle
        maybe = np.flatnonzero(x.bitmap[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & ~short)
        if not len(maybe):
            continue
        row = np.searchsorted(first, maybe, "right") - 1
        text: dict[int, np.ndarray] = {}
        for part in x.partitions:
            lo, hi = np.searchsorted(part.key, h[maybe], "left"), np.searchsorted(part.key, h[maybe], "right")
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            count = hi[found] - lo[found]
            flat = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(int(count.sum()))
            pairs = np.unique(np.stack([np.repeat(row[found], count), part.owner[flat]], 1), axis=0)
            for r, i in pairs.tolist():
                if r not in text:
                    text[r] = np.unique(h[first[r] : first[r + 1]])
                have, want = text[r], part.sets[part.first[i] : part.first[i + 1]]
                shared = int((have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want).sum())
                if 100 * shared >= percent * len(want):
                    out[r] += [{"item_id": int(part.item_ids[i]), "shared": shared, "size": len(want)}] * int(part.times[i])
    for hits in out:
        hits.sort(key=lambda x: (x["item_id"], x["size"], x["shared"]))
    return out


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", k: int = 5, percent: int = 80, entries: int = ENTRIES) -> DataFrame:
    """All columns of ``docs`` and ``bench_hits``: the items (item_id, text) with at least ``percent`` of their shingles in the text.

    A hit has the item's id, how many of its shingles are in the text and how many it has; hits are in order of the
    items' ids. Items of 1 to k - 1 words are one shingle, their whole sequence, looked for at that length. Null and blank
    items and items with a null id match nothing; null and blank texts have no hits. Items with equal texts or ids, and
    repeated items, are each reported. A column ``bench_hits`` of ``docs`` is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c != "bench_hits"]
    hits = T.StructField("bench_hits", T._parse_datatype_string(HITS))
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").mapInArrow(_item_sets(k), "item_id long, k int, set binary").where("k > 0")
    sets = Cut(sets.groupBy("item_id", "k", "set").agg(F.count(F.lit(1)).alias("times")), "item sets")
    total = sets.df.agg(F.sum(F.length("set") / 8)).first()[0] or 0
    blocks = max(1, int(-(-total // entries)))

    def index(b: int):
        part = sets.df.where(F.pmod(F.xxhash64("item_id", "set"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(build([(r.item_id, r.k, bytes(r.set), r.times) for r in part.collect()], percent))

    if blocks == 1:
        return docs.select(*kept).mapInArrow(_marker(index(0), kept, text_col, percent, True), T.StructType([docs.schema[c] for c in kept] + [hits]))
    numbered = Cut(docs.select(*kept).withColumn("_row", F.monotonically_increasing_id()), "numbered").df
    found = None
    for b in range(blocks):
        shared = index(b)
        one = Cut(numbered.select("_row", text_col).mapInArrow(_marker(shared, ["_row"], text_col, percent, False), T.StructType([T.StructField("_row", T.LongType()), hits])), "hits").df
        shared.destroy()  # what the next block needs is its own index
        found = one if found is None else found.union(one)
    # only documents with a hit have a row here
    joined = found.select("_row", F.explode("bench_hits").alias("h")).groupBy("_row").agg(F.array_sort(F.collect_list("h")).alias("bench_hits"))
    return numbered.join(joined, "_row", "left").select(*kept, F.coalesce("bench_hits", F.array().cast(HITS)).alias("bench_hits"))


def _marker(shared, kept: list[str], text_col: str, percent: int, every: bool):
    """Rows with their hits; only rows with one unless ``every``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, kind = shared.value, pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int32()), ("size", pa.int32())]))
        for batch in batches:
            found = [x for run in K.runs(batch.column(text_col)) for x in _hits(indexes, run, percent)]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], [*kept, "bench_hits"])
            yield out if every else out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return K.tidy(apply)


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each document and item that it contains: id, item_id, shared, size."""
    found = mark(docs.select(id_col, options.get("text_col", "text")), items, **options)
    return found.select(id_col, F.explode("bench_hits").alias("h")).select(id_col, "h.item_id", "h.shared", "h.size")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.col("shared").cast("long").alias("shared"), F.col("size").cast("long").alias("item_shingles"), (F.col("shared") / F.col("size")).alias("containment")
    )


ORACLE = r"""
WITH words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL)
), sized AS (SELECT kind, id, w, len(w) AS n FROM words WHERE len(w) > 0),
item AS (SELECT DISTINCT id, least(n, 5) AS k, array_to_string(w[i:i + least(n, 5) - 1], ' ') AS s FROM sized, unnest(range(1, n - least(n, 5) + 2)) AS t(i) WHERE kind = 'b'),
lengths AS (SELECT DISTINCT k FROM item),
doc AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM sized, lengths, unnest(range(1, n - k + 2)) AS t(i) WHERE kind = 'd' AND n >= k),
whole AS (SELECT id, count(*) AS item_shingles FROM item GROUP BY id),
both_sides AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM item i JOIN doc d ON d.k = i.k AND d.s = i.s GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM both_sides JOIN whole ON whole.id = item_id WHERE 100 * shared >= 80 * item_shingles
"""
