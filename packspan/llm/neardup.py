"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is its set of distinct k-word shingles. Sketches of t coordinates are filled in rounds: in each of the first t
rounds every shingle is hashed to a bin and a value, in each of the next t rounds every shingle goes to one given bin, and
a bin keeps its smallest value with the round as its leading part. Every coordinate is so filled within 2t rounds, after
about t log t hash values, and coordinates of two sets agree with the probability of their Jaccard similarity.

1. Documents with equal sets form a class with its smallest id; only classes are compared.
2. Bands of coordinates are bucketed. A bucket's classes are linked to its smallest one, after the exact test on whole sets.
3. Components of these links are found. Where a bucket still holds several components, its pairs that cross them are
   compared by sketch (of buckets with the same members one is taken), in blocks of ``BLOCK`` classes against ``BLOCK``. Close pairs join classes into suspect groups; a block
   hands on a spanning forest of them, never all its pairs.
4. Each suspect's whole set is shipped once, to its group, where all pairs that cross components are tested exactly. A
   group of more than ``BLOCK_SHINGLES`` is split and its parts meet pairwise. Again forests leave, not pairs.
5. Components of all links label all members of the classes.

A pair at the threshold is missed if it shares no band, or if its sketches agree in fewer coordinates than the cut. The band
width and the cut are the sharpest whose chances (binomial, by the coordinates' agreement) add up to at most ``MISS``; more
similar pairs are missed less. Sketches never decide that a pair is a link. ``audit`` measures recall against brute force.

Very long texts: a task holds a run of texts (``wordkernel.RUN_BYTES``) or one longer text, and that text's whole set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspan.llm import lookup
from packspan.llm import wordkernel as K
from packspan.llm.components import components
from packspan.runtime import Cut, ship, table

COORDINATES = 240
MISS = 1e-8
BLOCK = 2048  #: classes a side whose sketches a task compares
BLOCK_SHINGLES = 1 << 18  #: shingles a side, about, that a task compares exactly
#: A table of classes or buckets with at most so many rows (24 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = lookup.BROADCAST_ROWS
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def band_rows(percent: int, t: int = COORDINATES, miss: float = MISS) -> int:
    theta = percent / 100
    return max((r for r in range(1, t + 1) if t % r == 0 and (1 - theta**r) ** (t // r) <= miss), default=1)


def least_agreement(percent: int, t: int = COORDINATES, miss: float = MISS) -> int:
    """Most coordinates that a pair at the threshold agrees in, but for what ``miss`` leaves beside the bands' misses."""
    theta, r = percent / 100, band_rows(percent, t, miss)
    room = miss - (1 - theta**r) ** (t // r)
    below, k = 0.0, 0
    while k <= t:
        below += math.exp(math.lgamma(t + 1) - math.lgamma(k + 1) - math.lgamma(t - k + 1) + k * math.log(theta) + (t - k) * math.log1p(-theta)) if theta < 1 else float(k == t)
        if below > room:
            break
        k += 1
    return k


def fast_sketches(h: np.ndarray, first: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Sketches (rows, t) of the sets h[first[k]:first[k + 1]]; rows of empty sets are left at the largest value."""
    n = len(first) - 1
    out = np.full((n, t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n), np.diff(first))
    low = _U(0xFFFFFFFF)
    for i in range(2 * t):
        if not len(h):
            break
        g = K.mix(h + _U((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        at = row * t + (((g >> _U(32)) * _U(t)) >> _U(32)).astype(np.int64) if i < t else row * t + (i - t)
        value = (_U(i) << _U(32)) | (g & low)
        if i:  # what an earlier round has filled is smaller
            free = flat[at] == _EMPTY
            at, value = at[free], value[free]
        np.minimum.at(flat, at, value)
        if i % 4 == 3 or i < 3 or i >= t:
            open_ = (out == _EMPTY).any(1)
            keep = open_[row]
            if not keep.all():
                h, row = h[keep], row[keep]
    return out


def _sets(column: pa.Array, k: int) -> Iterator[tuple[K.Run, np.ndarray, np.ndarray]]:
    for run in K.runs(column):
        yield run, *K.distinct_by_row(*K.shingles(K.words(run), k))


def _fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell a set, whatever its order."""
    out = []
    for salt in (1, 2):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(h ^ _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))])
        out.append((s[first[1:]] - s[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _features(k: int, rows: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for run, h, first in _sets(batch.column("text"), k):
                f1, f2 = _fingerprints(h, first)
                n = np.diff(first)
                s = fast_sketches(h, first)
                keys = np.zeros((len(n), COORDINATES // rows), np.uint64)
                for b in range(keys.shape[1]):
                    key = np.full(len(n), _U(b + 1))
                    for j in range(b * rows, (b + 1) * rows):
                        key = K.mix(key * _U(0x9E3779B97F4A7C15) + s[:, j])
                    keys[:, b] = key
                offsets = pa.array(np.arange(len(n) + 1) * keys.shape[1], pa.int32())
                tiny = K.mix(s).astype(np.uint8)
                none = pa.array(n == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(run.lo, run.hi - run.lo),
                        pa.array(n.astype(np.int64)),
                        pa.array(f1, mask=n == 0),
                        pa.array(f2, mask=n == 0),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)), mask=none),
                        pa.array([x.tobytes() for x in tiny], pa.binary()),
                    ],
                    ["id", "n", "f1", "f2", "bands", "sketch"],
                )

    return apply


def _whole_sets(k: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, h, first in _sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(run.lo, run.hi - run.lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))], ["id", "set"]
                )

    return apply


def _shape(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")


def _sets_of(base: DataFrame, ids: DataFrame, k: int) -> Cut:
    """Whole sets of the documents named; repeated rows of an id count once."""
    named = Cut(ids.distinct(), "named")
    sets = lookup.semi(base, named.df, "id", BROADCAST_ROWS).mapInArrow(K.tidy(_whole_sets(k)), "id long, set array<long>")
    out = Cut(sets, "sets")
    named.drop()
    return out


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one, two = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _agreement(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal bytes of rows of 64-bit words."""
    low = _U(0x7F7F7F7F7F7F7F7F)
    x = one ^ two
    return np.bitwise_count(~(((x & low) + low) | x | low)).sum(-1, dtype=np.int64)


def _packed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _likely(percent: int):
    """Pairs whose sketches are close enough for the exact test."""
    least = least_agreement(percent)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_agreement(_packed(batch.column("sa")), _packed(batch.column("sb"))) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return apply


class _Forest:
    """Union-find that tells whether a link joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _suspects(percent: int):
    """A spanning forest of the pairs of queries (role 1) and all (role 0) of other components that are close by sketch."""
    least = least_agreement(percent)

    def apply(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rep, comp, role = (t[c].to_numpy() for c in ("rep", "comp", "role"))
        sketch = _packed(t["sketch"])
        d, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        theirs, forest, out = sketch[d], _Forest(), []
        for at in range(0, len(q), 4):
            mine = q[at : at + 4]
            near = (_agreement(sketch[mine][:, None], theirs[None]) >= least) & (comp[mine][:, None] != comp[d][None])
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = int(rep[mine[i]]), int(rep[d[j]])
                if forest.link(a, b):
                    out.append((a, b))
        return _links(out)

    return apply


def _confirm(percent: int):
    """A spanning forest of a cell's verified links that cross components; part 0 meets part 1, or itself alone."""

    def apply(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep").combine_chunks()
        rep, comp, part = (t[c].to_numpy() for c in ("rep", "comp", "part"))
        sets = t["set"].combine_chunks()
        n = np.diff(sets.offsets.to_numpy())
        _, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(n)])
        row, marked = np.repeat(np.arange(len(n)), n), np.zeros(int(flat.max(initial=-1)) + 1, bool)
        other = 1 if part.max(initial=0) else 0
        able = part == other
        forest, out = _Forest(), []
        for q in np.flatnonzero(part == 0):
            d = able & (comp != comp[q]) & (100 * np.minimum(n, n[q]) >= percent * np.maximum(n, n[q]))
            if not other:
                d[: q + 1] = False
            if not d.any():
                continue
            mine = flat[first[q] : first[q + 1]]
            marked[mine] = True
            hit = marked[flat] & d[row]
            both = np.bincount(row[hit], minlength=len(n))
            marked[mine] = False
            for j in np.flatnonzero(d & (100 * both >= percent * (n + n[q] - both))):
                if forest.link(int(comp[q]), int(comp[j])):
                    out.append((int(rep[q]), int(rep[j])))
        return _links(out)

    return apply


def _bounded(df: DataFrame) -> DataFrame:
    """The written table ``df``, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links) and kept (id = component_id).

    Documents with 100 * |A and B| >= percent * |A or B| are linked. Null, empty and blank texts have no shingle, are
    linked with nothing and kept. Rows with a null id aren't compared: component_id is null and kept true. Rows that
    share an id count as one document for links. Only id and text are used, whatever other columns there are.
    """
    spark = docs.sparkSession
    ship(spark)
    base = _shape(docs, id_col, text_col)
    rows = band_rows(percent)
    feats = Cut(base.mapInArrow(K.tidy(_features(k, rows)), "id long, n long, f1 long, f2 long, bands array<long>, sketch binary"), "features")
    classes = Cut(
        feats.df.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("f1", "f2", "rep"),
        "classes",
    )
    # only classes with copies are looked up; every other document is its class
    known = feats.df.where("n > 0").join(_bounded(classes.df), ["f1", "f2"], "left").where("rep is null or rep = id")
    reps = known.select(F.col("id").alias("rep"), "bands", "sketch")
    members = reps.select("rep", F.explode("bands").alias("key"))
    buckets = Cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi"), "buckets")
    crowded = Cut(buckets.df.where("size > 2").select("key", F.col("lo").alias("b")), "pivots")
    shared = Cut(members.join(_bounded(crowded.df), "key").select("key", "rep", "b"), "crowded")
    pairs = buckets.df.where("size = 2").select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(shared.df.where("rep <> b").select(F.col("rep").alias("a"), "b")).distinct()
    sketches = reps.select("rep", "sketch")
    both = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = Cut(both.mapInArrow(K.tidy(_likely(percent)), "a long, b long"), "pairs")
    ids = pairs.df.select(F.col("a").alias("id")).union(pairs.df.select(F.col("b").alias("id")))
    sets = _sets_of(base, ids, k)
    links = Cut(_verify(pairs.df, sets.df, percent), "verified")
    found = components(links.df)
    rest = _crossing(shared.df.select("key", "rep"), sketches, found.df, base, k, percent)
    if rest is not None:
        found.drop()
        found = components(links.df.union(rest.df))
    # what a class's members are labelled with: its own smallest id, or what that is linked to
    linked = known.select(F.col("id").alias("node"), "f1", "f2").join(found.df.where("component <> node"), "node").select("f1", "f2", "component")
    alone = classes.df.join(found.df.where("component <> node").select(F.col("node").alias("rep")), "rep", "left_anti").select("f1", "f2", F.col("rep").alias("component"))
    label = Cut(linked.union(alone), "labels")
    out = feats.df.select("id", "n", "f1", "f2").join(label.df, ["f1", "f2"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    out = out.withColumn("kept", F.col(id_col) == F.col("component_id"))
    for c in (buckets, crowded, shared, pairs, sets, links, found, classes):
        c.drop()
    if docs.schema[id_col].nullable:
        nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        counted = nameless.mapInArrow(K.tidy(_features(k, rows)), "id long, n long, f1 long, f2 long, bands array<long>, sketch binary")
        out = out.union(counted.select("id", "n", F.lit(None).cast("long"), F.lit(True)))
    return out


def _crossing(shared: DataFrame, sketches: DataFrame, found: DataFrame, base: DataFrame, k: int, percent: int) -> Cut | None:
    """Verified links between components that share a bucket; None if there are none to test."""
    placed = Cut(shared.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")), "placed")
    spread = F.xxhash64("rep")
    per = placed.df.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(spread).alias("x"), F.try_sum(F.shiftrightunsigned(spread, 24)).alias("s"))
    mixed = per.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("main"), F.bit_xor("x").alias("x"), F.try_sum("s").alias("s")).where("comps > 1")
    mixed = mixed.groupBy("comps", "size", "main", "x", "s").agg(F.min("key").alias("key"))  # of buckets with the same members one stays
    mixed = Cut(mixed.select("key", F.col("main.comp").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("all_blocks"), F.ceil((F.col("size") - F.col("main.c")) / BLOCK).cast("int").alias("query_blocks")), "mixed")
    rows = placed.df.join(_bounded(mixed.df), "key")
    every = rows.select("key", "rep", "comp", F.lit(0).alias("role"), F.pmod(spread, F.col("all_blocks")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("y"))
    asked = rows.where("comp <> main").select("key", "rep", "comp", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("x"), F.pmod(spread, F.col("query_blocks")).cast("int").alias("y"))
    blocks = every.union(asked).join(sketches, "rep")
    suspects = Cut(blocks.groupBy("key", "x", "y").applyInArrow(_suspects(percent), "a long, b long").distinct(), "suspects")
    out = None
    if not suspects.df.isEmpty():
        grouped = components(suspects.df)
        sets = _sets_of(base, grouped.df.select(F.col("node").alias("id")), k)
        comps = placed.df.select(F.col("rep").alias("node"), "comp").distinct()
        where = Cut(grouped.df.join(comps, "node").join(sets.df.select(F.col("id").alias("node"), F.size("set").alias("n")), "node"), "suspect groups")
        parts = where.df.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
        # a suspect goes to the cells of its part with every part of its group: to one cell, but in a large group
        at = where.df.join(parts, "component").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = at.select("component", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.col("node").alias("id"), "comp", F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("part"))
        tested = cells.join(sets.df, "id").withColumnRenamed("id", "rep")
        out = Cut(tested.groupBy("component", "x", "y").applyInArrow(_confirm(percent), "a long, b long").distinct(), "crossing")
        for c in (grouped, sets, where):
            c.drop()
    for c in (suspects, placed, mixed):
        c.drop()
    return out


def audit(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, sample: int = 200) -> tuple[int, int]:
    """Links of ``sample`` documents with all others by brute force, and how many of them ``found`` has in one component.

    The sample is the ids with the smallest hashes that are in a component of several documents, or in none if there are
    fewer; its sets (``sample`` rows) go to every task.
    """
    ship(docs.sparkSession)
    base = _shape(docs, id_col, text_col)
    comp = found.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "component_id")
    several = comp.groupBy("component_id").agg(F.count(F.lit(1)).alias("c"))
    drawn = comp.join(several, "component_id").orderBy(F.col("c") > 1, F.xxhash64("id"), ascending=[False, True]).limit(sample).select("id", "component_id")
    chosen = [(r.id, r.component_id, np.array(r.set, np.int64)) for r in base.join(F.broadcast(drawn.select("id")), "id", "left_semi").mapInArrow(K.tidy(_whole_sets(k)), "id long, set array<long>").join(F.broadcast(drawn), "id").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        words, flat = np.unique(np.concatenate([a[2] for a in asked] or [np.zeros(0, np.int64)]), return_inverse=True)
        first = np.concatenate([[0], np.cumsum([len(a[2]) for a in asked])])
        for batch in batches:
            for run, h, starts in _sets(batch.column("text"), k):
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                known = words[at] == h if len(words) else np.zeros(len(h), bool)
                out = []
                for r in range(run.hi - run.lo):
                    mine, n = at[starts[r] : starts[r + 1]][known[starts[r] : starts[r + 1]]], int(starts[r + 1] - starts[r])
                    if not len(mine):
                        continue
                    has = np.zeros(len(words), bool)
                    has[mine] = True
                    both = np.diff(np.concatenate([[0], np.cumsum(has[flat])])[first])
                    for j in np.flatnonzero(100 * both >= percent * (np.diff(first) + n - both)):
                        out.append((batch.column("id")[run.lo + r].as_py(), asked[j][0], asked[j][1]))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["id", "asked", "want"])

    links = base.mapInArrow(apply, "id long, asked long, want long").where("id <> asked")
    got = links.join(comp, "id").agg(F.count(F.lit(1)), F.count_if(F.col("component_id") == F.col("want"))).first()
    return int(got[0]), int(got[1])


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
