"""Near-duplicate vectors by NN-descent, with audited recall and exact counts.

Vectors are compared within their label only. Equal vectors of a label form a class, and classes are the nodes.

1. A first neighbour graph: classes of a label are put into small blocks by signs of random hyperplanes, several times
   anew, and each keeps its ``k`` nearest neighbours of these blocks.
2. NN-descent: around every node whose neighbourhood has news, its neighbours and those it is a neighbour of are compared
   with each other (neighbours of neighbours), and nearer ones replace the farthest of a list, until few lists change.
3. A list whose last neighbour still reaches the threshold is saturated: its node may have more links than the list holds.
   Such lists are enlarged to the whole label: the node is compared with all classes of its label, in blocks. Blocks hand
   on counts, a spanning forest of their links and the links to nodes with open lists (fewer than ``k`` each), never all
   pairs of a group.
4. Links are confirmed in double precision. Recall is measured against brute force for ``audit`` nodes, or more until
   these have ``AUDIT_LINKS`` links; below ``recall`` the search is repeated with other planes and lists twice as long. If
   that doesn't help, or the audit sees no link at all, every list is enlarged to the whole label, as saturated ones are.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspan.llm import wordkernel as K
from packspan.llm.components import components
from packspan.runtime import Cut, cut, ship, table

ROUNDS = 6  #: of hyperplane cells, at least
MAX_ROUNDS = 64
MAX_BITS = 20
CELL_MISS = 0.05  #: chance that a pair at the threshold shares no cell, below MAX_ROUNDS
AUDIT_LINKS = 50  #: links that an audit must see, unless it has grown to AUDIT_GROWTH times its nodes
AUDIT_GROWTH = 16
BLOCK_NODES = 96
SEARCH_BLOCK = 1024
BROADCAST_ROWS = 500_000
_log = logging.getLogger(__name__)


def _planes(dim: int, seed: int, rounds: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, 24 * rounds))


def _rounds(bits: int, threshold: float) -> int:
    """Rounds of cells of so many bits after which a pair at the threshold has met but for ``CELL_MISS``."""
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return max(ROUNDS, MAX_ROUNDS if meet <= 1e-9 else min(MAX_ROUNDS, math.ceil(math.log(CELL_MISS) / math.log1p(-min(meet, 1 - 1e-9)))))


def _bits(n: int) -> int:
    return max(0, min(MAX_BITS, math.ceil(math.log2(max(n, 1) / BLOCK_NODES))))


def _prepared(seed: int, rounds: int):
    """Unit vectors of the valid rows, what tells equal ones, and their hyperplane signs."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == dim)
                x = flat[first[rows][:, None] + np.arange(dim)]
                finite = np.isfinite(x).all(1)
                top = np.where(finite, np.abs(np.where(np.isfinite(x), x, 0)).max(1), 0)
                good = top > 0
                rows, x = rows[good], x[good]
                if not len(rows):
                    continue
                y = x / top[good][:, None]  # no overflow or underflow in the norm
                unit = y / np.sqrt((y * y).sum(1))[:, None]
                h = np.zeros((2, len(rows)), np.uint64)
                for j in range(dim):
                    for s in (0, 1):
                        h[s] = K.mix(h[s] * np.uint64(0x9E3779B97F4A7C15) + x[:, j].view(np.uint64) + np.uint64(s + 1))
                sign = ((unit @ _planes(int(dim), seed, rounds)) > 0).reshape(len(rows), rounds, 24)
                sig = (sign * (1 << np.arange(24))).sum(2).astype(np.int64)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take),
                        batch.column("label").take(take),
                        pa.array(np.full(len(rows), dim, np.int32)),
                        pa.array(h[0].view(np.int64)),
                        pa.array(h[1].view(np.int64)),
                        pa.array([u.tobytes() for u in unit], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rounds, pa.int32()), pa.array(sig.reshape(-1))),
                    ],
                    ["id", "label", "dim", "h1", "h2", "unit", "sigs"],
                )

    return apply


def _streamed(df: DataFrame, key: str, work: Callable[[pa.Table], list[tuple]], schema: str, kinds: list) -> DataFrame:
    """``work`` on all rows of each value of the long column ``key``, in sorted streams."""

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        names = [f.split(" ")[0] for f in schema.split(", ")]

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            k = t[key].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.array([0])
            out: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                out.append(work(t.slice(a, b - a)))
            out = [o for o in out if o is not None and len(o[0])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            k = t[key].to_numpy()
            if not len(k):
                continue
            at = int(np.searchsorted(k, k[-1], "left"))
            if at:
                yield from done(t.slice(0, at))
            rest = t.slice(at)
        if rest is not None:
            yield from done(rest)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(groups, schema)


def _matrix(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t[column].to_pylist()), kind).reshape(t.num_rows, -1)


_EDGES = "u long, v long, sim float"
_EDGE_KINDS = [pa.int64(), pa.int64(), pa.float32()]


def _nearest_of_block(k: int):
    """The k nearest of each node among a block's nodes of its own group."""

    def work(t: pa.Table):
        node, group = t["node"].to_numpy(), t["grp"].to_numpy()
        if len(node) < 2:
            return None
        x = _matrix(t, "vec", np.float32)
        s = x @ x.T
        s[(group[:, None] != group[None]) | (node[:, None] == node[None])] = -2
        m = min(k, len(node) - 1)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sim = np.take_along_axis(s, top, 1).ravel()
        ok = sim > -2
        return np.repeat(node, m)[ok], node[top].ravel()[ok], sim[ok]

    return work


def _local_join(k: int):
    """Pairs of a neighbourhood, at least one of them new to it, that are nearer than the farthest of a list."""

    def work(t: pa.Table):
        node, new, last = t["node"].to_numpy(), t["fresh"].to_numpy(), t["last"].to_numpy()
        if len(node) < 2 or not new.any():
            return None
        x = _matrix(t, "vec", np.float32)
        s = x @ x.T
        news = (new[:, None] | new[None]) > 0
        a, b = np.nonzero(news & (s > last[:, None]) & (node[:, None] != node[None]))
        return node[a], node[b], s[a, b]

    return work


def _kept(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list; fresh tells entries that no earlier list had."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return one.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def neighbour_graph(nodes: DataFrame, k: int, threshold: float = 0.93, max_passes: int = 8, settled: float = 0.002) -> Cut:
    """Lists (u, v, sim) of about the k nearest nodes of the same grp; nodes has node, grp, vec and sigs."""
    count = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(MAX_BITS), F.ceil(F.log2(F.col("n") / BLOCK_NODES)))).cast("int")
    signed = nodes.join(_small(cut(count.select("grp", bits.alias("bits")), "labels")), "grp")
    rounds = F.element_at(F.array(*[F.lit(_rounds(b, threshold)) for b in range(MAX_BITS + 1)]), F.col("bits") + 1)
    signed = signed.select("node", "grp", "vec", "bits", F.posexplode(F.slice("sigs", F.lit(1), rounds)).alias("round", "sig"))
    signed = signed.withColumn("cell", F.xxhash64("grp", "round", F.expr("sig % shiftleft(1L, bits)")))
    sizes = Cut(signed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(f"c > {2 * BLOCK_NODES}").select("cell", F.ceil(F.col("c") / BLOCK_NODES).cast("int").alias("parts")), "cells")
    signed = signed.join(_small(sizes.df), "cell", "left")
    signed = signed.select("node", "grp", "vec", F.xxhash64("cell", F.pmod(F.xxhash64("node", "round"), F.coalesce("parts", F.lit(1)))).alias("block"))
    first = _streamed(signed, "block", _nearest_of_block(k), _EDGES, _EDGE_KINDS)
    graph = Cut(_kept(first.withColumn("fresh", F.lit(1)), k), "graph")
    total = graph.df.count()
    for _ in range(max_passes):
        e = graph.df
        # a node that is in many lists takes part in a hashed share of the neighbourhoods that it is in
        into = Cut(e.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(f"c > {2 * k}"), "hubs")
        share = e.join(_small(into.df), "v", "left").where(f"c is null or pmod(xxhash64(u, v, fresh), c) < {2 * k}")
        around = e.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "fresh").union(share.select(F.col("v").alias("pivot"), F.col("u").alias("node"), "fresh"))
        around = around.groupBy("pivot", "node").agg(F.max("fresh").alias("fresh"))
        last = e.groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.min("sim").alias("m")).select(F.col("u").alias("node"), F.when(F.col("c") >= k, F.col("m")).otherwise(F.lit(-2.0)).cast("float").alias("last"))
        info = Cut(nodes.select("node", "vec").join(last, "node"), "lists")
        found = _streamed(around.join(info.df, "node"), "pivot", _local_join(k), _EDGES, _EDGE_KINDS)
        best = Cut(found.groupBy("u", "v").agg(F.max("sim").alias("sim")), "found")
        old = graph
        graph = Cut(_kept(e.withColumn("fresh", F.lit(0)).union(best.df.select("u", "v", "sim", F.lit(1).alias("fresh"))), k), "graph")
        changed = graph.df.where("fresh = 1").count()
        for c in (old, info, into, best):
            c.drop()
        if changed <= settled * total:
            break
    sizes.drop()
    return graph


def _confirmed(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose cosine in double precision reaches the threshold."""
    two = pairs.join(nodes.select(F.col("node").alias("u"), F.col("unit").alias("x")), "u").join(nodes.select(F.col("node").alias("v"), F.col("unit").alias("y")), "v")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            xs, ys = t["x"].to_pylist(), t["y"].to_pylist()
            keep = pa.array([len(a) == len(b) and float(np.frombuffer(a) @ np.frombuffer(b)) >= threshold for a, b in zip(xs, ys, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return two.mapInArrow(apply, "u long, v long")


def _whole_label(threshold: float):
    """Of a block of queries (role 1) against classes (role 0): links of each query, a spanning forest, links to open lists."""

    def apply(t: pa.Table) -> pa.Table:
        t = t.sort_by([("role", "ascending"), ("node", "ascending")]).combine_chunks()
        role, node, copies, full = (t[c].to_numpy() for c in ("role", "node", "copies", "full"))
        x = _matrix(t, "unit", np.float64)
        q, d = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        out: list[tuple] = []
        parent: dict[int, int] = {}

        def top(i: int) -> int:
            while parent.get(i, i) != i:
                parent[i] = i = parent.get(parent[i], parent[i])
            return i

        for lo in range(0, len(q), 128):
            mine = q[lo : lo + 128]
            link = (x[mine] @ x[d].T >= threshold) & (node[mine][:, None] != node[d][None])
            total = link @ copies[d]
            for i, row in enumerate(link):
                a = int(node[mine[i]])
                if not row.any():
                    continue
                out.append((a, None, int(total[i])))
                hit = d[row]
                for j in hit[full[hit] == 0]:
                    out.append((a, int(node[j]), None))
                for j in hit[full[hit] == 1]:
                    r, s = top(a), top(int(node[j]))
                    if r != s:
                        parent[max(r, s)] = min(r, s)
                        out.append((a, int(node[j]), None))
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"u": pa.array(cols[0], pa.int64()), "v": pa.array(cols[1], pa.int64()), "links": pa.array(cols[2], pa.int64())})

    return apply


def _enlarged(nodes: DataFrame, saturated: DataFrame, threshold: float) -> Cut:
    """Rows (u, v, links) of ``_whole_label`` for all saturated nodes."""
    full = nodes.select("node", "grp", "copies", "unit").join(saturated.select(F.col("u").alias("node"), F.lit(1).alias("full")), "node", "left").fillna(0, ["full"])
    full = Cut(full, "full")
    per = full.df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("s")).where("s > 0")
    per = cut(per.select("grp", F.ceil(F.col("n") / SEARCH_BLOCK).cast("long").alias("nd"), F.ceil(F.col("s") / SEARCH_BLOCK).cast("long").alias("nq")), "blocks")
    rows = full.df.join(_small(per), "grp").withColumn("h", F.xxhash64("node"))
    data = rows.select("grp", "node", "copies", "unit", "full", F.lit(0).alias("role"), F.pmod("h", F.col("nd")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("y"))
    asked = rows.where("full = 1").select("grp", "node", "copies", "unit", "full", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nd") - 1)).alias("x"), F.pmod("h", F.col("nq")).alias("y"))
    out = Cut(data.union(asked).groupBy("grp", "x", "y").applyInArrow(_whole_label(threshold), "u long, v long, links long"), "enlarged")
    full.drop()
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.93, k: int = 12, audit: int = 200, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 5) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept.

    Rows whose label is null, or whose vector is null, empty, zero or holds a null or non-finite component, link with
    nothing and are kept; so are vectors of unlike length. A null id has a null component and is kept. Rows that share an
    id count as one node of the graph. Other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    good = base.where("id is not null and label is not null and v is not null")
    made = "id long, label string, dim int, h1 long, h2 long, unit binary, sigs array<long>"

    largest = good.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    rounds = _rounds(_bits(largest), threshold)

    def prepared(s: int) -> DataFrame:
        return good.mapInArrow(_prepared(s, rounds), made)

    rows = Cut(prepared(seed).select("id", F.xxhash64("label", "dim").alias("grp"), "h1", "h2", "unit", "sigs"), "vectors")
    classes = rows.df.groupBy("grp", "h1", "h2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"), F.first("sigs").alias("sigs"))
    single = F.pandas_udf(_as_float32, "binary")
    nodes = Cut(classes.select("node", "grp", "h1", "h2", "copies", "unit", "sigs", single("unit").alias("vec")), "nodes")
    pairs, width, planes = None, k, nodes.df
    for attempt in range(3):
        graph = neighbour_graph(planes, width, threshold)
        near = graph.df.where(F.col("sim") >= threshold - 1e-3)
        linked = _confirmed(near.select("u", "v"), nodes.df, threshold)
        both = linked.union(linked.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = Cut((both if pairs is None else both.union(pairs.df)).distinct(), "links")
        full = graph.df.groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.min("sim").alias("m")).where((F.col("c") >= width) & (F.col("m") >= threshold - 1e-3)).select("u")
        saturated = Cut(full, "saturated")
        graph.drop()
        judged = nodes.df.join(saturated.df.withColumnRenamed("u", "node"), "node", "left_anti")
        share = _audited(judged, nodes.df, pairs.df, threshold, audit)
        _log.info("audited recall: %s", share)
        if share is not None and share >= recall:
            break
        if share is None or attempt == 2:
            _log.warning("audited recall is %s: all nodes are compared with their whole label", share)
            saturated.drop()
            saturated = Cut(nodes.df.select(F.col("node").alias("u")), "saturated")
            break
        width *= 2
        fresh = prepared(seed + attempt + 1).select("id", F.col("sigs").alias("other")).groupBy("id").agg(F.first("other").alias("sigs"))
        planes = nodes.df.drop("sigs").join(fresh.withColumnRenamed("id", "node"), "node")
    wide = _enlarged(nodes.df, saturated.df, threshold)
    extra = wide.df.where("v is not null").select("u", "v")
    every = Cut(pairs.df.union(extra).union(extra.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    weight = nodes.df.select(F.col("node").alias("v"), "copies")
    open_count = every.df.join(saturated.df, "u", "left_anti").join(weight, "v").groupBy("u").agg(F.sum("copies").alias("l"))
    full_count = wide.df.where("links is not null").groupBy("u").agg(F.sum("links").alias("l"))
    counts = open_count.union(full_count)
    found = components(every.df.select(F.col("u").alias("a"), F.col("v").alias("b")))
    label = nodes.df.select("node", "grp", "h1", "h2", "copies").join(counts.withColumnRenamed("u", "node"), "node", "left").join(found.df, "node", "left")
    label = Cut(label.select("grp", "h1", "h2", (F.col("copies") - 1 + F.coalesce("l", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c")).where("n > 0"), "labels")
    out = rows.df.select("id", "grp", "h1", "h2").join(label.df, ["grp", "h1", "h2"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", "id").alias("c"))
    rest = base.select("id").withColumn("one", F.lit(1)).groupBy("id").agg(F.count(F.lit(1)).alias("all")).join(rows.df.groupBy("id").agg(F.count(F.lit(1)).alias("used")), "id", "left")
    rest = rest.where("id is null or used is null or used < all").select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("all") - F.coalesce("used", F.lit(0)))).alias("i"))
    out = out.union(rest.select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def _as_float32(s):
    return s.map(lambda b: np.frombuffer(b).astype(np.float32).tobytes())


def _audited(judged: DataFrame, nodes: DataFrame, links: DataFrame, threshold: float, audit: int) -> float | None:
    """Recall of the nodes with open lists; None if the largest audit sees no link though there are more nodes.

    Saturated nodes are searched exactly afterwards.
    """
    size = audit
    while True:
        seen, real, found = _audit(judged, nodes, links, threshold, size)
        if seen < size:  # every node
            return found / real if real else 1.0
        if real >= AUDIT_LINKS or size >= AUDIT_GROWTH * audit:
            return found / real if real else None
        size *= 4


def _audit(judged: DataFrame, nodes: DataFrame, links: DataFrame, threshold: float, size: int) -> tuple[int, int, int]:
    """Audited nodes, their links by brute force, and how many of these were found."""
    ids = judged.select("node", "grp", "unit").orderBy(F.xxhash64("node"), "node").limit(size).collect()
    if not ids:
        return 0, 0, 0
    shared = nodes.sparkSession.sparkContext.broadcast([(r.node, r.grp, bytes(r.unit)) for r in ids])

    def truth(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            node, grp, unit = t["node"].to_numpy(), t["grp"].to_numpy(), np.array(t["unit"].to_pylist(), object)
            a, b = [], []
            for g in {x[1] for x in shared.value}:
                rows = np.flatnonzero(grp == g)
                mine = [x for x in shared.value if x[1] == g]
                if not len(rows):
                    continue
                s = np.frombuffer(b"".join(unit[rows])).reshape(len(rows), -1) @ np.stack([np.frombuffer(x[2]) for x in mine]).T
                for i, j in zip(*np.nonzero(s >= threshold), strict=True):
                    if node[rows[i]] != mine[j][0]:
                        a.append(int(mine[j][0]))
                        b.append(int(node[rows[i]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    real = nodes.select("node", "grp", "unit").mapInArrow(truth, "u long, v long").distinct()
    both = real.join(links.select("u", "v", F.lit(1).alias("found")), ["u", "v"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("f")).first()
    return len(ids), both.n, both.f


def op6_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
