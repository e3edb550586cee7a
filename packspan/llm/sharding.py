"""Shards by proportional stratified interleaving, in DataFrame functions only.

Rows of a source are ranked in the order of a seeded hash of their ids. A row's fractional rank is (rank + 1/2) / rows of
its source, so all sources spread evenly over 0..1; sorted by it, the rows mix every source in proportion anywhere. The
sorted sequence is cut at the shards' bounds: by rows, the counts of shards are at most one apart.

Both orders are range partitioned, down to a number that tells even equal rows apart, sorted within partitions and written;
a row's position is its place in its partition and the counts of the partitions before. So no source, no repeated or null id
and no fraction that many sources share goes to one task; windows see a row for each partition and source only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspan.runtime import Cut, table

BROADCAST_ROWS = 500_000
_HASH_BITS = 60


def _seeded(id_col: str, seed: int) -> F.Column:
    """60 bits of md5 of seed and id; every engine has md5, so the order can be recomputed anywhere."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _looked_up(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    small = ranges.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ranges) if small else ranges, keys)


def _placed(rows: DataFrame, order: list[str]) -> Cut:
    """The rows with the number of their range (part) by ``order`` and their place within it (at), both from 0."""
    keys = [F.asc_nulls_first(c) for c in order]
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return Cut(ranged.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "placed")


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, text_crc32, source, shard and slot of every row of ``docs``.

    size is the UTF-8 bytes of the text (0 if null) plus 1, text_crc32 that of the text (null: empty). Null sources are
    a source of their own, a null id orders like an empty one. Rows with equal ids are ordered by text_crc32 and size, so
    repeated rows are interchangeable. slot counts from 0 within a shard, in the interleaved order. Other columns aren't
    read, and an empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        _seeded(id_col, seed).alias("h"),
        F.monotonically_increasing_id().alias("nth"),  # written with the row, so that it stays
    )
    base = Cut(base, "rows")
    n = base.df.count()
    # 1. ranks within sources
    tail = ["stratum", "h", "id", "text_crc32", "size", "nth"]
    placed = _placed(base.df, tail)
    own = Window.partitionBy("stratum")
    runs = placed.df.groupBy("part", "stratum").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("begin"))
    runs = Cut(runs.select("part", "stratum", (F.sum("c").over(own.orderBy("part")) - F.col("c") - F.col("begin")).alias("before"), F.sum("c").over(own).alias("all")), "strata")
    ranked = _looked_up(placed.df, runs.df, ["part", "stratum"])
    ranked = Cut(ranked.select(*base.df.columns, ((F.col("at") + F.col("before") + 0.5) / F.col("all")).alias("f")), "ranked")
    base.drop()
    placed.drop()
    # 2. positions in the order of fractional ranks
    placed = _placed(ranked.df, ["f", *tail])
    ranked.drop()
    steps = placed.df.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    steps = Cut(steps.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before")), "steps")
    placed = _looked_up(placed.df, steps.df, ["part"]).withColumn("pos", F.col("at") + F.col("before"))
    # 3. cuts: shard s holds positions from ceil(s * n / shards) on
    placed = placed.withColumn("shard", F.expr(f"cast(pos * {shards} div {max(n, 1)} as int)"))
    start = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "source", "shard", (F.col("pos") - start).cast("long").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
