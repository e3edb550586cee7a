"""Semi and anti joins of whole documents with sets of ids that may be too many to broadcast.

A few ids are broadcast. More make a sieve first: ``BITS`` bits in rows of 4 KB, 16 MB in all whatever the number of ids, which
is broadcast. Only documents whose bit is set go through the exchange of the exact join, so that the texts of the others
never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27
#: A table with at most so many rows (24 bytes each) is broadcast.
BROADCAST_ROWS = 500_000


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BITS)) + 1


def _sieved(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` and ``_may`` boolean: false for keys that aren't among the ids."""
    place = _place(key)
    sieve = ids.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    bit = F.bitmap_bit_position(F.col("_place"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number(F.col("_place"))).join(F.broadcast(sieve), "_bucket", "left")
    return found.withColumn("_may", F.coalesce(F.get(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.floor(byte / F.pow(F.lit(2), i)), F.lit(2)) == 1), F.pmod(bit, F.lit(8)).cast("int")), F.lit(False))).drop("_place", "_bucket", "_bits")


def semi(rows: DataFrame, ids: DataFrame, key: str, few: int | None = None) -> DataFrame:
    """Rows whose key is among the written table ``ids`` (column ``key``, distinct)."""
    if ids.count() <= (BROADCAST_ROWS if few is None else few):
        return rows.join(F.broadcast(ids), key, "left_semi")
    return _sieved(rows, ids, key).where("_may").drop("_may").join(ids.hint("merge"), key, "left_semi")


def anti(rows: DataFrame, ids: DataFrame, key: str, few: int | None = None) -> DataFrame:
    """Rows whose key isn't among the written table ``ids``, those with a null key included."""
    if ids.count() <= (BROADCAST_ROWS if few is None else few):
        return rows.join(F.broadcast(ids), key, "left_anti")
    found = _sieved(rows, ids, key)
    return found.where("not _may").drop("_may").unionByName(found.where("_may").drop("_may").join(ids.hint("merge"), key, "left_anti"))
