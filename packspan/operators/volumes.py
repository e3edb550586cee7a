"""Multi-part archives: part names, their order, and where each part's bytes begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packspan.functions.paths import _c

# Names of parts.
MODERN_RAR = r"(?i)^(.+)\.part(\d+)\.rar$"
OLD_RAR = r"(?i)^(.+)\.([r-z])(\d{2})$"
SEVEN_ZIP = r"(?i)^(.+)\.(?:7z\.)?(\d{2,3})$"
SEVEN_ZIP_MAGIC = b"7z\xbc\xaf\x27\x1c"


def volume_format(name: str | Column) -> Column:
    """``rar`` or ``7z`` for names of parts, else null."""
    n = _c(name)
    return F.when(n.rlike(MODERN_RAR) | n.rlike(OLD_RAR), "rar").when(n.rlike(SEVEN_ZIP), "7z")


def volume_base(name: str | Column) -> Column:
    """The name that the parts of a set share; null for names of no part."""
    n = _c(name)
    out = F.when(n.rlike(MODERN_RAR), F.regexp_extract(n, MODERN_RAR, 1)).when(n.rlike(OLD_RAR), F.regexp_extract(n, OLD_RAR, 1))
    return out.when(n.rlike(SEVEN_ZIP), F.regexp_extract(n, SEVEN_ZIP, 1)).when(n.rlike(r"(?i)^.+\.rar$"), F.regexp_replace(n, r"(?i)\.rar$", ""))


def volume_number(name: str | Column) -> Column:
    """Place in the set: ``.rar`` is -1, modern and 7z parts have their number, old ones 100 for each letter from r and NN."""
    n = _c(name)
    number = lambda pattern, group: F.expr("null").cast("int") if pattern is None else F.try_to_number(F.regexp_extract(n, pattern, group), F.lit("999999999")).cast("int")
    out = F.when(n.rlike(MODERN_RAR), number(MODERN_RAR, 2))
    out = out.when(n.rlike(OLD_RAR), (F.ascii(F.lower(F.regexp_extract(n, OLD_RAR, 2))) - F.lit(ord("r"))) * 100 + number(OLD_RAR, 3))
    return out.when(n.rlike(SEVEN_ZIP), number(SEVEN_ZIP, 2)).when(n.rlike(r"(?i)^.+\.rar$"), -1)


def volume_sets(files: DataFrame) -> DataFrame:
    """Sets of at least two parts of files(dir, name[, head]): set_key, format, ordinal from 0 and name.

    A 7z set needs the magic number on its first part, if ``head`` (a file's first bytes) is given. Windows hold one
    set's parts; sets are as large as an archive has volumes.
    """
    own = Window.partitionBy("dir", "base", "format")
    rows = files.withColumn("format", F.coalesce(volume_format("name"), F.when(F.col("name").rlike(r"(?i)^.+\.rar$"), "rar"))).where("format is not null")
    rows = rows.withColumn("base", volume_base("name")).withColumn("n", volume_number("name"))
    rows = rows.withColumn("ordinal", (F.row_number().over(own.orderBy("n", "name")) - 1).cast("int")).withColumn("parts", F.count(F.lit(1)).over(own))
    rows = rows.where("parts > 1")
    if "head" in files.columns:
        first = F.first("head").over(own.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = rows.withColumn("_head", first).where((F.col("format") != "7z") | (F.substring("_head", 1, 6) == F.lit(SEVEN_ZIP_MAGIC)))
    return rows.select(F.concat_ws("/", "dir", "base").alias("set_key"), "format", "ordinal", "name")


def joined(sets: DataFrame) -> DataFrame:
    """One row for each set: its parts in order, a line each."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "name")))
    return sets.groupBy("set_key", "format").agg(F.array_join(F.transform(parts, lambda p: p["name"]), "\n").alias("volumes"))


def offsets(parts: DataFrame, keys: list[str], order: list[str], length: str = "length") -> DataFrame:
    """Adds ``start`` and ``end`` of each part in its set's concatenated bytes."""
    end = F.sum(length).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return parts.withColumn("end", end).withColumn("start", F.col("end") - F.col(length))
