"""Catalogs of archive entries: implied directories, deduplication, order, exchange format and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packspan.functions import paths
from packspan.runtime import Cut
from packspan.schema import LISTING_JSON, RESULT_JSON


def with_path_parts(entries: DataFrame, path: str = "path") -> DataFrame:
    """Adds name, parent, ext and depth of a normalised path; no shuffle."""
    return entries.withColumns({"name": paths.name(path), "parent": paths.parent(path), "ext": paths.extension(paths.name(path)), "depth": paths.depth(path)})


def implied_dirs(entries: DataFrame, keys: list[str] | None = None, path: str = "path") -> DataFrame:
    """Every proper prefix of a path once, for each value of ``keys`` (say, the archive), and how many entries lie below it.

    Prefixes are counted before the shuffle, so deep trees and hot directories move little.
    """
    keys = keys or []
    return entries.select(*keys, F.explode(paths.ancestors(path)).alias("dir")).groupBy(*keys, "dir").agg(F.count(F.lit(1)).alias("entries"))


def keep_first(entries: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by ``order``, which must tell rows apart.

    An aggregate, not a window: rows are reduced before the shuffle, so a key with most of the rows is no task's burden.
    Null keys are a key.
    """
    names = [c for c in entries.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    first = F.min_by(F.struct(*names), F.struct(*order)).alias("first")
    return entries.groupBy(*keys).agg(first).select(*keys, *[F.col("first")[n].alias(n) for n in names]).select(*entries.columns)


def merged_catalog(entries: DataFrame) -> DataFrame:
    """Entries of (archive, path, is_dir, size, ordinal, ...) with implied directories, the first of each path kept.

    Explicit rows come before implied ones, by their place in the archive.
    """
    dirs = implied_dirs(entries, ["archive"]).select("archive", F.col("dir").alias("path"))
    extra = {c: F.lit(None).cast(entries.schema[c].dataType) for c in entries.columns if c not in ("archive", "path")}
    extra |= {"is_dir": F.lit(True), "size": F.lit(0).cast("long"), "ordinal": F.lit((1 << 62)).cast("long")}
    if "implied" in entries.columns:
        extra["implied"] = F.lit(True)
    if "format" in entries.columns:
        formats = entries.groupBy("archive").agg(F.first("format").alias("format"))
        dirs, extra = dirs.join(formats, "archive"), {k: v for k, v in extra.items() if k != "format"}
    implied = dirs.withColumns(extra).select(*entries.columns)
    return keep_first(entries.union(implied), ["archive", "path"], ["ordinal", F.col("is_dir").cast("int"), F.coalesce("size", F.lit(-1))])


def sorted_by_path(entries: DataFrame) -> DataFrame:
    """Bytewise by path, directories first at the same path."""
    return entries.orderBy("path", F.desc("is_dir"), "ordinal")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` from 1 by ``order``, without bringing the rows to one task.

    Rows are range-partitioned and sorted, written once, and numbered by the counts of the partitions before.
    """
    place = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = Cut(sorted_rows.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranked").df
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return cut.join(F.broadcast(before), "_part").withColumn("rank", F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_n", "_before")


def running_total(rows: DataFrame, value: str, order: list[str], bucket: Column, keys: list[str] | None = None, name: str = "running") -> DataFrame:
    """Adds the running sum of ``value`` by ``order`` within ``keys``; ``bucket`` must grow with the order.

    Buckets are summed first and only rows of one bucket meet in a task, so a single global order scales.
    """
    keys = keys or []
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, [*keys, "_bucket"]).withColumn(name, (inside + F.col("_before")).cast("long")).drop("_bucket", "_before")


# Exchange format


def listing_json(entries: DataFrame) -> DataFrame:
    """A listing for each archive: a JSON array of {n, s, d, e} by path. Unknown sizes are 0 there."""
    item = F.struct(F.col("path").alias("n"), F.coalesce("size", F.lit(0)).alias("s"), F.coalesce("is_dir", F.lit(False)).alias("d"), F.coalesce("is_encrypted", F.lit(False)).alias("e"))
    return entries.groupBy("archive").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("listing"))


def parse_listing(rows: DataFrame, column: str = "listing") -> DataFrame:
    """Entries of JSON listings; missing sizes count 0 and missing flags false. Malformed listings give no rows."""
    keep = [c for c in rows.columns if c != column]
    items = rows.select(*keep, F.posexplode(F.from_json(column, LISTING_JSON)).alias("ordinal", "x")).where("x.n is not null")
    return with_path_parts(
        items.select(*keep, F.col("ordinal").cast("long").alias("ordinal"), F.col("x.n").alias("path"), F.coalesce("x.s", F.lit(0)).alias("size"), F.coalesce("x.d", F.lit(False)).alias("is_dir"), F.coalesce("x.e", F.lit(False)).alias("is_encrypted"))
    )


def parse_result(column: str | Column) -> Column:
    """Struct (total, success, error); (0, 0, 1) for what isn't one."""
    c = F.col(column) if isinstance(column, str) else column
    r = F.from_json(c, RESULT_JSON)
    bad = r.isNull() | r["total"].isNull() & r["success"].isNull() & r["error"].isNull()
    return F.when(bad, F.struct(F.lit(0).alias("total"), F.lit(0).alias("success"), F.lit(1).alias("error"))).otherwise(
        F.struct(*[F.coalesce(r[k], F.lit(0)).alias(k) for k in ("total", "success", "error")])
    )


def batch_view(entries: DataFrame) -> DataFrame:
    """Several archives as one tree: members below their archive's name, one level deeper, and a root row for each.

    Archives of the same name in different places are told apart as files are: the second one is ``name (1).zip``.
    """
    archives = unique_names(entries.select("archive").distinct().withColumn("_file", paths.name("archive")), "_file", ["archive"]).select("archive", "unique_name")
    named = entries.join(archives, "archive")
    members = named.select(F.concat("unique_name", F.lit("/"), "path").alias("path"), "archive", F.coalesce("size", F.lit(0)).alias("size"), "is_dir", (paths.depth("path") + 1).alias("depth"))
    roots = archives.select(F.col("unique_name").alias("path"), "archive", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir"), F.lit(0).alias("depth"))
    return roots.union(members).select("archive", "path", "size", "is_dir", "depth")


# Statistics


def totals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Files and bytes of the entries that aren't directories."""
    return entries.groupBy(*keys).agg(F.count_if(~F.col("is_dir")).alias("files"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("bytes"))


def batch_totals(entries: DataFrame) -> DataFrame:
    """Archives, files and bytes of a merged catalog: one row. Archives are summed up first."""
    per = totals(entries, ["archive"])
    return per.agg(F.count(F.lit(1)).alias("archives"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def directory_sizes(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files and bytes below every directory at once."""
    keys = keys or []
    below = entries.where(~F.col("is_dir")).select(*keys, F.explode(paths.ancestors("path")).alias("dir"), "size")
    return below.groupBy(*keys, "dir").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def needs_password(entries: DataFrame) -> DataFrame:
    return entries.groupBy("archive").agg(F.coalesce(F.bool_or("is_encrypted"), F.lit(False)).alias("needs_password"))


def grouped_selection(selected: DataFrame) -> DataFrame:
    """The selected paths of each archive, sorted."""
    return selected.groupBy("archive").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def unique_names(rows: DataFrame, name: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """Adds ``unique_name``: repeats of a name in ``order`` get `` (n)``, on from names that are taken already."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    if taken is None:
        return rows.withColumn("unique_name", paths.numbered(name, nth))
    base = F.regexp_replace(F.col("taken"), r" \(\d+\)(\.[^.]*)?$", "$1")
    used = taken.select(F.col(taken.columns[0]).alias("taken")).select("taken", F.explode(F.array_distinct(F.array("taken", base))).alias(name))
    number = F.when(F.col("taken") == F.col(name), 0).otherwise(F.try_to_number(F.regexp_extract("taken", r" \((\d+)\)(\.[^.]*)?$", 1), F.lit("999999999")).cast("int"))
    used = used.select(name, (number + 1).alias("used")).groupBy(name).agg(F.max("used").alias("_used"))
    return rows.join(used, name, "left").withColumn("unique_name", paths.numbered(name, nth + F.coalesce("_used", F.lit(0)))).drop("_used")
