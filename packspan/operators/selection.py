"""Selecting entries: by path or directory, by visibility in a tree, by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspan.functions import paths
from packspan.functions.scalars import is_archive_name
from packspan.operators.volumes import volume_format


def selections(selected: DataFrame, column: str = "sel") -> DataFrame:
    """Normalised, distinct selections, empty ones left out."""
    return selected.select(*[c for c in selected.columns if c != column], paths.normalise(column).alias("_sel")).where("_sel is not null").distinct()


def select_entries(entries: DataFrame, selected: DataFrame, keys: list[str] | None = None, column: str = "sel") -> DataFrame:
    """Entries whose path is selected or lies below a selected directory.

    ``a/b`` selects ``a/b`` and ``a/b/c`` but not ``a/bc``. A selection is a prefix of a path at a slash if and only if it
    is one of the path's ancestors or the path, so the prefix test is an equi semi-join on those: hash or sort-merge,
    never a nested loop. The planner broadcasts the selection if its statistics are small. No selection selects nothing.
    """
    keys = keys or []
    wanted = selections(selected, column)
    known = entries.select(*keys, "path").distinct().select(*keys, "path", F.explode(paths.ancestors("path", with_self=True)).alias("_sel"))
    hit = known.join(wanted, [*keys, "_sel"], "left_semi").select(*keys, "path").distinct()
    return entries.join(hit, [*keys, "path"], "left_semi")


def selection_stats(entries: DataFrame, selected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files and bytes of a selection: one row, the denominator of an extraction's progress."""
    hit = select_entries(entries, selected, keys).where(~F.col("is_dir"))
    return hit.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def visible(entries: DataFrame, expanded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entries all of whose ancestors are expanded: the others have one that isn't, and are joined away."""
    keys = keys or []
    above = entries.select(*keys, "path", F.explode(paths.ancestors("path")).alias("dir"))
    closed = above.join(expanded.select(*keys, "dir").distinct(), [*keys, "dir"], "left_anti")
    return entries.join(closed.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")


def matching(entries: DataFrame, query: str) -> DataFrame:
    """Entries with the query in path or name, whatever the case."""
    return entries.where(F.contains(F.lower("path"), F.lit(query.lower())))


def toggled(selected: DataFrame, entries: DataFrame, path: str, on: bool) -> DataFrame:
    """The selection after ``path`` was switched on or off: it and all below it join or leave."""
    one = selected.sparkSession.createDataFrame([(path,)], "sel string")
    group = select_entries(entries, one).select(F.col("path").alias("sel"))
    return selected.select("sel").union(group).distinct() if on else selected.select("sel").join(group, "sel", "left_anti").distinct()


def compressible(entries: DataFrame) -> DataFrame:
    """Directories, and files that aren't archives."""
    return entries.where(F.col("is_dir") | ~is_archive_name(paths.name("path")))


def batch_archives(entries: DataFrame) -> DataFrame:
    """Files that are archives or parts of one by their names."""
    return entries.where(~F.col("is_dir") & (is_archive_name(paths.name("path")) | volume_format(paths.name("path")).isNotNull()))
