"""Files below a folder: recursive walks, listings of one level, sizes. Contents aren't read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspan.functions import paths
from packspan.functions.scalars import is_archive_name


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """Every file at any depth: path (below the folder), name, size, modified."""
    from packspan.sources.archive import register

    register(spark)
    return spark.read.format("folder_files").option("path", folder).load().select("path", paths.name("path").alias("name"), "size", "modified")


def listing(files: DataFrame, within: str = "") -> DataFrame:
    """Children of one directory of a walk, directories first, then by lower-cased name: name, is_dir, size (of all below).

    Files are summed up by child before the sort, so only one level is ever sorted.
    """
    inside = within.strip("/")
    rest = F.col("path") if not inside else F.when(F.startswith("path", F.lit(inside + "/")), F.substring("path", len(inside) + 2, 1 << 30))
    steps = files.select(rest.alias("rest"), "size").where("rest is not null")
    children = steps.groupBy(F.substring_index("rest", "/", 1).alias("name"), F.contains("rest", F.lit("/")).alias("is_dir")).agg(F.sum("size").alias("size"))
    return children.orderBy(F.desc("is_dir"), F.lower("name"), "name")


def bytes_to_compress(files: DataFrame) -> DataFrame:
    """Files and bytes that packing a folder would read, archives among them left out: one row."""
    return files.where(~is_archive_name("name")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """path, one, two and same: sizes of the files of two walks; a file that only one has isn't the same."""
    a, b = one.select("path", F.col("size").alias("one")), two.select("path", F.col("size").alias("two"))
    return a.join(b, "path", "full").select("path", "one", "two", F.coalesce(F.col("one") == F.col("two"), F.lit(False)).alias("same"))
