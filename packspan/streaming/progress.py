"""Progress logs and archive folders as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspan.operators import search


def member_progress(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Bytes so far of each member and minute of a stream log(ts, member, bytes).

    Rows later than the watermark are left out, so state is bounded by the members active within it.
    """
    late = log.withWatermark("ts", watermark)
    return late.groupBy(F.window("ts", "1 minute").alias("minute"), "member").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("steps")).select("minute.start", "member", "bytes", "steps")


def watched_texts(spark: SparkSession, folder: str, query: str, max_bytes: int = 1_000_000) -> DataFrame:
    """Content search over text files as they arrive in a folder; larger files aren't read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") < max_bytes)
    return search.by_content(small.select("path", F.decode("content", "UTF-8").alias("text")), query, None)
