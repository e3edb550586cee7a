"""Progress and cancellation of jobs: counters observed as rows pass, tags by which running work is stopped."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def counted(rows: DataFrame, size: str | None = None) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds ``rows`` (and ``bytes`` of ``size``) once an action has run.

    Counters ride along with the job; there is no second pass.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    if size is not None:
        metrics.append(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return rows.observe(seen, *metrics), seen


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[str]:
    """Jobs started inside carry the tag; ``cancel`` from another thread ends them, their readers and writers included.

    Session tags reach only some of a session's work, so the tag is put on the jobs themselves.
    """
    spark.sparkContext.addJobTag(tag)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End all running jobs with the tag; the threads that wait for them get an error."""
    spark.sparkContext.cancelJobsWithTag(tag)
