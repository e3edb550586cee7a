"""Outcomes of extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspan.functions.scalars import error_class


def counts(members: DataFrame, keys: list[str] | None = None, error: str = "error") -> DataFrame:
    """total, success and error of outcomes with a null or empty error for success."""
    failed = F.col(error).isNotNull() & (F.col(error) != "")
    return members.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("error"))


def succeeded(results: DataFrame) -> DataFrame:
    """Adds ``ok``: something was extracted and nothing failed."""
    return results.withColumn("ok", (F.col("success") > 0) & (F.col("error") == 0))


def by_class(members: DataFrame, error: str = "error") -> DataFrame:
    return members.groupBy(error_class(error).alias("class")).agg(F.count(F.lit(1)).alias("members"))
