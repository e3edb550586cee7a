"""Connected components of a graph of links, as large-star and small-star contractions on DataFrames.

Each pass is aggregates and equi-joins; the one row a node has in the table of minima is joined to its links through an
exchange of its own, so that adaptive execution can split the links of a hub. Passes are cut by tables in the shared
folder. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspan.runtime import Cut


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, max_passes: int = 60) -> Cut:
    """links(a, b) long, in any direction, with repeats and self-links -> table (node, component) of linked nodes.

    component is the smallest node reachable. Links with a null end are ignored; no links give an empty table.
    """
    edges = Cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _sum(edges.df)
    for _ in range(max_passes):
        old = edges
        both = edges.df.union(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = Cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = Cut(both.join(low.df, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low.drop()
        low = Cut(large.df.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.df.join(low.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.df.select("u", F.col("m").alias("v")))
        edges = Cut(small.distinct(), "links")
        for c in (low, large, old):
            c.drop()
        before, state = state, _sum(edges.df)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_passes} passes")
    out = Cut(edges.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    edges.drop()
    return out
