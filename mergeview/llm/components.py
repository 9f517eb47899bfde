"""Connected components of a graph of links, by alternating large and small stars.

Each round makes a node's larger neighbours point to its smallest neighbour and then its smaller ones
likewise, until every component is a star around its smallest id.  The number of rounds grows with the
logarithm of the graph's size.  Joins run between written tables, so that Spark splits the partition of
a hub; minima are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeview.llm.tables import Saved


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, saved: Saved) -> DataFrame:
    """links: two columns of longs; nulls and links to oneself are ignored.  Gives node, component for linked nodes."""
    a, b = links.columns
    edges = saved.keep(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        lowest = saved.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = saved.keep(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(lowest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest2 = saved.keep(large.groupBy("hi").agg(F.min("lo").alias("m")))
        moved = large.join(lowest2, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = saved.keep(moved.union(lowest2.select("hi", F.col("m").alias("lo"))).distinct())
        saved.drop(edges, lowest, large, lowest2)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
