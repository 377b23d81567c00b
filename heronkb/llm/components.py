"""Distributed connected components by alternating large-star and small-star steps.

DataFrame operations only. Each step groups by node with map-side minima and joins the edges to them;
joins on a hub node are ordinary sort-merge joins, whose skewed partitions Spark splits. Nothing is
collected but a count and a checksum, by which the end is seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import checkpointed, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (least node reachable) for every node of an edge; null ends and loops are ignored."""
    a, b = F.col(src), F.col(dst)
    now = checkpointed(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        near = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(near, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionByName(near.select("hi", F.col("m").alias("lo"))).distinct()
        now = checkpointed(small)
        del both, least, large, near, small
        release(now.sparkSession)
    # At the end all edges go from a node to the least one of its component.
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
