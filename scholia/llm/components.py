"""Connected components of a distributed edge table: alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b): component is the smallest node it can reach.

    Both stars keep connectivity and only ever lower a node's parent; nothing is gathered by node but minima.
    """
    now = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        # large star: every larger neighbour of u, and u, point to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return rooted.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
