"""Connected components of a link table, without moving the links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import release, settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `links`; root is the smallest node reachable. Links to itself and repeated ones count once.

    Large-star and small-star steps alternate until the links are stars. A step sends each node its smallest neighbour by an
    aggregate that is combined before the shuffle, and a join that Spark can split where one node has most of the links.
    """
    edges = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    nodes = settled(edges.select("u").union(edges.select("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = settled(small.where("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        release(links.sparkSession)
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return settled(nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("root", "u").alias("root")))
