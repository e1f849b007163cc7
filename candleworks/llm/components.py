"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_each, release


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", hub: int = 100_000) -> DataFrame:
    """(node, root) for every node that has a link to another: root is the smallest
    node it reaches. Repeated links, both directions and loops may occur; null ends
    are no links. Least values are aggregated before the shuffle and joined back; those
    of hubs (more than `hub` links, and more than 1/1000 of all) are broadcast, so the
    links of a node are never gathered in one task. Each round is written to the shared
    folder. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    edges = durable(edges.where(F.col("__a") != F.col("__b")).select("a", "b").distinct())
    before = _state(edges)
    while before[0]:
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_each(both.where("b > a"), least, "a", "n", 2 * before[0], hub).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours go to the least of those
        large = durable(large)
        release(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_each(large, least, "a", "n", 2 * before[0], hub).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = durable(small.distinct())
        release(large)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
