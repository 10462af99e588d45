"""Connected components of links by alternating star contraction, safe for nodes with very many links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelens.operators.ordered import attach
from linelens.session import materialize


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two link tables hold the same links, by count and an order-free sum of hashes."""
    facts = [t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first() for t in (x, y)]
    return tuple(facts[0]) == tuple(facts[1])


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """key, root: for every node of the links (a, b) the smallest node of its component.

    Large-star and small-star rounds until nothing changes. A node's smallest neighbour is a map-side
    aggregate; it goes back to the node's links by ``attach``, so that a star of any size is not one task.
    No links give no rows.
    """
    e = materialize(_turned(edges.where("a <> b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("key"), F.col("b").alias("root"))
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = attach(both.where("b > a"), low, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = attach(large, least, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(_turned(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")).distinct())
        if _same(e, small):
            return small.select(F.col("a").alias("key"), F.col("b").alias("root"))
        e = small
