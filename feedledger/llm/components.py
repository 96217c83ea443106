"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from .shared import staged


def _to_smallest(links: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest of a node and its neighbours; written, so that the join with
    it has an exchange on both sides and a hub's links can be split by AQE."""
    return staged(links.groupBy("u").agg(F.min("v").alias("m"))
                  .select("u", F.least("u", "m").alias("m")), "smallest")


def _signature(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)``, root = smallest node reachable.

    Self links and repeats don't matter; nodes without links are not listed; an empty table
    gives an empty table. Each round is written to the shared folder. A hub is only ever a
    join key on its many-row side, next to one row, and an aggregation key with a map side.
    """
    edges = staged(links.where("a <> b")
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(both.where("v > u").join(_to_smallest(both), "u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u <> v").distinct(), "large")
        low = _to_smallest(large)
        edges = staged(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(low.select("u", F.col("m").alias("v")))
                       .where("u <> v").distinct(), "small")
        after = _signature(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
