"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours hang on the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (a, b): root is the component's smallest node.

    Each round is checkpointed; it ends when a round changes nothing.
    """
    edges = checkpointed(links.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        digest = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == before:
            break
        before = digest
        edges = checkpointed(_small_star(_large_star(edges)))
    tops = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tops.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
