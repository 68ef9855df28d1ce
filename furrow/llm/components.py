"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import staged


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; ``root`` is the smallest node of its component.

    Both steps are an aggregate and a join on the node, so a hub's links are split by the skew
    join and never gathered. Every round is written to the shared folder. A round that changes
    nothing ends the loop; the number of rounds grows with the logarithm of the longest path.
    """
    down = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = staged(links.where("a <> b").select(down.alias("e")).select("e.*").distinct(), "links")
    seen = _mark(edges)
    while True:
        edges = staged(_small_star(_large_star(edges)), "links")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
