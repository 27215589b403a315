"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, joined_hot, stored


def _to_least(edges: DataFrame) -> DataFrame:
    """Directed edges (u, v) with m, the least of u and all its v; a node of very many edges isn't dealt to one task."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k"))
    return joined_hot(edges, least, "u", "k")


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (a, b), the least node it reaches. Nothing is collected.

    Each round writes its edges to the shared scratch folder; the loop ends when a round changes none, after a number
    of rounds of the order of the logarithm of the longest path. Loops and repeated links are fine.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        down = _to_least(down)  # v < u, so m is the least v
        small = down.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        older, edges = edges, stored(small.distinct(), "links")
        discard(older)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
