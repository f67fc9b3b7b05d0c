"""Connected components of a link table, as joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links(a, b)``; component = smallest node.

    Alternating star contraction: the large-star step hangs every larger
    neighbour of a node on the smallest node of its neighbourhood, the
    small-star step does the same with the smaller neighbours. The rows never
    outnumber the links, and each round is one grouped minimum (combined before
    its shuffle) and one join per step. Every round is written to the shared
    folder. Rounds end when nothing changes; their number grows with the
    logarithm of the longest path.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                .select("e.u", "e.v").where("u <> v").distinct())
        edges = materialize(star, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
