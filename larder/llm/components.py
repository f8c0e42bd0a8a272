"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _large_star(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood. e: (u, v), u > v."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join can split a node of very many neighbours
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = stored(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node that has an edge to another, with the least node it reaches.

    edges: two columns of node ids, in any direction; loops, nulls and repeats are dropped. Each round is written to a
    scratch table, the one before it is dropped; the driver sees a count and a checksum. Hot nodes only meet in aggregates with a map-side part and in
    joins whose large side can be split.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e, seen = stored(e, "edges"), None
    for _ in range(most_rounds):
        before, e = e, stored(_small_star(_large_star(e)), "stars")
        dropped(before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError("components did not settle")
