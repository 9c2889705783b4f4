"""Connected components of an edge table by alternating large and small stars, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _to_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Connect the neighbours of each node `u` to the smallest of them and `u` itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = edges.join(least, "u")
    if larger_only:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge.

    Nulls and self-links are ignored. Each round is stored; the number of rounds grows with the logarithm
    of the component size. No component is ever gathered in one task: hubs are aggregated before
    the shuffle, and a hub's links meet its minimum in a join that adaptive execution may split.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = store(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = store(_to_minimum(both, True).distinct(), "large-star")
        edges = store(_to_minimum(large, False).distinct(), "small-star")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
