"""Connected components by alternating large-star and small-star steps; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b), both long. Returns (node, component), one row for each node that an edge has; component is the
    component's smallest node. Loops and repeated edges are harmless; without edges there are no rows. The smallest
    neighbour of a node is found by aggregation and joined back, so a node with many neighbours is never one task's list
    (the join splits it)."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that both sides of the join are dealt anew and a node with very many neighbours can be split.
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node whose own smallest neighbour is smaller keeps its link to it.
        own = least.filter("m < a").select("a", F.col("m").alias("b"))
        large = large.union(own).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
