"""Connected components of an edge table by alternating large-star and small-star steps.

Neither edges nor components ever leave the executors.  Each step maps a node's
neighbours to the least of them with one aggregation and one join, so a hub with
very many neighbours is an aggregation with partial sums and a join that the
adaptive planner may split, never one task's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.scratch import discard, stored


def _star(pairs: DataFrame, keep_centre: bool) -> DataFrame:
    """``pairs`` (u, v): link v's to the least of u and its v's; with ``keep_centre`` u as well."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    out = linked.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_centre:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node that edges reach.

    Repeated edges and both directions are fine; null ends and self-loops are
    ignored; an empty edge table gives an empty result.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = stored(edges, "edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        after = stored(_star(large, keep_centre=True), "edges")
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(edges)
        edges = after
        if state == now:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
