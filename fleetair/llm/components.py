"""Connected components of a graph given as pairs of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetair.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """For each vertex ``u`` the smallest of itself and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("u"), F.col("v").alias("v")),
        F.struct(F.col("v").alias("u"), F.col("u").alias("v")),
    )))


def connected(pairs: DataFrame) -> DataFrame:
    """``u, v`` pairs in any order -> ``vertex, root``: the smallest vertex reachable.

    Alternating large-star and small-star steps: the number of rounds grows with
    the logarithm of the graph. A vertex with very many neighbours is met only by
    grouped minima, which combine before the shuffle, and by a join that has one
    row per vertex on its other side, which adaptive execution splits.
    """
    edges = written(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v").distinct(), "edges")
    before = None
    while True:
        # Large star: every larger neighbour of u is hung under u's minimum.
        ways = _both_ways(edges)
        hung = ways.join(_least(ways), "u").where("v > u and v <> m")
        large = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are hung under u's minimum.
        down = large.join(_least(large), "u")
        edges = written(
            down.select(F.inline(F.array(
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            ))).where("u <> v").distinct(), "edges")
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
                edges.select("v", "v")).distinct()
        before = now
