"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Both stars replace edges by edges to the least neighbour and keep components as they are; the number of rounds
grows with the logarithm of the longest path. Each round is two aggregates with partial sums and two joins that
Spark may split where a vertex has very many edges; no vertex's neighbours are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v. Large: neighbours above u go to the least of all; small: those below u, and u."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # of u's neighbours above it; those are the edges in which u is the lower end
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        return up.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """From edges (u, v) in any order: (u, root) for each vertex that isn't the least of its component."""
    up = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = scratch.keep(edges.filter("u <> v").select(*up).distinct(), f"{name}0")
    seen, turn = None, 0
    while True:
        digest = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if digest == seen or not digest.n:
            return now.select("u", F.col("v").alias("root"))
        seen, turn = digest, turn + 1
        now = scratch.keep(_star(_star(now, large=True), large=False), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
