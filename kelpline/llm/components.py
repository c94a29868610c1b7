"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v): each node hands the least of its neighbourhood to its larger neighbours (large) or
    to its smaller ones and itself (small)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) for every node of ``links`` (u, v). Alternating star operations
    until nothing changes: a number of rounds that grows with the logarithm of the longest path. Edges stay in Spark,
    written to the shared folder after each round; a node with many neighbours is joined, never gathered."""
    edges = stash(links.select("u", "v").filter("u <> v").distinct())
    digest = None
    while True:
        edges = stash(_star(_star(edges, True), False))
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if digest == (row["n"], row["s"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        digest = (row["n"], row["s"])
