"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _star(e: DataFrame, large: bool) -> DataFrame:
    """e: (u, v), u > v. Large star: the greater neighbours of a node link to its
    least neighbour or itself; small star: a node and its lesser neighbours to the least."""
    if large:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        out = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(node, component): the least node that a node can reach, for every node with an edge.

    ``edges``: two long columns. Each round is written to ``tmp`` and the one
    before it deleted, so lineage stays short; the number of rounds grows with the
    logarithm of the longest chain. Only two numbers a round reach the driver.
    No edges give no rows; repeated edges and loops change nothing.
    """
    a, b = edges.columns
    e = tmp.table(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark, before = now, e
        e = tmp.table(_star(tmp.table(_star(e, True), "stars"), False), "edges")
        tmp.drop(before)
